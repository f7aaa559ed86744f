"""JSON payloads of both contracts derived from ``orders``: one document each, many of them broken.

The expressions are shared by Spark and the oracle.  A payload holds three
elements, numbered ``n``, so that no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceassay.functions.sizing import spread

_BASE = ("o_orderkey AS k",)
_PROJECT = "'p' || k"


def _choose(number: str, default: str, *cases: tuple[int, str]) -> str:
    """SQL text: the JSON snippet of the first divisor of ``number``, else the default."""
    whens = " ".join(f"WHEN {number} % {d} = 0 THEN {text}" for d, text in cases)
    return f"CASE {whens} ELSE {default} END"


def _join(parts: list[str]) -> str:
    return " || ".join(f"({p})" for p in parts)


def _finding(n: str) -> str:
    return _join([
        f"CASE WHEN {n} % 113 = 0 THEN '\"text\"' WHEN {n} % 127 = 0 THEN 'null' ELSE " + _join([
            "'{'",
            _choose(n, f"'\"id\":\"FSA-LOGIC-' || (CASE WHEN k % 6 = 0 THEN k ELSE {n} END + 1000) || '\",'", (13, "'\"id\":7,'"),
                    (17, "''"), (19, "'\"id\":\"BAD-1\",'")),
            _choose(n, "'\"file_path\":\"src/a.js\",'", (29, "'\"file_path\":\"\",'"), (31, "'\"file_path\":null,'")),
            _choose(n, f"'\"line_start\":' || ({n} % 50 + 1) || ','", (11, "'\"line_start\":0,'"), (37, "'\"line_start\":\"5\",'"),
                    (41, "'\"line_start\":2.0,'"), (43, "'\"line_start\":true,'")),
            _choose(n, "'\"line_end\":60,'", (47, "'\"line_end\":null,'"), (53, "'\"line_end\":1,'"), (59, "''")),
            _choose(n, "'\"vulnerability_class\":\"LOGIC_FLAW\",'", (61, "'\"vulnerability_class\":\"ODD\",'"),
                    (67, "'\"vulnerability_class\":[],'")),
            _choose(n, "'\"severity\":\"HIGH\",'", (71, "'\"severity\":\"high\",'"), (73, "''")),
            _choose(n, "'\"code_snippet\":\"x\",'", (79, "'\"code_snippet\":\"open(/home/u/x)\",'"),
                    (83, "'\"code_snippet\":\"' || repeat('x', 5000) || '\",'"), (89, "'\"code_snippet\":[1],'")),
            _choose(n, "'\"description\":\"d\",'", (97, "'\"description\":\"\",'"), (101, "'\"description\":\"' || repeat('d', 1001) || '\",'")),
            _choose(n, "'\"fix_principle\":\"f\",'", (103, "'\"fix_principle\":{\"a\":1},'"), (107, "''")),
            _choose(n, "'\"confidence\":0.25,'", (10, "'\"confidence\":null,'"), (7, "''"), (23, "'\"confidence\":\"0.5\",'"),
                    (109, "'\"confidence\":1.5,'"), (9, "'\"confidence\":1,'")),
            _choose(n, "'\"false_positive_risk\":\"LOW\",'", (6, "'\"false_positive_risk\":null,'"), (131, "'\"false_positive_risk\":\"NONE\",'"),
                    (137, "'\"false_positive_risk\":4,'"), (8, "''")),
            _choose(n, "''", (10, "'\"note\":{\"a\":[1,2]},'"), (12, "'\"tag\":\"t' || k || '\",'")),
            _choose(n, "'\"related_finding_ids\":[\"FSA-X\"]'", (139, "'\"related_finding_ids\":[\"a\",1]'"),
                    (149, "'\"related_finding_ids\":\"x\"'"), (151, "'\"related_finding_ids\":[null]'"),
                    (4, "'\"related_finding_ids\":null'")),
            "'}'"]) + " END"])


def _elements(element) -> str:
    return _join(["'['", element("(k * 3)"), "','", element("(k * 3 + 1)"), "','", element("(k * 3 + 2)"), "']'"])


def _whole(document: str) -> str:
    return _choose("k", document, (211, "'not json'"), (223, "'[1]'"), (227, "''"), (229, "'{}'"), (233, "NULL"))


def manifest_body(hash_sql: str) -> str:
    tracks = "'{\"scanner_version\":\"1.2\",\"files_analyzed\":3,\"analysis_duration_seconds\":0.5,\"target_tracks\":"
    return _whole(_join([
        "'{'",
        _choose("k", "'\"contract_version\":\"1.0.0\",'", (19, "'\"contract_version\":\"2.0\",'"), (29, "'\"contract_version\":1,'")),
        _choose("k", f"'\"project_hash\":\"' || {hash_sql} || '\",'", (31, f"'\"project_hash\":\"' || upper({hash_sql}) || '\",'"), (37, "''")),
        _choose("k", "'\"generated_at\":\"2024-01-01T00:00:00Z\",'", (41, "'\"generated_at\":\"2024-01-01\",'"), (43, "'\"generated_at\":null,'")),
        _choose("k", "'\"analysis_metadata\":' || " + tracks + "[\"web2\"]},'", (47, "''"), (53, "'\"analysis_metadata\":\"none\",'"),
                (59, "'\"analysis_metadata\":' || " + tracks + "[]},'"), (61, "'\"analysis_metadata\":' || " + tracks + "[\"web2\",\"web9\",4]},'"),
                (67, "'\"analysis_metadata\":{\"scanner_version\":\"\",\"files_analyzed\":-1,\"analysis_duration_seconds\":\"1\",\"host\":\"h\"},'")),
        _choose("k", "'\"request_metadata\":{\"client_version\":\"1\",\"user_id\":\"u\",\"preferred_model\":\"gpt-4\"},'", (3, "''"),
                (71, "'\"request_metadata\":5,'"), (73, "'\"request_metadata\":{\"client_version\":1,\"user_id\":null,\"preferred_model\":\"gpt-9\"},'"),
                (7, "'\"request_metadata\":null,'")),
        _choose("k", "''", (14, "'\"origin\":true,'")),
        _choose("k", "'\"findings\":' || " + _elements(_finding), (79, "'\"findings\":{}'"), (83, "'\"findings\":null'"), (89, "'\"findings\":[]'")),
        "'}'"]))


def _file(n: str) -> str:
    return _choose(n, _join([
        "'{'",
        _choose(n, f"'\"path_relative\":\"src/f' || {n} || '.js\",'", (11, "'\"path_relative\":\"/abs/x.js\",'"), (13, "'\"path_relative\":\"\",'"),
                (17, "''"), (19, "'\"path_relative\":3,'")),
        _choose(n, "'\"language\":\"js\",'", (23, "'\"language\":\"rb\",'"), (29, "'\"language\":null,'")),
        _choose(n, "'\"hash\":\"h\",'", (31, "'\"hash\":\"\",'"), (37, "'\"hash\":false,'")),
        _choose(n, "'\"stripped_content\":\"\",'", (41, "'\"stripped_content\":null,'"), (43, "''")),
        _choose(n, "'\"original_size\":9,'", (47, "'\"original_size\":-1,'"), (53, "'\"original_size\":9.5,'")),
        _choose(n, "'\"is_test_file\":false,'", (59, "'\"is_test_file\":null,'"), (61, "'\"is_test_file\":0,'"), (3, "''")),
        _choose(n, "''", (10, "'\"owner\":[1],'")),
        _choose(n, f"'\"stripped_size\":' || {n}", (67, "'\"stripped_size\":true'"), (71, "'\"stripped_size\":\"1\"'")),
        "'}'"]), (73, "'[]'"), (79, "'4'"))


def index_body(hash_sql: str) -> str:
    return _whole(_join([
        "'{'",
        _choose("k", f"'\"project_identifier\":\"' || {hash_sql} || '\",'", (19, f"'\"project_identifier\":\"' || upper({hash_sql}) || '\",'"),
                (23, "'\"project_identifier\":12,'"), (29, "''")),
        _choose("k", "'\"truncated\":false,'", (31, "'\"truncated\":true,'"), (37, "'\"truncated\":\"no\",'"), (41, "'\"truncated\":null,'"), (2, "''")),
        _choose("k", "'\"files\":' || " + _elements(_file), (43, "'\"files\":[]'"), (47, "'\"files\":\"none\"'"), (53, "'\"archive\":1'")),
        "'}'"]))


_BODIES = {"A": index_body, "B": manifest_body}


def payloads(spark: SparkSession, sf_dir: str, contract: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_BASE)
    return spread(orders).selectExpr(f"{_PROJECT} AS project", f"{_BODIES[contract](f'sha2({_PROJECT}, 256)')} AS body")


def payloads_sql(contract: str) -> str:
    return (f"SELECT {_PROJECT} AS project, CAST({_BODIES[contract](f'sha256({_PROJECT})')} AS VARCHAR) AS body "
            f"FROM (SELECT {', '.join(_BASE)} FROM orders)")
