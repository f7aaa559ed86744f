"""Findings, manifests, patches and server answers derived from ``orders`` and ``lineitem``.

One order is one finding, one lineitem one patch.  A third of the orders falls
into one manifest, and every other manifest carries broken rows.  The
expressions are shared by Spark and the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions.sizing import spread
from sourceassay.plans.demo_corpus import ORDER_PROJECT, order_path, pick

_ABBREVIATIONS = [
    fv.CLASS_ABBREVIATIONS.get(c, c.replace("_", "")[:6]) for c in fv.VULNERABILITY_CLASSES
]
MANIFEST = "CASE WHEN k % 3 = 0 THEN 0 ELSE CAST(floor(k / 400) AS BIGINT) END"
BASE = (
    "o_orderkey AS k", "CAST(floor(o_orderkey / 10) AS BIGINT) AS b", "o_custkey AS ck",
    "o_totalprice AS price", "o_orderpriority AS priority",
)
KEYED = ("*", f"{MANIFEST} AS m", f"({MANIFEST}) % 2 = 0 AS dirty")
PADDED = "CASE WHEN k < 1000 THEN lpad(CAST(k AS STRING), 3, '0') ELSE CAST(k AS STRING) END"


def finding_id(dialect: str) -> str:
    return (
        "CASE WHEN dirty AND k % 97 = 0 THEN 'FSA-DUP-001' WHEN dirty AND k % 101 = 0 THEN 'BAD-1' "
        f"ELSE 'FSA-' || {pick(_ABBREVIATIONS, 'k % 16', dialect)} || '-' || {PADDED} END"
    )


def finding_columns(dialect: str) -> tuple[str, ...]:
    classes = pick(fv.VULNERABILITY_CLASSES, "k % 16", dialect)
    start = "CAST(CASE WHEN dirty THEN ck % 50 ELSE ck % 50 + 1 END AS INT)"
    return (
        "'m' || m AS project", f"{ORDER_PROJECT} AS code_project", "'org' || ck % 5 AS owner",
        "k AS idx", f"{finding_id(dialect)} AS id",
        f"CASE WHEN k % 41 = 0 THEN 'missing/x.js' ELSE {order_path(dialect)} END AS file_path",
        f"{start} AS line_start",
        f"CAST({start} + k % 7 - CASE WHEN dirty THEN 1 ELSE 0 END AS INT) AS line_end",
        f"CASE WHEN dirty AND k % 17 = 0 THEN 'NOT_A_CLASS' ELSE {classes} END AS vulnerability_class",
        "CASE WHEN priority = '1-URGENT' THEN 'CRITICAL' WHEN priority = '2-HIGH' THEN 'HIGH' "
        "WHEN priority = '3-MEDIUM' THEN 'MEDIUM' WHEN priority = '5-LOW' THEN 'LOW' "
        "WHEN dirty THEN 'UNKNOWN' ELSE 'LOW' END AS severity",
        "CASE WHEN dirty AND k % 23 = 0 THEN 'open(/home/u/x)' WHEN dirty AND k % 29 = 0 THEN 'C:' || chr(92) || 'x' "
        "WHEN dirty AND k % 31 = 0 THEN repeat('x', 5000) ELSE 'snippet ' || k END AS code_snippet",
        "CASE WHEN dirty AND k % 37 = 0 THEN '' WHEN dirty AND k % 59 = 0 THEN repeat('d', 1001) "
        "ELSE 'description ' || k END AS description",
        "CASE WHEN dirty AND k % 61 = 0 THEN NULL WHEN dirty AND k % 67 = 0 THEN repeat('f', 501) "
        "ELSE 'fix it' END AS fix_principle",
        "CASE WHEN k % 11 = 0 THEN NULL WHEN dirty THEN price / 200000 ELSE (k % 100) / 100.0E0 END AS confidence",
        "CASE WHEN dirty AND k % 43 = 0 THEN 'NONE' WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'LOW' "
        "WHEN k % 4 = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS false_positive_risk",
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*BASE)
    return spread(orders).selectExpr(*KEYED)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        *finding_columns("spark"),
        "CASE WHEN dirty AND k % 47 = 0 THEN array(CAST(NULL AS STRING)) ELSE array('FSA-X') END "
        "AS related_finding_ids")


def findings_sql() -> str:
    return (
        f"SELECT {', '.join(finding_columns('duckdb'))}, dirty AND k % 47 = 0 AS bad_related "
        f"FROM (SELECT {', '.join(KEYED)} FROM (SELECT {', '.join(BASE)} FROM orders))")


#: header columns of a manifest with number ``m`` and ``n`` findings
MANIFEST_COLUMNS = (
    "CASE WHEN m % 5 = 4 THEN '2.0' ELSE '1.0.0' END AS contract_version",
    "CASE WHEN m % 7 = 6 THEN upper(HASH) ELSE HASH END AS project_hash",
    "CASE WHEN m % 10 = 8 THEN '2024-01-01' ELSE '2024-01-01T00:00:00Z' END AS generated_at",
    "CASE WHEN m % 8 = 6 THEN '' ELSE '1.2.3' END AS scanner_version",
    "CASE WHEN m % 9 = 8 THEN -1 ELSE n END AS files_analyzed",
    "0.5E0 AS analysis_duration_seconds",
    "CASE WHEN m % 6 = 4 THEN '' WHEN m % 12 = 2 THEN 'web2,web9' ELSE 'web2' END AS tracks",
    "CASE WHEN m % 11 = 9 THEN 'gpt-9' ELSE 'gpt-4' END AS preferred_model",
)


def manifest_headers(hash_sql: str) -> tuple[str, ...]:
    return tuple(c.replace("HASH", hash_sql) for c in MANIFEST_COLUMNS)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per number, and one without findings per region."""
    grouped = _orders(spark, sf_dir).groupBy("m").agg(F.count("*").alias("n")).selectExpr(
        "m", "'m' || m AS project", "n")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr(
        "r_regionkey AS m", "'region' || r_regionkey AS project", "0L AS n")
    rows = grouped.unionByName(regions.selectExpr("CAST(m AS BIGINT) AS m", "project", "n"))
    flat = rows.selectExpr("m", "project", *manifest_headers("sha2(project, 256)"))
    return flat.select(
        "m", "project", "contract_version", "project_hash", "generated_at",
        F.struct(
            "scanner_version", "files_analyzed", "analysis_duration_seconds",
            F.expr("filter(split(tracks, ','), t -> t <> '')").alias("target_tracks"),
        ).alias("analysis_metadata"),
        F.struct(F.lit("1.0").alias("client_version"), F.lit("u").alias("user_id"),
                 "preferred_model").alias("request_metadata"))


def manifests_sql() -> str:
    rows = (
        f"SELECT m, 'm' || m AS project, count(*) AS n FROM (SELECT {MANIFEST} AS m FROM "
        "(SELECT o_orderkey AS k FROM orders)) GROUP BY m "
        "UNION ALL SELECT r_regionkey, 'region' || r_regionkey, 0 FROM region")
    return f"SELECT m, project, {', '.join(manifest_headers('sha256(project)'))} FROM ({rows})"


#: one patch per lineitem; equal places carry equal patches
PATCH_COLUMNS = (
    "CASE WHEN l_linenumber = 3 THEN '' ELSE 'patched ' || l_partkey || chr(10) || 'by ' || l_suppkey END AS patch",
    "'because ' || l_linenumber AS explanation",
    "(CAST(l_partkey AS BIGINT) * 100000 + l_suppkey) * 10 + l_linenumber AS pos",
)
_PATCH_BASE = ("l_orderkey AS k", "l_partkey", "l_suppkey", "l_linenumber")


def patch_columns(dialect: str) -> tuple[str, ...]:
    return (
        "'m' || m AS project",
        f"CASE WHEN l_partkey % 50 = 0 THEN '' ELSE {finding_id(dialect)} END AS finding_id",
        *PATCH_COLUMNS)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_PATCH_BASE)
    return spread(rows).selectExpr(*KEYED).selectExpr(*patch_columns("spark")).where("finding_id <> ''")


def patches_sql() -> str:
    return (
        f"SELECT * FROM (SELECT {', '.join(patch_columns('duckdb'))} FROM (SELECT {', '.join(KEYED)} "
        f"FROM (SELECT {', '.join(_PATCH_BASE)} FROM lineitem))) WHERE finding_id <> ''")


STATUS = "CASE WHEN m % 9 = 0 THEN 'ERROR' WHEN m % 9 = 1 THEN 'CREDIT_EXHAUSTED' ELSE 'OK' END AS status"

#: answer of the patch service to one finding: two patches and an entry without id
RESPONSE = (
    """'{"findings": [{"finding_id": "' || id || '", "patch": "a' || idx || '", "explanation": "one"}, """
    """{"finding_id": "' || id || '", "patch": "b' || idx || '"}, {"patch": "lost"}]}' AS body"""
)
#: result document of a rule engine for one finding
RULE_RESULT = (
    """'{"results": [{"check_id": "r' || idx % 7 || '", "path": "/work/' || project || '/' || file_path || """
    """'", "start": {"line": ' || line_start || '}, "end": {"line": ' || line_end || '}, "extra": {"message": "m", """
    """"severity": "ERROR", "metadata": {"vulnerability_class": "' || vulnerability_class || '"}}}, """
    """{"check_id": "bare' || idx % 5 || '", "path": "elsewhere.js"}]}' AS body"""
)

#: an index as a foreign client might send it, with broken rows
INDEX_COLUMNS = (
    "'m' || m AS project",
    "CASE WHEN k % 19 = 0 THEN '/abs/x.js' WHEN k % 23 = 0 THEN 'C:' || chr(92) || 'x.js' WHEN k % 29 = 0 THEN '' "
    "WHEN k % 31 = 0 THEN '~/x.js' WHEN k % 37 = 0 THEN NULL ELSE 'src/F' || k || '.js' END AS path_relative",
    "CASE WHEN k % 13 = 0 THEN 'rb' WHEN k % 41 = 0 THEN NULL ELSE 'js' END AS language",
    "CASE WHEN k % 17 = 0 THEN '' ELSE 'h' || k END AS hash",
    "CASE WHEN k % 43 = 0 THEN NULL ELSE 'text ' || k END AS stripped_content",
    "CASE WHEN k % 47 = 0 THEN NULL ELSE k - 3 END AS original_size",
    "CASE WHEN k % 53 = 0 THEN -1 ELSE k END AS stripped_size",
)
PROJECT_COLUMNS = (
    "project", "CASE WHEN m % 7 = 6 THEN upper(HASH) ELSE HASH END AS project_identifier",
    "m % 5 = 0 AS truncated",
)


def foreign_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(*INDEX_COLUMNS)


def foreign_index_sql() -> str:
    return (f"SELECT {', '.join(INDEX_COLUMNS)} "
            f"FROM (SELECT {', '.join(KEYED)} FROM (SELECT {', '.join(BASE)} FROM orders))")


def foreign_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.replace("HASH", "sha2(project, 256)") for c in PROJECT_COLUMNS]
    return manifests(spark, sf_dir).selectExpr(*columns)


def foreign_projects_sql() -> str:
    columns = [c.replace("HASH", "sha256(project)") for c in PROJECT_COLUMNS]
    return f"SELECT {', '.join(columns)} FROM manifests"


#: what else an audit of a manifest's project ran into
FAILURES = {"parse": "m % 12 = 11", "index": "m % 13 = 5"}
