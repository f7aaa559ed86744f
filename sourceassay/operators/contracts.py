"""Contract checks as violation tables.

Every check is one ``when(failed, struct(field, rule, message))`` of an array over
the row, so one scan finds all problems of a file or finding.  Checks over a
whole project or manifest (counts, duplicate ids) are aggregates that combine
before they shuffle.  ``level`` is ERROR or WARN; a payload is valid when it has
no ERROR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import findings as fn
from sourceassay.functions import paths

_COLUMNS = ("project", "entity", "idx", "field", "rule", "level", "message")

#: The two contracts as data: contract, path, type, required, minimum, maximum, pattern, enum.
FIELDS = (
    ("A", "project_identifier", "string", True, None, None, fv.HEX64, None),
    ("A", "files", "array", True, 1, fv.GENERAL_MAX_FILES, None, None),
    ("A", "files.path_relative", "string", True, 1, None, None, None),
    ("A", "files.language", "string", True, None, None, None, fv.LANGUAGES),
    ("A", "files.hash", "string", True, 1, None, None, None),
    ("A", "files.stripped_content", "string", True, None, fv.MAX_CONTENT_CHARS, None, None),
    ("A", "files.original_size", "integer", True, 0, None, None, None),
    ("A", "files.stripped_size", "integer", True, 0, None, None, None),
    ("A", "files.is_test_file", "boolean", False, None, None, None, None),
    ("A", "files.is_third_party", "boolean", False, None, None, None, None),
    ("A", "truncated", "boolean", False, None, None, None, None),
    ("B", "contract_version", "string", True, None, None, fv.VERSION_1X, None),
    ("B", "project_hash", "string", True, None, None, fv.HEX64, None),
    ("B", "generated_at", "string", True, None, None, fv.ISO8601, None),
    ("B", "analysis_metadata.scanner_version", "string", True, 1, None, None, None),
    ("B", "analysis_metadata.files_analyzed", "integer", True, 0, None, None, None),
    ("B", "analysis_metadata.analysis_duration_seconds", "number", True, 0, None, None, None),
    ("B", "analysis_metadata.target_tracks", "array", True, 1, None, None, fv.TRACKS),
    ("B", "findings", "array", True, None, fv.MAX_FINDINGS, None, None),
    ("B", "findings.id", "string", True, None, None, fv.FINDING_ID, None),
    ("B", "findings.file_path", "string", True, 1, None, None, None),
    ("B", "findings.line_start", "integer", True, 1, None, None, None),
    ("B", "findings.line_end", "integer", True, 1, None, None, None),
    ("B", "findings.vulnerability_class", "string", True, None, None, None, fv.VULNERABILITY_CLASSES),
    ("B", "findings.severity", "string", True, None, None, None, fv.SEVERITIES),
    ("B", "findings.code_snippet", "string", True, None, fv.MAX_SNIPPET, None, None),
    ("B", "findings.description", "string", True, 1, fv.MAX_DESCRIPTION, None, None),
    ("B", "findings.fix_principle", "string", True, 1, fv.MAX_FIX_PRINCIPLE, None, None),
    ("B", "findings.confidence", "number", False, 0, 1, None, None),
    ("B", "findings.false_positive_risk", "string", False, None, None, None, fv.FALSE_POSITIVE_RISKS),
    ("B", "findings.related_finding_ids", "array", False, None, None, None, None),
    ("B", "request_metadata.client_version", "string", False, None, None, None, None),
    ("B", "request_metadata.user_id", "string", False, None, None, None, None),
    ("B", "request_metadata.preferred_model", "string", False, None, None, None, fv.PREFERRED_MODELS),
)


def contract_fields(spark: SparkSession) -> DataFrame:
    rows = [(*f[:4], None if f[4] is None else int(f[4]), f[5], f[6], list(f[7]) if f[7] else None)
            for f in FIELDS]
    return spark.createDataFrame(
        rows, "contract string, field string, type string, required boolean, minimum bigint, "
              "maximum bigint, pattern string, allowed array<string>")


def _fails(test: Column) -> Column:
    """A check that comes out null counts as failed."""
    return ~F.coalesce(test, F.lit(False))


def _problem(failed: Column, field: str, rule: str, message: str, level: str = "ERROR") -> Column:
    return F.when(failed, F.struct(
        F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(level).alias("level"),
        F.lit(message).alias("message")))


def _violations(rows: DataFrame, entity: Column, idx: Column, problems: list[Column]) -> DataFrame:
    return (
        rows.select("project", entity.alias("entity"), idx.alias("idx"),
                    F.explode_outer(F.array_compact(F.array(*problems))).alias("p"))
        .where(F.col("p").isNotNull())
        .select("project", "entity", "idx", "p.*")
    )


def check_files(index: DataFrame) -> DataFrame:
    """Per-file checks of the index."""
    c = F.col
    problems = [
        _problem(_fails(c("path_relative") != ""), "path_relative", "A-004", "path is missing"),
        _problem((c("path_relative") != "") & ~paths.is_relative(c("path_relative")),
                 "path_relative", "A-004", "path is not relative"),
        _problem(_fails(c("language").isin(*fv.LANGUAGES)), "language", "A-005",
                 "language is not supported"),
        _problem(c("stripped_content").isNull(), "stripped_content", "A-003", "content is missing"),
        _problem(F.length("stripped_content") > fv.MAX_CONTENT_CHARS, "stripped_content", "A-003",
                 "content is too long"),
        _problem(_fails(c("hash") != ""), "hash", "A-008", "hash is missing"),
        _problem(_fails(c("original_size") >= 0), "original_size", "A-008", "size is missing or negative"),
        _problem(_fails(c("stripped_size") >= 0), "stripped_size", "A-008", "size is missing or negative"),
    ]
    return _violations(index, F.lit("file"), F.col("path_relative"), problems)


def check_index(projects: DataFrame, index: DataFrame) -> DataFrame:
    """Per-project checks: identifier, number of files, truncation.

    ``projects(project, project_identifier, truncated)`` keeps projects without files.
    """
    counts = index.groupBy("project").agg(F.count("*").alias("n"))
    rows = projects.join(counts, "project", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    problems = [
        _problem(_fails(F.col("project_identifier").rlike(fv.HEX64)), "project_identifier", "A-006",
                 "identifier is not a SHA-256 digest"),
        _problem(F.col("n") < 1, "files", "A-001", "no files"),
        _problem(F.col("n") > fv.GENERAL_MAX_FILES, "files", "A-002", "too many files"),
        _problem(F.col("truncated"), "truncated", "A-007", "index is truncated", "WARN"),
    ]
    return _violations(rows, F.lit("project"), F.col("project"), problems)


def check_contract_a(projects: DataFrame, index: DataFrame) -> DataFrame:
    return check_files(index).unionByName(check_index(projects, index))


REQUIRED = ("id", "file_path", "line_start", "line_end", "vulnerability_class", "severity",
            "code_snippet", "description", "fix_principle")


def check_findings(findings: DataFrame) -> DataFrame:
    """Per-finding checks.  ``findings(project, idx, id, ...)``: ``project`` names the manifest."""
    c = F.col
    start, end = c("line_start") >= 1, c("line_end").isNotNull()
    missing = [_problem(c(f).isNull(), f, "B-000", "required field is missing") for f in REQUIRED]
    problems = missing + [
        _problem(_fails(c("id").rlike(fv.FINDING_ID)), "id", "B-007", "id has the wrong format"),
        _problem(_fails(c("file_path") != ""), "file_path", "B-010", "path is missing"),
        _problem(_fails(start), "line_start", "B-002", "line_start is not 1 or more"),
        _problem(_fails(end), "line_end", "B-002", "line_end is missing"),
        _problem(start & (c("line_end") < c("line_start")), "line_end", "B-002",
                 "line_end is before line_start"),
        _problem(_fails(c("vulnerability_class").isin(*fv.VULNERABILITY_CLASSES)),
                 "vulnerability_class", "B-004", "unknown class"),
        _problem(_fails(c("severity").isin(*fv.SEVERITIES)), "severity", "B-009", "unknown severity"),
        _problem(c("code_snippet").isNull(), "code_snippet", "B-003", "snippet is missing"),
        _problem(F.length("code_snippet") > fv.MAX_SNIPPET, "code_snippet", "B-003", "snippet is too long"),
        _problem(paths.leaks_absolute_path(c("code_snippet")), "code_snippet", "B-003",
                 "snippet shows an absolute path"),
        _problem(_fails(c("description") != ""), "description", "B-010", "description is missing"),
        _problem(F.length("description") > fv.MAX_DESCRIPTION, "description", "B-010",
                 "description is too long"),
        _problem(_fails(c("fix_principle") != ""), "fix_principle", "B-010", "fix principle is missing"),
        _problem(F.length("fix_principle") > fv.MAX_FIX_PRINCIPLE, "fix_principle", "B-010",
                 "fix principle is too long"),
        _problem(c("confidence").isNotNull() & (F.isnan("confidence") | ~c("confidence").between(0, 1)),
                 "confidence", "B-005", "confidence is outside 0..1"),
        _problem(c("false_positive_risk").isNotNull()
                 & ~c("false_positive_risk").isin(*fv.FALSE_POSITIVE_RISKS),
                 "false_positive_risk", "B-009", "unknown risk level"),
        _problem(F.exists("related_finding_ids", lambda r: r.isNull()), "related_finding_ids", "B-013",
                 "related ids are not all strings"),
    ]
    return _violations(findings, F.lit("finding"), F.col("idx").cast("string"), problems)


def duplicate_ids(findings: DataFrame) -> DataFrame:
    """Second and later uses of a well-formed id, in array order.

    The first use per id is a pre-aggregated minimum; the join back is split at
    run time when one id is very frequent.
    """
    formed = findings.where(F.col("id").rlike(fv.FINDING_ID)).select("project", "idx", "id")
    first = formed.groupBy("project", "id").agg(
        F.min("idx").alias("first"), F.count("*").alias("uses")).where("uses > 1")
    return (
        formed.join(first, ["project", "id"])
        .where(F.col("idx") > F.col("first"))
        .select("project", F.lit("finding").alias("entity"), F.col("idx").cast("string").alias("idx"),
                F.lit("id").alias("field"), F.lit("B-007").alias("rule"), F.lit("ERROR").alias("level"),
                F.lit("id is used before").alias("message"))
    )


def check_manifests(manifests: DataFrame, findings: DataFrame) -> DataFrame:
    """Manifest-level checks with the number of findings."""
    counts = findings.groupBy("project").agg(F.count("*").alias("n"))
    rows = manifests.join(counts, "project", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col
    meta, request = c("analysis_metadata"), c("request_metadata")
    tracks = meta.target_tracks
    problems = [
        _problem(_fails(c("contract_version").rlike(fv.VERSION_1X)), "contract_version", "B-011",
                 "version is not 1.x.y"),
        _problem(_fails(c("project_hash").rlike(fv.HEX64)), "project_hash", "B-011",
                 "hash is not a SHA-256 digest"),
        _problem(_fails(c("generated_at").rlike(fv.ISO8601)), "generated_at", "B-011",
                 "timestamp is not ISO 8601"),
        _problem(c("n") > fv.MAX_FINDINGS, "findings", "B-006", "too many findings"),
        _problem(meta.isNull(), "analysis_metadata", "B-012", "metadata is missing"),
        _problem(meta.isNotNull() & _fails(meta.scanner_version != ""),
                 "scanner_version", "B-012", "scanner version is missing"),
        _problem(meta.isNotNull() & _fails(meta.files_analyzed >= 0), "files_analyzed", "B-012",
                 "number of files is missing or negative"),
        _problem(meta.isNotNull() & _fails(meta.analysis_duration_seconds >= 0),
                 "analysis_duration_seconds", "B-012", "duration is missing or negative"),
        _problem(meta.isNotNull() & _fails(F.size(tracks) > 0), "target_tracks", "B-008",
                 "no target tracks"),
        _problem(F.size(F.array_except(tracks, F.array(*[F.lit(t) for t in fv.TRACKS]))) > 0,
                 "target_tracks", "B-008", "unknown track"),
        _problem(request.preferred_model.isNotNull()
                 & ~request.preferred_model.isin(*fv.PREFERRED_MODELS),
                 "preferred_model", "B-013", "unknown model"),
    ]
    return _violations(rows, F.lit("manifest"), F.col("project"), problems)


def unknown_files(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings whose file is not in the index."""
    known = index.select("project", F.col("path_relative").alias("file_path"))
    return findings.join(known, ["project", "file_path"], "left_anti")


def check_known_files(findings: DataFrame, index: DataFrame, code_project: str = "project") -> DataFrame:
    """A violation for each finding whose file is not in the index of its ``code_project``."""
    rows = findings.withColumns({"payload": F.col("project"), "project": F.col(code_project)})
    missing = unknown_files(rows, index).withColumn("project", F.col("payload"))
    problem = _problem(F.lit(True), "file_path", "B-001", "file is not in the index")
    return _violations(missing, F.lit("finding"), F.col("idx").cast("string"), [problem])


def check_contract_b(manifests: DataFrame, findings: DataFrame, index: DataFrame | None = None, code_project: str = "project") -> DataFrame:
    """All violations of the manifests; files are looked up if an index is given."""
    found = (
        check_findings(findings).unionByName(duplicate_ids(findings))
        .unionByName(check_manifests(manifests, findings))
    )
    return found if index is None else found.unionByName(check_known_files(findings, index, code_project))


def verdicts(payloads: DataFrame, violations: DataFrame) -> DataFrame:
    """Per payload: number of errors and warnings, and whether it is valid."""
    counts = violations.groupBy("project").agg(
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARN").alias("warnings"))
    return (
        payloads.select("project").join(counts, "project", "left")
        .select("project", F.coalesce("errors", F.lit(0)).alias("errors"),
                F.coalesce("warnings", F.lit(0)).alias("warnings"))
        .withColumn("is_valid", F.col("errors") == 0)
    )


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("project", "rule", "level").agg(F.count("*").alias("n"))


def valid_rows(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of the payloads that have no error."""
    bad = violations.where(F.col("level") == "ERROR").select("project").distinct()
    return rows.join(bad, "project", "left_anti")


def with_validity(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of all payloads, with ``is_valid``: does their payload have no error?"""
    bad = violations.where(F.col("level") == "ERROR").select("project").distinct().withColumn("bad", F.lit(True))
    return rows.join(bad, "project", "left").withColumn("is_valid", F.col("bad").isNull()).drop("bad")


def valid_findings(manifests: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of valid manifests, with the default confidence filled in."""
    return valid_rows(findings, check_contract_b(manifests, findings)).withColumn(
        "confidence", fn.confidence(F.col("confidence")))
