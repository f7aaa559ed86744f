"""Findings, patches, reports and roll-ups.

Tables that hold one value per manifest (nested report, Markdown) are
only built for findings of *valid* manifests, which hold 500 findings at most;
everything else stays one row per finding, of any manifest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceassay import fixed_values as fv
from sourceassay.functions import paths


def last_patches(patches: DataFrame) -> DataFrame:
    """The last patch per finding, by ``pos``; combined before the shuffle."""
    return patches.groupBy("project", "finding_id").agg(
        F.max_by(F.struct("patch", "explanation"), "pos").alias("last")
    ).select("project", "finding_id", "last.patch", "last.explanation")


def build_report(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """Every finding with its last patch; line ranges are kept for splicing."""
    last = last_patches(patches).withColumnRenamed("finding_id", "id")
    return findings.join(last, ["project", "id"], "left").select(
        "project", "idx", "id", "file_path", "line_start", "line_end", "vulnerability_class",
        "severity", "description", "patch", "explanation")


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per level; other levels only count in the total."""
    level = F.lower("severity")
    return findings.groupBy(*(keys or ("project",))).agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low")])


def owner_rollup(findings: DataFrame) -> DataFrame:
    """Severities per owner and project, per owner, and overall."""
    level = F.lower("severity")
    return findings.rollup("owner", "project").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low")])


def summary_lines(counts: DataFrame, status: Column | None = None, label: str = "Audit") -> DataFrame:
    """One line of text per report."""
    status = F.coalesce(status if status is not None else F.lit(None).cast("string"), F.lit("OK"))
    numbers = [F.coalesce(c, F.lit(0)) for c in ("total_findings", "critical", "high", "medium", "low")]
    return counts.select("project", F.format_string(
        label + fv.SUMMARY_LINE, status, *numbers).alias("summary"))


def reports(report: DataFrame, manifests: DataFrame, as_of: Column) -> DataFrame:
    """Nested report per manifest, also of those without findings.

    Give it rows and manifests of valid payloads only; ``audit_outcomes`` tells which of them the server refused.
    """
    nested = report.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.struct(
            "id", "file_path", "line_start", "line_end", "vulnerability_class", "severity",
            "description", "patch", "explanation").alias("finding")))).alias("rows")
    ).select("project", F.col("rows.finding").alias("findings"))
    counts = severity_counts(report)
    def known(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)
    return (
        manifests.select("project", "project_hash").join(nested, "project", "left").join(counts, "project", "left")
        .select("project", "project_hash", as_of.alias("scan_time"),
                F.when(F.col("findings").isNull(), "NO_FINDINGS").otherwise("OK").alias("status"),
                F.struct(*map(known, ("total_findings", "critical", "high", "medium", "low"))).alias("summary"),
                F.coalesce("findings", F.array()).alias("findings"))
    )


def report_json(nested: DataFrame) -> DataFrame:
    """One JSON document per manifest; nulls are written out."""
    document = F.struct("project_hash", "scan_time", "status", "summary", "findings")
    return nested.select("project", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def write_reports(nested: DataFrame, path: str) -> None:
    """JSON documents, one a line, in a folder per project hash."""
    report_json(nested.withColumn("project", F.col("project_hash"))).withColumnsRenamed(
        {"project": "project_hash", "json": "value"}).write.mode("overwrite").partitionBy("project_hash").text(path)


def applicable_patches(report: DataFrame, files: DataFrame) -> DataFrame:
    """Report rows with a patch whose file exists."""
    known = files.select("project", F.col("path").alias("file_path"))
    return report.where((F.col("patch") != "") & (F.col("file_path") != "")).join(
        known, ["project", "file_path"], "left_semi")


def suggestions(applicable: DataFrame) -> DataFrame:
    """Suggestion files as rows."""
    return applicable.select(
        "project", paths.suggestion_path(F.col("file_path"), F.col("id")).alias("suggestion_path"),
        "patch", *[c for c in applicable.columns if c == "is_valid"])


def markdown_body(report: DataFrame, applied: DataFrame) -> DataFrame:
    """Markdown summary per manifest: totals and a table of the applied findings."""
    row = F.format_string(fv.MARKDOWN_ROW, "id", "severity", "file_path", "vulnerability_class")
    table = applied.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("idx", row.alias("text")))).alias("rows")
    ).select("project", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("table"))
    head = F.format_string(
        fv.MARKDOWN_HEAD, "total_findings", "critical", "high", "medium", "low")
    return severity_counts(report).join(table, "project", "left").select(
        "project",
        F.concat_ws("\n", head, F.lit(""), F.lit(fv.MARKDOWN_COLUMNS), "table").alias("body"))


def _greedy(batches):
    """``project, file_path, line_start, line_end, ...`` in order -> with ``rejected``; only the end of the last accepted patch is kept."""
    file, end = None, 0
    for batch in batches:
        rejected = []
        for project, path, first, last in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (project, path) != file:
                file, end = (project, path), 0
            fits = first is not None and last is not None and max(end, 0) < first <= last
            end = last if fits else end
            rejected.append(not fits)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "rejected"])


def mark_overlaps(report: DataFrame) -> DataFrame:
    """Patches as rows with ``rejected``: of a file, in the order of start and id, one that overlaps the last *accepted* one.

    So is one whose lines are missing, start below 1 or end before they start.  Rows of a file are read as one ordered
    stream, so a file may have any number of patches.
    """
    rows = report.select("project", "file_path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"),
                         "id", "patch")
    return (rows.repartition("project", "file_path").sortWithinPartitions("project", "file_path", "line_start", "id")
            .mapInArrow(_greedy, T.StructType([*rows.schema.fields, T.StructField("rejected", T.BooleanType())])))


def splice(files: DataFrame, applicable: DataFrame) -> DataFrame:
    """Replace the lines of every accepted patch; what stands between two patches is copied once."""
    order = W.partitionBy("project", "file_path", "rejected").orderBy("line_start", "id")
    marked = mark_overlaps(applicable).withColumn("before", F.lag("line_end", 1, 0).over(order))
    piece = F.struct("line_start", "before", "line_end", "patch")
    # The accepted patches of a file are a part of its new text.
    by_file = marked.groupBy("project", F.col("file_path").alias("path")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("rejected"), piece))).alias("accepted"), F.count_if("rejected").cast("int").alias("rejected"))
    lines = F.col("lines")
    parts = F.transform("accepted", lambda p: F.concat(
        F.slice(lines, p["before"] + 1, p["line_start"] - 1 - p["before"]), F.split(p["patch"], "\n")))
    end = F.coalesce(F.array_max(F.transform("accepted", lambda p: p["line_end"])), F.lit(0))
    rest = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return files.select("project", "path", "content").join(by_file, ["project", "path"]).withColumn("lines", F.split("content", "\n")).select(
        "project", "path", F.array_join(F.concat(F.flatten(parts), rest), "\n").alias("content"), F.size("accepted").alias("applied"), "rejected")


def audit_outcomes(
    projects: DataFrame, parse_failures: DataFrame, a_errors: DataFrame, b_errors: DataFrame,
    finding_counts: DataFrame, server_status: DataFrame,
) -> DataFrame:
    """Outcome and exit code per project.

    The first four side tables hold the projects they concern; ``finding_counts``
    has ``total_findings`` and ``server_status`` has ``status``.
    """
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("project").distinct().withColumn(name, F.lit(True))

    joined = (
        projects.select("project")
        .join(flag(parse_failures, "no_parse"), "project", "left")
        .join(flag(a_errors, "bad_a"), "project", "left")
        .join(flag(b_errors, "bad_b"), "project", "left")
        .join(finding_counts.select("project", "total_findings"), "project", "left")
        .join(server_status.select("project", "status"), "project", "left")
    )
    outcome = (
        F.when(F.col("no_parse"), "PARSE_ERROR")
        .when(F.col("bad_a"), "INDEX_INVALID")
        .when(F.col("bad_b"), "MANIFEST_INVALID")
        .when(F.coalesce("total_findings", F.lit(0)) == 0, "NO_FINDINGS")
        .when(F.col("status") == "ERROR", "AUDIT_FAILURE")
        .when(F.col("status") == "CREDIT_EXHAUSTED", "CREDIT_EXHAUSTED")
        .otherwise("OK")
    )
    code = F.when(outcome.isin("PARSE_ERROR", "INDEX_INVALID", "MANIFEST_INVALID"), 1).when(
        outcome == "AUDIT_FAILURE", 2).otherwise(0)
    return joined.select("project", outcome.alias("outcome"), code.alias("exit_code"))


def merge_findings(manifest: DataFrame, web3: DataFrame) -> DataFrame:
    """Manifest findings and Solidity findings in one table."""
    return manifest.unionByName(web3, allowMissingColumns=True)
