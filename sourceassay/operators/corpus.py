"""From raw files to the file index: prune, tag, cap, decode, normalise, summarise.

Tables: ``source_files(project, path, raw, is_symlink)`` in, file index and
errors out.  Nothing here shuffles file contents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import paths, text
from sourceassay.functions.sizing import nth_smallest


def ignored_dirs(track: str = "general", extra: Iterable[str] = ()) -> tuple[str, ...]:
    base = fv.SOLIDITY_IGNORED_DIRS if track == "solidity" else fv.GENERAL_IGNORED_DIRS
    return (*base, *extra)


def with_suffix(files: DataFrame) -> DataFrame:
    """Add ``ext``, the column a stored corpus is partitioned by."""
    return files.withColumn("ext", F.coalesce(F.nullif(paths.suffix(F.col("path")), F.lit("")),
                                              F.lit("none")))


def only_suffixes(files: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """Partition filter on ``ext`` where the table has it."""
    return files.where(F.col("ext").isin(*suffixes)) if "ext" in files.columns else files


def prune_dirs(files: DataFrame, track: str = "general", extra: Iterable[str] = ()) -> DataFrame:
    """Drop files below an ignored directory."""
    return files.where(paths.pruned_dir(F.col("path"), ignored_dirs(track, extra)) == "")


def skip_symlinks(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_symlink"))


def with_language(files: DataFrame, extensions=fv.GENERAL_EXTENSIONS) -> DataFrame:
    """Tag the language and drop files whose suffix is not on the list."""
    tagged = only_suffixes(files, extensions).withColumn(
        "language", paths.language(F.col("path"), extensions)
    )
    return tagged.where(F.col("language").isNotNull())


def candidates(
    files: DataFrame, track: str = "general", extra: Iterable[str] = ()
) -> DataFrame:
    """Files a scan would read, decided on the path alone."""
    extensions = {".sol": "sol"} if track == "solidity" else fv.GENERAL_EXTENSIONS
    return with_language(skip_symlinks(prune_dirs(files, track, extra)), extensions)


def rule_sources(files: DataFrame) -> DataFrame:
    """Files the pattern rules look at: nothing is pruned, more languages."""
    return with_language(skip_symlinks(files), fv.RULE_EXTENSIONS)


def first_excluded(files: DataFrame, cap: int) -> DataFrame:
    """Projects over the cap with their first path beyond it."""
    return nth_smallest(files, "project", "path", cap + 1).withColumnRenamed(
        "path", "first_excluded"
    )


def tag_limit(files: DataFrame, cap: int) -> DataFrame:
    """Every file, with ``beyond_limit``: whether it is after the first ``cap`` files of its project by path."""
    beyond = F.coalesce(F.col("path") >= F.col("first_excluded"), F.lit(False))
    return (
        files.join(first_excluded(files, cap), "project", "left")
        .withColumn("beyond_limit", beyond)
        .drop("first_excluded")
    )


def _read_error(max_bytes: int | None) -> Column:
    bad = F.when(~F.is_valid_utf8(F.col("raw").cast("string")), "invalid_utf8")
    if max_bytes is None:
        return bad
    return F.when(F.octet_length("raw") > max_bytes, "file_too_large").otherwise(bad)


def decode_files(
    files: DataFrame, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into decoded files (``content``) and errors; one bad file stops nothing."""
    error = _read_error(max_bytes)
    ok = files.where(error.isNull()).withColumn("content", F.col("raw").cast("string"))
    errors = files.withColumn("error", error).where(F.col("error").isNotNull())
    return ok, errors.select("project", "path", "error")


def project_identifier(project: Column) -> Column:
    """SHA-256 of the project's absolute root."""
    return text.sha256(project)


def index_columns(files: DataFrame) -> DataFrame:
    """Decoded files -> index rows (hash and sizes of the normalised text)."""
    normal = files.withColumn("stripped_content", text.normalise(F.col("content")))
    return normal.select(
        "project",
        project_identifier(F.col("project")).alias("project_identifier"),
        F.col("path").alias("path_relative"),
        "language",
        text.sha256(F.col("stripped_content")).alias("hash"),
        "stripped_content",
        F.octet_length("raw").cast("bigint").alias("original_size"),
        F.octet_length("stripped_content").cast("bigint").alias("stripped_size"),
        paths.is_test(F.col("path")).alias("is_test_file"),
        paths.is_third_party(F.col("path")).alias("is_third_party"),
    )


def file_index(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """The general index, of every decodable file; ``tag_limit`` and ``truncation`` report the file limit."""
    return index_columns(decode_files(candidates(files, extra=extra))[0])


def solidity_sources(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Decoded Solidity files of any size; contents stay raw, the hash is over the raw bytes.

    A file above the size limit is only reported: ``file_too_large`` is a warning of ``decode_files``.
    """
    ok, _ = decode_files(candidates(files, "solidity", extra))
    return ok.withColumn("hash", F.sha2("raw", 256)).withColumn(
        "original_size", F.octet_length("raw").cast("bigint")
    )


def scan_summary(
    files: DataFrame, extra: Iterable[str] = (), cap: int = fv.GENERAL_MAX_FILES
) -> DataFrame:
    """Per project: indexed files, ignored entries, errors, bytes, and whether there are more files than ``cap``.

    A pruned directory counts once however many files it holds; symlinks and
    files with other suffixes count one each.  Contents are read of candidates only.
    """
    seen = skip_tags(files.select("project", "path", "is_symlink"), extra).groupBy("project").agg(
        (F.count_distinct(F.nullif("pruned", F.lit(""))) + F.count_if("ignored_file")).alias(
            "total_ignored"
        ),
    )
    bad = _read_error(None).isNotNull()
    read = (
        candidates(files, extra=extra)
        .select("project", bad.alias("bad"), F.octet_length("raw").cast("bigint").alias("bytes"))
        .groupBy("project")
        .agg(
            F.count_if(~F.col("bad")).alias("total_files"),
            F.count_if("bad").alias("total_errors"),
            F.sum(F.when(~F.col("bad"), F.col("bytes"))).alias("total_size_bytes"),
            (F.count("*") > cap).alias("truncated"),
        )
    )
    def known(name: str, default) -> Column:
        return F.coalesce(name, F.lit(default)).alias(name)
    return seen.join(read, "project", "left").select(
        "project", known("total_files", 0), "total_ignored", known("total_errors", 0),
        known("total_size_bytes", 0), known("truncated", False),
    )


def skip_tags(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Why a file is passed over: below a pruned directory, or ignored by itself."""
    known = paths.language(F.col("path")).isNotNull()
    return (
        files.withColumn("pruned", paths.pruned_dir(F.col("path"), ignored_dirs(extra=extra)))
        .withColumn("candidate", (F.col("pruned") == "") & ~F.col("is_symlink") & known)
        .withColumn("ignored_file", (F.col("pruned") == "") & (F.col("is_symlink") | ~known))
    )


def ignored_counts(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """``total_ignored`` with its two parts."""
    return (
        skip_tags(files.select("project", "path", "is_symlink"), extra)
        .groupBy("project")
        .agg(
            F.count_distinct(F.nullif("pruned", F.lit(""))).alias("ignored_dirs"),
            F.count_if("ignored_file").alias("ignored_files"),
        )
        .withColumn("total_ignored", F.col("ignored_dirs") + F.col("ignored_files"))
    )


def solidity_summary(
    files: DataFrame, extra: Iterable[str] = (), cap: int = fv.SOLIDITY_MAX_FILES
) -> DataFrame:
    """Solidity totals of every project that has at least one candidate.

    Files above the size limit are analysed like others and counted in ``total_too_large`` besides.
    """
    bad = _read_error(None).isNotNull()
    return (
        candidates(files, "solidity", extra)
        .select("project", bad.alias("bad"), (F.octet_length("raw") > fv.SOLIDITY_MAX_BYTES).alias("large"))
        .groupBy("project")
        .agg(
            F.count_if(~F.col("bad")).alias("total_files"),
            F.count_if("bad").alias("total_errors"),
            F.count_if("large").alias("total_too_large"),
            (F.count("*") > cap).alias("truncated"),
        )
    )


def truncation(files: DataFrame, cap: int) -> DataFrame:
    """Discovered files per project and whether they exceed the cap."""
    return (
        files.groupBy("project")
        .agg(F.count("*").alias("discovered"))
        .withColumn("truncated", F.col("discovered") > cap)
    )


def has_solidity(index: DataFrame) -> DataFrame:
    """Index rows of the projects that hold Solidity at all."""
    projects = index.where(F.col("language") == "sol").select("project").distinct()
    return index.join(projects, "project", "left_semi")
