"""One query per operator, over the corpus and the findings derived from the tables."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import findings as fn
from sourceassay.functions import paths, text
from sourceassay.functions.sizing import number_rows
from sourceassay.operators import contracts, corpus, dataflow, facts, json_contracts, report, rules, signatures, snapshots
from sourceassay.operators import solidity_index, structure
from sourceassay.plans import demo_corpus, demo_findings, demo_flows, demo_payloads
from sourceassay.session import ensure_checkpoint_dir, tune
from sourceassay.sources import documents, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2024-05-01T00:00:00Z"


def query(name: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(tune(spark), sf_dir))
        QUERIES[name] = run
        return f
    return register


class Tables:
    """The derived tables, each built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def files(self) -> DataFrame:
        return demo_corpus.source_files(self.spark, self.sf_dir)

    @property
    def paths(self) -> DataFrame:
        return self.files.select("project", "path", "is_symlink", "ext")

    @property
    def code(self) -> DataFrame:
        """Decoded files of every language the rules know."""
        return corpus.decode_files(corpus.rule_sources(self.files))[0]

    @property
    def script(self) -> DataFrame:
        return self.code.where(F.col("ext").isin(".js", ".ts", ".jsx", ".tsx"))

    @property
    def flow(self) -> dataflow.Flow:
        return dataflow.flow(demo_flows.flow_files(self.spark, self.sf_dir))

    @property
    def general(self) -> DataFrame:
        return corpus.decode_files(corpus.candidates(self.files))[0]

    @property
    def solidity(self) -> DataFrame:
        return corpus.solidity_sources(self.files)

    @property
    def index(self) -> DataFrame:
        return corpus.file_index(self.files)

    @property
    def records(self) -> DataFrame:
        return solidity_index.sol_files(self.solidity)

    @property
    def findings(self) -> DataFrame:
        return demo_findings.findings(self.spark, self.sf_dir)

    @property
    def manifests(self) -> DataFrame:
        return demo_findings.manifests(self.spark, self.sf_dir)

    @property
    def patches(self) -> DataFrame:
        return demo_findings.patches(self.spark, self.sf_dir)

    @property
    def valid(self) -> DataFrame:
        return contracts.valid_findings(self.manifests, self.findings)

    @property
    def functions(self) -> DataFrame:
        return structure.functions(self.solidity)

    def payloads(self, contract: str) -> DataFrame:
        """JSON documents of a contract."""
        return demo_payloads.payloads(self.spark, self.sf_dir, contract)

    @property
    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        rows = self.general.select("project", "path", F.sha2("raw", 256).alias("hash"))
        # the last digit of the content hash decides what happened to a file
        digit = F.right("hash", F.lit(1))
        previous = rows.where(~digit.isin("0", "1"))
        current = rows.where(~digit.isin("2", "3")).withColumn(
            "hash", F.when(digit.isin("4", "5"), F.reverse("hash")).otherwise(F.col("hash")))
        return previous, current


# --- sources ---------------------------------------------------------------------

#: disk that the files of one tree may take before they are walked, and the disk of a file besides its whole blocks: its inode and directories
_TREE_BYTES, _BLOCK, _FILE_BYTES = 4 << 30, 4096, 8192


@query("src_1_scan_corpus")
def _(t: Tables) -> DataFrame:
    """Write all files out as real ones in the shared folder, links as links, and walk them.

    Small files take far more disk than their contents, so a corpus that would take too much is dealt, by file, to several trees;
    each is written, walked and removed before the next one.
    """
    return scan_in_trees(t.files, hashlib.sha256(t.sf_dir.encode()).hexdigest()[:12])


def scan_in_trees(files: DataFrame, name: str, tree_bytes: int = _TREE_BYTES) -> DataFrame:
    """``project, path, size, is_symlink`` of what a walk finds of ``files``; at most about ``tree_bytes`` of trees lie on disk at a time."""
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    if not shared.startswith(("file:", "/")):
        raise ValueError("this query walks files: spark.checkpoint.dir has to be a mounted folder")
    base = f"{shared.removeprefix('file:')}/tree-{name}"
    files = files.select("project", "path", "raw", "is_symlink")
    size = F.when(F.col("is_symlink"), 0).otherwise(F.ceil(F.octet_length("raw") / _BLOCK) * _BLOCK) + _FILE_BYTES
    trees = -(-(files.agg(F.sum(size)).first()[0] or 0) // tree_bytes)
    if trees <= 1:
        if not os.path.exists(f"{base}.complete"):  # a tree that a lost driver left unfinished is written over
            _write_tree(files, base)
            open(f"{base}.complete", "w").close()
        return _walked(files, base)
    run = f"{shared}/trees-{uuid.uuid4().hex}"
    files.withColumn("tree", F.pmod(F.xxhash64("project", "path"), F.lit(trees))).write.partitionBy("tree").parquet(f"{run}/dealt")
    for tree in range(trees):
        if not os.path.exists(f"{run}/dealt/tree={tree}".removeprefix("file:")):
            continue  # no file was dealt to it
        own, place = spark.read.schema(files.schema).parquet(f"{run}/dealt/tree={tree}"), f"{run}/{tree}".removeprefix("file:")
        _write_tree(own, place)
        _walked(own, place).write.mode("append").parquet(f"{run}/walked")
        _remove_tree(own, place)
    return spark.read.schema("project string, path string, size bigint, is_symlink boolean").parquet(f"{run}/walked")


def _walked(files: DataFrame, base: str) -> DataFrame:
    roots = files.select("project").distinct().withColumn("root", F.concat(F.lit(base + "/"), "project"))
    found, _ = scan.scan_corpus(roots)
    return found.select("project", "path", F.octet_length("raw").cast("bigint").alias("size"), "is_symlink")


def _remove_tree(files: DataFrame, base: str) -> None:
    """Remove what ``_write_tree`` put below ``base``: first files, by the tasks that hold their rows, then the directories, by project."""
    def remove(batches):
        for batch in batches:
            for project, path in batch.itertuples(index=False):
                target = os.path.join(base, project, path)
                if os.path.lexists(target):
                    os.remove(target)
            yield batch[["project"]]

    def remove_directories(batches):
        for batch in batches:
            for project in batch["project"]:
                shutil.rmtree(os.path.join(base, project), ignore_errors=True)
            yield batch
    files.select("project", "path").mapInPandas(remove, "project string").write.format("noop").mode("overwrite").save()
    files.select("project").distinct().mapInPandas(remove_directories, "project string").write.format("noop").mode("overwrite").save()
    shutil.rmtree(base)


def _write_tree(files: DataFrame, base: str) -> None:
    def put(batches):
        own = uuid.uuid4().hex
        for batch in batches:
            made = set()  # at most one directory a row of the batch
            for project, path, raw, is_symlink in batch.itertuples(index=False):
                target = os.path.join(base, project, path)
                if (directory := os.path.dirname(target)) not in made:
                    os.makedirs(directory, exist_ok=True)
                    made.add(directory)
                # Put in place at once, so a task that runs again finds whole files.
                part = f"{target}.{own}"
                if is_symlink:
                    os.symlink("missing", part)
                else:
                    with open(part, "wb") as out:
                        out.write(raw)
                os.replace(part, target)
            yield batch[["project"]]
    files.mapInPandas(put, "project string").write.format("noop").mode("overwrite").save()


@query("src_2_scan_solidity")
def _(t):
    return corpus.candidates(t.paths, "solidity").select("project", "path")


@query("src_3_decode_files")
def _(t):
    ok, errors = corpus.decode_files(corpus.candidates(t.files))
    good = ok.select("project", "path", F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors)


@query("src_4_project_metadata")
def _(t):
    general = documents.project_metadata(t.files)
    named = documents.project_metadata(t.files, "solidity").select(
        "project", F.col("name").alias("solidity_name"))
    return general.join(named, "project")


@query("src_5_rule_results")
def _(t):
    docs = t.findings.select("project", F.concat(F.lit("/work/"), "project").alias("root"),
                             F.expr(demo_findings.RULE_RESULT))
    return documents.import_rule_results(docs)


@query("src_6_rule_catalogue")
def _(t):
    hits = rules.match_rules(t.code).groupBy("rule_id").agg(F.count("*").alias("hits"))
    catalogue = rules.rules(t.spark).select(
        "rule_id", "track", "vulnerability_class", "severity", "cwe", "owasp", "swc",
        F.concat_ws(",", "languages").alias("languages"), F.size("steps").alias("n_steps"))
    return catalogue.join(hits, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


@query("src_7_load_patches")
def _(t):
    responses = t.findings.select("project", F.col("idx").alias("seq"), F.expr(demo_findings.RESPONSE))
    return documents.load_patches(responses).select(
        "project", "finding_id", "patch", "explanation", F.col("pos.response").alias("response"),
        F.col("pos.nth").alias("nth"))


# --- filters and projections -------------------------------------------------------

@query("flt_1_prune_dirs")
def _(t):
    return corpus.prune_dirs(t.paths, extra=("contracts",)).select("project", "path")


@query("flt_2_language")
def _(t):
    return corpus.with_language(t.paths).select("project", "path", "language")


@query("flt_3_skip_symlinks")
def _(t):
    return corpus.skip_symlinks(t.paths).select("project", "path")


@query("flt_4_oversize")
def _(t):
    found = corpus.candidates(t.files, "solidity")
    _, errors = corpus.decode_files(found, fv.SOLIDITY_MAX_BYTES)
    return errors


@query("flt_5_is_test")
def _(t):
    path = F.col("path")
    return t.paths.select("project", "path", paths.is_test(path).alias("general"),
                          paths.is_test(path, "solidity").alias("solidity"))


@query("flt_6_is_third_party")
def _(t):
    path = F.col("path")
    return t.paths.select("project", "path", paths.is_third_party(path).alias("general"),
                          paths.is_third_party(path, "solidity").alias("solidity"))


@query("flt_7_relative_path")
def _(t):
    index = demo_findings.foreign_index(t.spark, t.sf_dir)
    path = F.col("path_relative")
    return index.select("project", "path_relative", paths.is_relative(path).alias("is_relative"))


@query("flt_8_leaked_path")
def _(t):
    return t.findings.where(paths.leaks_absolute_path(F.col("code_snippet"))).select("project", "idx", "code_snippet")


@query("flt_9_has_solidity")
def _(t):
    found = corpus.candidates(t.paths)
    return corpus.has_solidity(found).select("project", "path")


@query("flt_10_root_relative")
def _(t):
    absolute = F.concat_ws("/", F.when(F.length("path") % 3 != 0, F.concat(F.lit("/work/"), "project")), "path")
    return t.paths.select("project", absolute.alias("absolute")).select(
        "project", "absolute",
        paths.relative_to(F.col("absolute"), F.concat(F.lit("/work/"), "project")).alias("relative"))


@query("prj_1_web3_severity")
def _(t):
    return t.findings.select("project", "idx", fn.web3_severity(F.col("vulnerability_class")).alias("severity"))


@query("prj_2_abbreviation")
def _(t):
    cls = F.col("vulnerability_class")
    return t.findings.select("project", "idx", fn.class_abbreviation(cls).alias("abbreviation"),
                             fn.web3_abbreviation(cls).alias("web3_abbreviation"))


@query("prj_3_finding_id")
def _(t):
    seq = F.col("idx") - 50
    return t.findings.select("project", "idx", fn.finding_id(
        fn.class_abbreviation(F.col("vulnerability_class")), seq).alias("id"))


@query("prj_4_confidence")
def _(t):
    return t.findings.select("project", "idx", fn.confidence(F.col("confidence")).alias("confidence"))


@query("prj_5_web3_findings")
def _(t):
    return signatures.web3_findings(signatures.web3_matches(t.records).drop("snippet").withColumn(
        "snippet", F.lit(None).cast("string"))).select(
        "project", "file_path", "line_start", "line_end", "vulnerability_class", "severity",
        "code_snippet", "description", "fix_principle", "confidence", "false_positive_risk", "track")


@query("prj_6_report_projection")
def _(t):
    return report.build_report(t.findings, t.patches)


@query("prj_7_suggestion_path")
def _(t):
    wanted = F.when(F.col("idx") % 5 != 0, F.col("id"))
    return t.findings.select("project", "idx", paths.suggestion_path(F.col("file_path"), wanted).alias("suggestion"))


@query("prj_8_project_identifier")
def _(t):
    return t.paths.select("project").distinct().select(
        "project", corpus.project_identifier(F.col("project")).alias("project_identifier"))


@query("prj_9_hash_and_sizes")
def _(t):
    return t.index.select("project", "path_relative", "hash", "original_size", "stripped_size")


@query("prj_10_contract_fields")
def _(t):
    """Enumerated fields of the findings contract against the values in use."""
    fields = contracts.contract_fields(t.spark).where(F.col("allowed").isNotNull()).select(
        F.regexp_replace("field", r"^findings\.", "").alias("field"), "allowed")
    used = t.findings.unpivot([], ["severity", "vulnerability_class", "false_positive_risk"], "field", "value")
    counts = used.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(fields), "field").select(
        "field", "value", "n", F.array_contains("allowed", F.col("value")).alias("allowed"))


@query("prj_11_utc_iso")
def _(t):
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return events.select("event_id", text.utc_iso(F.col("ts")).alias("iso"))


# --- string functions ------------------------------------------------------------------

def _per_file(name: str, f: Callable[[Column], Column]) -> None:
    @query(name)
    def _(t):
        return t.general.select("project", "path", text.sha256(f(F.col("content"))).alias("hash"))


_per_file("str_1_strip_comments", text.strip_comments)
_per_file("str_2_collapse_blanks", text.collapse_blanks)
_per_file("str_3_strip_line_ends", text.strip_line_ends)
_per_file("str_4_squeeze_newlines", text.squeeze_newlines)


@query("str_5_explode_lines")
def _(t):
    return structure.explode_lines(t.general.select("project", "path", "content"))


@query("str_6_pragma_version")
def _(t):
    return facts.versions(t.solidity).select("project", "path", "solidity_version")


@query("str_7_is_08_plus")
def _(t):
    return facts.versions(t.solidity).select("project", "path", "is_solidity_08_plus")


# --- facts ---------------------------------------------------------------------------------

@query("ext_1_line_calls")
def _(t):
    return facts.line_facts(t.solidity, facts.call_fact)


@query("ext_2_statement_calls")
def _(t):
    return facts.statement_calls(t.solidity).drop("seq")


@query("ext_3_owner_modifiers")
def _(t):
    return facts.line_facts(t.solidity, facts.modifier_fact)


@query("ext_4_auth_requirements")
def _(t):
    return facts.auth_requirements(t.solidity)


@query("ext_5_tx_origin")
def _(t):
    return facts.line_facts(t.solidity, facts.tx_origin_fact)


@query("ext_6_oracle_uses")
def _(t):
    return facts.line_facts(t.solidity, facts.oracle_fact)


@query("ext_7_arithmetic_ops")
def _(t):
    return facts.arithmetic_ops(t.solidity)


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.concat_ws(";", a))
    return df


@query("ext_8_functions")
def _(t):
    return _joined(t.functions.drop("seq"), "modifiers", "parameters")


@query("ext_9_state_variables")
def _(t):
    return structure.state_variables(t.solidity)


@query("ext_10_modifiers")
def _(t):
    return _joined(structure.modifiers(t.functions), "parameters")


@query("ext_11_events")
def _(t):
    return _joined(structure.events(t.solidity), "parameters")


@query("ext_12_flash_loan_markers")
def _(t):
    return facts.flash_loan_markers(t.functions)


@query("ext_13_nested_record")
def _(t):
    arrays = ("functions", "state_variables", "modifiers", "events", "external_calls", "access_controls",
              "oracle_uses", "arithmetic_ops", "reentrancy_risk", "flash_loan_markers")
    return solidity_index.solidity_index(t.files).select(
        "project", "path_relative", "hash", "original_size", "is_test_file", "is_third_party",
        "solidity_version", "is_solidity_08_plus", *[F.size(a).alias(f"n_{a}") for a in arrays],
        F.concat_ws(",", F.transform("external_calls", lambda c: F.concat_ws(":", c.line, c.call_type))).alias("calls"),
        F.concat_ws(",", F.transform("reentrancy_risk", lambda r: F.concat_ws(
            ":", r.function, r.external_call_line, r.state_write_line))).alias("reentrancy"))


# --- joins -------------------------------------------------------------------------------------

@query("joi_1_calls_in_functions")
def _(t):
    spans = t.functions.select("project", "path", "name", "line_start", "line_end")
    calls = facts.external_calls(t.solidity).select("project", "path", "line", "call_type")
    return facts.calls_in_functions(spans, calls)


def _reentrancy(t: Tables, mode: str) -> DataFrame:
    return facts.reentrancy(t.functions, facts.external_calls(t.solidity), facts.state_writes(t.solidity, mode))


@query("joi_2_reentrancy")
def _(t):
    return _reentrancy(t, "compat")


@query("joi_2_reentrancy_indexed")
def _(t):
    return _reentrancy(t, "indexed")


@query("joi_3_report")
def _(t):
    return report.build_report(t.findings, t.patches).select("project", "idx", "id", "patch", "explanation")


@query("joi_4_unknown_files")
def _(t):
    found = t.findings.select(F.col("code_project").alias("project"), "file_path", "idx")
    index = corpus.candidates(t.paths).select("project", F.col("path").alias("path_relative"))
    return contracts.unknown_files(found, index)


@query("joi_5_diff_snapshots")
def _(t):
    return snapshots.diff_snapshots(*t.snapshots)


def _changed_directories(t: Tables) -> DataFrame:
    return snapshots.changed_directories(*map(snapshots.directory_digests, t.snapshots))


@query("joi_5_changed_directories")
def _(t):
    return _changed_directories(t)


@query("joi_5_changed_files")
def _(t):
    return snapshots.changed_files(*t.snapshots, _changed_directories(t))


def _applicable(t: Tables) -> DataFrame:
    """Patches of the findings of all manifests, valid or not."""
    rows = contracts.with_validity(report.build_report(t.findings, t.patches), contracts.check_contract_b(t.manifests, t.findings))
    owners = t.findings.select("project", "idx", "code_project")
    rows = rows.join(owners, ["project", "idx"]).drop("project").withColumnRenamed("code_project", "project")
    return report.applicable_patches(rows, corpus.skip_symlinks(t.paths))


@query("joi_6_applicable_patches")
def _(t):
    return _applicable(t).select("project", "idx", "id", "file_path", "patch", "is_valid")


@query("joi_7_external_calls")
def _(t):
    return facts.external_calls(t.solidity)


@query("joi_8_rule_sequences")
def _(t):
    several = tuple(r for r in rules.CATALOGUE if len(r.steps) > 1)
    return _rule_rows(rules.match_rules(t.code, several))


@query("joi_9_rule_scopes")
def _(t):
    scoped = tuple(r for r in rules.CATALOGUE if r.inside or r.not_inside or r.needs_guard)
    return _rule_rows(rules.match_rules(t.code, scoped))


@query("joi_10_rule_lookup")
def _(t):
    matches = rules.match_rules(t.code).select("rule_id", "project")
    table = rules.rules(t.spark).select("rule_id", "vulnerability_class", "cwe")
    rows = matches.join(F.broadcast(table), "rule_id")  # the catalogue has a fixed size
    cls = F.col("vulnerability_class")
    return rows.groupBy("vulnerability_class", "cwe").agg(F.count("*").alias("n")).select(
        "vulnerability_class", "cwe", "n", fn.promoted_severity(cls).alias("severity"),
        fn.class_abbreviation(cls).alias("abbreviation"))


@query("joi_11_splice")
def _(t):
    """Three patches for each finding, of which some overlap."""
    rows = _applicable(t).drop("is_valid").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({
        "line_start": F.col("line_start") + F.col("k"), "line_end": F.col("line_end") + 2 * F.col("k"),
        "id": F.concat("id", F.lit("-"), "k"), "patch": F.concat("patch", "k")})
    return report.splice(t.code, rows).select(
        "project", "path", text.sha256(F.col("content")).alias("hash"), "applied", "rejected")


# --- aggregations ------------------------------------------------------------------------------

@query("agg_1_scan_summary")
def _(t):
    return corpus.scan_summary(t.files)


@query("agg_2_total_ignored")
def _(t):
    return corpus.ignored_counts(t.files)


@query("agg_3_solidity_summary")
def _(t):
    return corpus.solidity_summary(t.files)


@query("agg_4_severity_counts")
def _(t):
    return report.severity_counts(t.findings)


@query("agg_5_first_call")
def _(t):
    return facts.first_calls(t.functions, facts.external_calls(t.solidity)).select(
        "project", "path", "function", "line_start", "external_call_line")


@query("agg_6_truncated")
def _(t):
    general = corpus.truncation(corpus.candidates(t.paths), fv.GENERAL_MAX_FILES)
    solidity = corpus.truncation(corpus.candidates(t.paths, "solidity"), fv.SOLIDITY_MAX_FILES)
    return general.join(solidity.select("project", F.col("discovered").alias("sol_discovered"),
                                        F.col("truncated").alias("sol_truncated")), "project", "left")


@query("agg_7_path_hash_map")
def _(t):
    return snapshots.path_hashes(t.index)


@query("agg_8_violation_counts")
def _(t):
    return contracts.violation_counts(contracts.check_contract_b(t.manifests, t.findings))


@query("agg_9_markdown")
def _(t):
    rows = report.build_report(t.valid, t.patches)
    return report.markdown_body(rows, rows.where(F.col("patch") != ""))


def _outcomes(t: Tables) -> DataFrame:
    heads = t.manifests
    b = contracts.check_contract_b(heads, t.findings).where(F.col("level") == "ERROR")
    return report.audit_outcomes(
        heads, heads.where(demo_findings.FAILURES["parse"]), heads.where(demo_findings.FAILURES["index"]),
        b, report.severity_counts(t.findings), heads.selectExpr("project", demo_findings.STATUS))


@query("agg_10_summary_line")
def _(t):
    return report.summary_lines(_outcomes(t).join(report.severity_counts(t.findings), "project", "left"), F.col("outcome"))


@query("agg_11_audit_outcomes")
def _(t):
    return _outcomes(t)


@query("agg_12_owner_rollup")
def _(t):
    return report.owner_rollup(t.findings)


# --- windows, sorts, limits, set operations --------------------------------------------------------

@query("win_1_cap_files")
def _(t):
    return corpus.tag_limit(corpus.candidates(t.paths, "solidity"), fv.SOLIDITY_MAX_FILES).select(
        "project", "path", "beyond_limit")


@query("win_2_finding_numbers")
def _(t):
    rows = t.findings.select("project", "file_path", "line_start", "vulnerability_class", "idx")
    return number_rows(rows, "project", ["file_path", "line_start", "vulnerability_class", "idx"], "seq")


@query("win_3_duplicate_ids")
def _(t):
    return contracts.duplicate_ids(t.findings)


@query("win_4_first_per_line")
def _(t):
    return facts.external_calls(t.solidity).select("project", "path", "line", "call_type")


@query("win_5_block_spans")
def _(t):
    return structure.inlined(structure.with_blocks(t.solidity), "blocks", "project", "path").select(
        "project", "path", "line_start", "line_end", "header")


@query("win_6_last_patch")
def _(t):
    return report.last_patches(t.patches)


@query("srt_1_sorted_index")
def _(t):
    return corpus.candidates(t.paths).select("project", "path").orderBy("project", "path")


@query("lim_1_text_limits")
def _(t):
    snippet = F.col("code_snippet")
    return t.findings.select("project", "idx", *[
        F.length(F.left(snippet, F.lit(n))).alias(f"at_{n}") for n in (200, 300, 400, 4096)])


@query("set_1_access_controls")
def _(t):
    return facts.access_controls(t.solidity)


@query("set_2_merge_findings")
def _(t):
    numbered = signatures.web3_findings(signatures.web3_matches(t.records))
    manifest = t.findings.select(F.col("code_project").alias("project"), "file_path", "line_start",
                                 "vulnerability_class", "severity")
    merged = report.merge_findings(manifest, numbered.select(
        "project", "file_path", "line_start", "vulnerability_class", "severity", "track"))
    return merged.select("project", "file_path", "line_start", "vulnerability_class", "severity", "track")


@query("set_3_call_detectors")
def _(t):
    calls = facts.external_calls(t.solidity)
    return calls.groupBy("call_type", F.when(F.col("callee") == "", "line").otherwise("statement").alias("detector")
                         ).agg(F.count("*").alias("n"))


# --- rules ------------------------------------------------------------------------------------------

def _rule_rows(matches: DataFrame) -> DataFrame:
    return matches.select("rule_id", "project", "file_path", "line_start", "line_end")


def _rule(number: int, rule: rules.Rule) -> None:
    @query(f"rul_{number:02d}_{rule.rule_id.replace('-', '_')}")
    def _(t):
        return _rule_rows(rules.match_rules(t.code, (rule,)))


for _number, _entry in enumerate(rules.CATALOGUE, 1):
    _rule(_number, _entry)


@query("rul_all")
def _(t):
    return _rule_rows(rules.match_rules(t.code))


# --- contract checks -----------------------------------------------------------------------------------

def _index_check(name: str, *codes: str) -> None:
    @query(name)
    def _(t):
        index = demo_findings.foreign_index(t.spark, t.sf_dir)
        projects = demo_findings.foreign_projects(t.spark, t.sf_dir)
        found = contracts.check_contract_a(projects, index)
        return found.where(F.col("rule").isin(*codes)).drop("message")


_index_check("val_a1_a2_file_count", "A-001", "A-002")
_index_check("val_a4_relative_path", "A-004")
_index_check("val_a5_language", "A-005")
_index_check("val_a6_project_identifier", "A-006")
_index_check("val_a7_truncated", "A-007")
_index_check("val_a8_hash_and_sizes", "A-008")


@query("val_a3_content")
def _(t):
    found = contracts.check_files(t.index).unionByName(
        contracts.check_files(demo_findings.foreign_index(t.spark, t.sf_dir)))
    return found.where(F.col("rule") == "A-003").drop("message")


@query("val_a9_valid_index")
def _(t):
    index = demo_findings.foreign_index(t.spark, t.sf_dir)
    projects = demo_findings.foreign_projects(t.spark, t.sf_dir)
    return contracts.verdicts(projects, contracts.check_contract_a(projects, index))


def _finding_check(name: str, *codes: str) -> None:
    @query(name)
    def _(t):
        return contracts.check_findings(t.findings).where(F.col("rule").isin(*codes)).drop("message")


_finding_check("val_b0_required", "B-000")
_finding_check("val_b2_lines", "B-002")
_finding_check("val_b3_snippet", "B-003")
_finding_check("val_b4_class", "B-004")
_finding_check("val_b5_confidence", "B-005")
_finding_check("val_b9_severity", "B-009")
_finding_check("val_b10_texts", "B-010")


def _index_paths(t: Tables) -> DataFrame:
    return corpus.candidates(t.paths).select("project", F.col("path").alias("path_relative"))


@query("val_b1_known_file")
def _(t):
    return contracts.check_known_files(t.findings, _index_paths(t), "code_project").drop("message")


@query("val_b1_verdicts")
def _(t):
    """Verdicts of the manifests with their files looked up."""
    found = contracts.check_contract_b(t.manifests, t.findings, _index_paths(t), "code_project")
    return contracts.verdicts(t.manifests, found)


@query("val_b7_ids")
def _(t):
    found = contracts.check_findings(t.findings).unionByName(contracts.duplicate_ids(t.findings))
    return found.where(F.col("rule") == "B-007").drop("message")


def _manifest_check(name: str, *codes: str) -> None:
    @query(name)
    def _(t):
        return contracts.check_manifests(t.manifests, t.findings).where(F.col("rule").isin(*codes)).drop("message")


_manifest_check("val_b6_count", "B-006")
_manifest_check("val_b8_tracks", "B-008")
_manifest_check("val_b11_header", "B-011")
_manifest_check("val_b12_metadata", "B-012")


@query("val_b13_request_metadata")
def _(t):
    return contracts.check_manifests(t.manifests, t.findings).unionByName(
        contracts.check_findings(t.findings)).where(F.col("rule") == "B-013").drop("message")


@query("val_b14_valid_manifest")
def _(t):
    return t.valid.select("project", "idx", "id", "confidence")


@query("val_json_a_problems")
def _(t):
    return json_contracts.check_payloads(t.payloads("A"), "A")


@query("val_json_b_problems")
def _(t):
    return json_contracts.check_payloads(t.payloads("B"), "B")


@query("val_json_verdicts")
def _(t):
    """Verdicts of the documents of both contracts."""
    def of(contract: str) -> DataFrame:
        rows = t.payloads(contract)
        return contracts.verdicts(rows, json_contracts.check_payloads(rows, contract)).withColumn("contract", F.lit(contract))
    return of("A").unionByName(of("B"))


@query("val_json_valid_findings")
def _(t):
    rows = t.payloads("B")
    return json_contracts.valid_findings(rows, json_contracts.check_payloads(rows, "B")).drop("related_finding_ids")


@query("val_json_unknown_keys")
def _(t):
    return json_contracts.unknown_keys(t.payloads("A"), "A").unionByName(json_contracts.unknown_keys(t.payloads("B"), "B"))


@query("prj_10_json_field_types")
def _(t):
    """JSON types in use per path against the type that the contract asks for."""
    used = [json_contracts.field_types(t.payloads(c), c).withColumn("contract", F.lit(c)) for c in ("A", "B")]
    wanted = contracts.contract_fields(t.spark).select("contract", F.col("field").alias("path"), F.col("type").alias("wanted"))
    return used[0].unionByName(used[1]).join(F.broadcast(wanted), ["contract", "path"], "left")


# --- signatures -----------------------------------------------------------------------------------------

_SIGNATURES = ("DOUBLE_SPEND", "BROKEN_AUTH", "BROKEN_ACCESS_CONTROL", "PRIVILEGE_ESCALATION",
               "UNCHECKED_EXTERNAL_CALL", "SETTLEMENT_BYPASS", "FINANCIAL_ACTION_ORDERING",
               "INVALID_STATE_TRANSITION", "MISSING_VALIDATION", "LOGIC_FLAW")
_WEB3_SIGNATURES = ("REENTRANCY", "TX_ORIGIN_ABUSE", "ARITHMETIC_OVERFLOW", "FLASH_LOAN_ORACLE_MANIPULATION",
                    "BROKEN_ACCESS_CONTROL", "UNCHECKED_EXTERNAL_CALL")


def _signature(number: int, name: str) -> None:
    @query(f"sig_{number}_{name.lower()}")
    def _(t):
        found = signatures.match_signatures(signatures.fn_nodes(signatures.worth_matching(t.script, name)))
        return found.where(F.col("vulnerability_class") == name).drop("snippet")


def _web3_signature(number: int, name: str) -> None:
    @query(f"sig_{number}_web3_{name.lower()}")
    def _(t):
        found = signatures.web3_matches(solidity_index.sol_files(signatures.worth_recording(t.solidity, name)), name)
        return found.where(F.col("vulnerability_class") == name).drop("snippet")


for _number, _name in enumerate(_SIGNATURES, 1):
    _signature(_number, _name)
for _number, _name in enumerate(_WEB3_SIGNATURES, 12):
    _web3_signature(_number, _name)


@query("sig_3_flow_broken_access_control")
def _(t):
    return dataflow.broken_access_control(t.flow)


@query("sig_5_flow_unchecked_external_call")
def _(t):
    return dataflow.unchecked_external_call(t.flow)


@query("sig_9_flow_missing_validation")
def _(t):
    return dataflow.missing_validation(t.flow)


@query("sig_0_fn_nodes")
def _(t):
    return signatures.fn_nodes(t.script).select("project", "path", "fn", "line", "kind", "target", "op")


@query("sig_11_slippage_omission")
def _(t):
    return signatures.slippage_omissions(t.code)


# --- sinks --------------------------------------------------------------------------------------------------

@query("snk_1_report_json")
def _(t):
    rows = report.build_report(t.valid, t.patches)
    accepted = contracts.valid_rows(t.manifests, contracts.check_contract_b(t.manifests, t.findings))
    return report.report_json(report.reports(rows, accepted, F.lit(AS_OF)))


@query("snk_2_snapshot")
def _(t):
    ensure_checkpoint_dir(t.spark)
    name = hashlib.sha256(t.sf_dir.encode()).hexdigest()[:12]
    location = f"{t.spark.sparkContext.getCheckpointDir()}/snapshots-{name}"
    snapshots.write_snapshot(t.index, location, "2024-05-01")
    return snapshots.read_snapshot(t.spark, location).select("project", "project_hash", "last_scan", "path", "hash")


@query("snk_3_suggestions")
def _(t):
    return report.suggestions(_applicable(t))


# --- the whole audit ----------------------------------------------------------------------------------------

@query("audit_index_by_language")
def index_by_language(t: Tables) -> DataFrame:
    """Files, bytes and bytes saved by normalising, per project and language."""
    return t.index.groupBy("project", "language").agg(
        F.count("*").alias("files"), F.sum("original_size").alias("original_bytes"),
        F.sum("stripped_size").alias("stripped_bytes"),
        F.sum(F.col("original_size") - F.col("stripped_size")).alias("saved_bytes"))
