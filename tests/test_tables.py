import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions.sizing import nth_smallest, number_rows
from sourceassay.operators import contracts, corpus, report, snapshots
from sourceassay.sources import documents, scan
from sourceassay.streaming import incremental


def test_number_rows_equals_row_number_on_a_hot_group(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'g' || id % 50 END AS g",
                                          "hash(id) AS o", "id").repartition(16)
    got = number_rows(rows, "g", ["o", "id"], "n")
    want = rows.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY o, id) AS n")
    assert got.count() == 20_000 and got.select("g", "o", "id", "n").exceptAll(want).count() == 0


def test_nth_smallest(spark):
    rows = spark.range(1000).selectExpr("'g' || id % 3 AS g", "lpad(id, 5, '0') AS o")
    got = {r.g: r.o for r in nth_smallest(rows, "g", "o", 11, salts=4).collect()}
    assert got == {"g0": "00030", "g1": "00031", "g2": "00032"}
    assert nth_smallest(rows, "g", "o", 400).count() == 0


def test_cap_is_exact_and_lexicographic(spark):
    rows = spark.createDataFrame([("p", f"f{i}.js") for i in range(25)] + [("q", "a.js")], "project string, path string")
    kept = [r.path for r in corpus.tag_limit(rows, 3).where("project = 'p' AND NOT beyond_limit").collect()]
    assert sorted(kept) == ["f0.js", "f1.js", "f10.js"]
    assert corpus.tag_limit(rows, 3).where("project = 'q' AND NOT beyond_limit").count() == 1


def test_index_and_hashes(spark):
    rows = spark.createDataFrame(
        [("p", "a.sol", bytearray(b"x = 1; // c"), False), ("p", "b.js", bytearray(b"\xff"), False),
         ("p", "dist/c.js", bytearray(b"1"), False), ("p", "d.js", bytearray(b"2"), True), ("p", "e.md", bytearray(b""), False)],
        "project string, path string, raw binary, is_symlink boolean")
    index = corpus.file_index(rows).collect()
    assert [(r.path_relative, r.stripped_content, r.original_size, r.stripped_size) for r in index] == [("a.sol", "x = 1;", 11, 6)]
    raw_hash = corpus.solidity_sources(rows).select("hash").first()[0]
    assert raw_hash != index[0].hash
    summary = corpus.scan_summary(rows).first()
    assert (summary.total_files, summary.total_ignored, summary.total_errors, summary.total_size_bytes) == (1, 3, 1, 11)


def finding(**over):
    row = dict(project="m", idx=0, id="FSA-BAUTH-001", file_path="a.js", line_start=1, line_end=2,
               vulnerability_class="BROKEN_AUTH", severity="HIGH", code_snippet="x", description="d",
               fix_principle="f", confidence=0.5, false_positive_risk=None, related_finding_ids=None)
    row.update(over)
    return row


_FINDING = ("project string, idx bigint, id string, file_path string, line_start int, line_end int, "
            "vulnerability_class string, severity string, code_snippet string, description string, "
            "fix_principle string, confidence double, false_positive_risk string, related_finding_ids array<string>")


def table(spark, rows):
    names = [c.split()[0] for c in _FINDING.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _FINDING)


@pytest.mark.parametrize("over, field, rule", [
    (dict(id=None), "id", "B-000"), (dict(id="FSA-X-1"), "id", "B-007"), (dict(line_start=0), "line_start", "B-002"),
    (dict(line_end=0), "line_end", "B-002"), (dict(vulnerability_class="X"), "vulnerability_class", "B-004"),
    (dict(severity="high"), "severity", "B-009"), (dict(code_snippet="x" * 4097), "code_snippet", "B-003"),
    (dict(code_snippet="D:\\x"), "code_snippet", "B-003"), (dict(description=""), "description", "B-010"),
    (dict(fix_principle="f" * 501), "fix_principle", "B-010"), (dict(confidence=1.01), "confidence", "B-005"),
    (dict(confidence=float("nan")), "confidence", "B-005"), (dict(false_positive_risk="NO"), "false_positive_risk", "B-009"),
    (dict(related_finding_ids=[None]), "related_finding_ids", "B-013"), (dict(file_path=""), "file_path", "B-010"),
    (dict(id="FSA-BAUTH-001\n"), "id", "B-007"),
])
def test_finding_checks(spark, over, field, rule):
    assert (field, rule) in [(v.field, v.rule) for v in contracts.check_findings(table(spark, [finding(**over)])).collect()]


def test_good_finding_has_no_violation(spark):
    good = table(spark, [finding(), finding(confidence=None, idx=1, id="FSA-SLIP-1000")])
    assert contracts.check_findings(good).count() == 0 and contracts.duplicate_ids(good).count() == 0


def test_duplicates_are_the_later_uses(spark):
    rows = table(spark, [finding(idx=i) for i in (5, 2, 9)] + [finding(idx=1, id="bad"), finding(idx=0, id="bad")])
    assert sorted(r.idx for r in contracts.duplicate_ids(rows).collect()) == ["5", "9"]


def test_too_many_files(spark):
    index = spark.range(fv.GENERAL_MAX_FILES + 1).selectExpr("'p' AS project", "'f' || id AS path_relative")
    projects = spark.createDataFrame([("p", "a" * 64, False), ("q", "A" * 64, True)],
                                     "project string, project_identifier string, truncated boolean")
    got = {(v.project, v.rule, v.level) for v in contracts.check_index(projects, index).collect()}
    assert got == {("p", "A-002", "ERROR"), ("q", "A-006", "ERROR"), ("q", "A-001", "ERROR"), ("q", "A-007", "WARN")}


def test_report_takes_the_last_patch_whatever_the_order(spark):
    patches = spark.createDataFrame([("m", "FSA-BAUTH-001", f"p{i}", "e", i) for i in range(9)],
                                    "project string, finding_id string, patch string, explanation string, pos int")
    for shuffled in (patches, patches.orderBy(F.rand(3))):
        row = report.build_report(table(spark, [finding()]), shuffled).first()
        assert row.patch == "p8"


def test_splice_rejects_overlaps(spark):
    files = spark.createDataFrame([("m", "a.js", "1\n2\n3\n4\n5")], "project string, path string, content string")
    rows = [finding(line_start=2, line_end=3, id="A"), finding(line_start=3, line_end=4, id="B"), finding(line_start=5, line_end=5, id="C")]
    patched = table(spark, rows).withColumn("patch", F.concat(F.lit("x\n"), "id"))
    got = report.splice(files, patched).first()
    assert (got.content, got.applied, got.rejected) == ("1\nx\nA\n4\nx\nC", 2, 1)


def test_unknown_severity_only_counts_in_the_total(spark):
    got = report.severity_counts(table(spark, [finding(severity="UNKNOWN"), finding(severity="low")])).first()
    assert (got.total_findings, got.critical, got.high, got.medium, got.low) == (2, 0, 0, 0, 1)


def test_diff(spark):
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "1"), ("p", "c", "1")], "project string, path string, hash string")
    new = spark.createDataFrame([("p", "b", "1"), ("p", "c", "2"), ("p", "d", "1")], "project string, path string, hash string")
    assert {r.path: r.status for r in snapshots.diff_snapshots(old, new).collect()} == {
        "a": "removed", "b": "unchanged", "c": "modified", "d": "added"}


def test_snapshot_keeps_the_latest_scan(spark, tmp_path):
    index = lambda h: spark.createDataFrame([("p", "id", "a.js", h)], "project string, project_identifier string, path_relative string, hash string")
    snapshots.write_snapshot(index("1"), str(tmp_path / "s"), "2024-01-01")
    snapshots.write_snapshot(index("2"), str(tmp_path / "s"), "2024-01-02")
    assert [r.hash for r in snapshots.read_snapshot(spark, str(tmp_path / "s")).collect()] == ["2"]


def test_path_hashes_are_rows(spark):
    index = spark.range(25_000).selectExpr("'p' AS project", "concat('f', id) AS path_relative", "sha2(string(id), 256) AS hash")
    rows = snapshots.path_hashes(index)
    assert rows.columns == ["project", "path", "hash"] and rows.count() == 25_000


def test_metadata(spark):
    rows = spark.createDataFrame(
        [("p", "package.json", bytearray(b'{"name": "x", "version": "1"}'), False), ("p", "foundry.toml", bytearray(b""), False),
         ("q", "package.json", bytearray(b'{"name": "y", '), False), ("r", "foundry.toml", bytearray(b""), False)],
        "project string, path string, raw binary, is_symlink boolean")
    general = {r.project: (r.name, r.version) for r in documents.project_metadata(rows).collect()}
    assert general == {"p": ("x", "1"), "q": (None, None), "r": (None, None)}
    assert {r.project: r.name for r in documents.project_metadata(rows, "solidity").collect()} == {
        "p": "x", "q": None, "r": "foundry.toml"}


def test_scan_skips_links_and_splits_large_trees(spark, tmp_path):
    for n in range(30):
        (tmp_path / "p" / f"d{n}").mkdir(parents=True)
        (tmp_path / "p" / f"d{n}" / "a.js").write_text(str(n))
    (tmp_path / "p" / "node_modules").mkdir()
    (tmp_path / "p" / "node_modules" / "x.js").write_text("x")
    os.symlink(tmp_path / "p" / "d1" / "a.js", tmp_path / "p" / "link.js")
    roots = spark.createDataFrame([("p", str(tmp_path / "p")), ("gone", str(tmp_path / "gone"))], "project string, root string")
    files, errors = scan.scan_corpus(roots, budget=5)
    rows = files.collect()
    assert sum(not r.is_symlink for r in rows) == 30 and [r.path for r in rows if r.is_symlink] == ["link.js"]
    assert [r.project for r in errors.collect()] == ["gone"]


def test_scan_lists_a_large_directory_in_pieces(spark, tmp_path):
    (tmp_path / "p" / "flat").mkdir(parents=True)
    for n in range(35):
        (tmp_path / "p" / "flat" / f"{n}.bin").write_bytes(b"\xff\x00")
        (tmp_path / "p" / "flat" / f"d{n}").mkdir()
        (tmp_path / "p" / "flat" / f"d{n}" / "a").write_text("x")
    start = pd.DataFrame([("p", str(tmp_path / "p"), "")], columns=["project", "root", "path"])
    pieces = list(scan._lister(frozenset(), 10)(iter([start])))
    assert max(map(len, pieces)) <= 10 and sum((p.kind == "file").sum() for p in pieces) >= 10
    roots = spark.createDataFrame([("p", str(tmp_path / "p"))], "project string, root string")
    files, errors = scan.scan_corpus(roots, budget=10)
    want = {f"flat/{n}.bin": b"\xff\x00" for n in range(35)} | {f"flat/d{n}/a": b"x" for n in range(35)}
    assert {r.path: bytes(r.raw) for r in files.collect()} == want and errors.isEmpty()


def test_incremental_changes(spark, tmp_path):
    schema = "project string, path string, raw binary, is_symlink boolean"
    source, place = str(tmp_path / "in"), lambda n: str(tmp_path / n)
    seen = []
    for rows in ([("p", "a.js", bytearray(b"1"), False), ("p", "b.js", bytearray(b"1"), False)],
                 [("p", "a.js", bytearray(b"2"), False), ("p", "b.js", bytearray(b"1"), False), ("p", "c.js", bytearray(b"1"), False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.detect_changes(stream, place("store"), place("changes"), place("ck")).awaitTermination()
        found = spark.read.parquet(place("changes"))
        last = found.agg(F.max("batch")).first()[0]
        seen.append({r.path: r.status for r in found.where(F.col("batch") == last).collect()})
    assert seen == [{"a.js": "added", "b.js": "added"}, {"a.js": "modified", "b.js": "unchanged", "c.js": "added"}]
