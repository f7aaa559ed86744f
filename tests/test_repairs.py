"""Cases that the derived corpus does not hold."""

from pyspark.sql import functions as F

from sourceassay.operators import corpus, report, rules, signatures, solidity_index, structure

CHARGE = """
async function pay(user, req) {
  user.balance -= req.body.amount;
}
"""


def found(code, files):
    return sorted((r.file_path, r.rule_id, r.line_start) for r in rules.match_rules(code(files)).collect())


def test_apostrophes_in_markup_hide_nothing(spark, code):
    plain = found(code, {"a.jsx": CHARGE})
    around = found(code, {"a.jsx": "<p>Don't</p>" + CHARGE + "<p>can't</p>\n"})
    assert plain and around == plain


def test_regex_literals_are_literals(spark, code):
    plain = found(code, {"a.js": CHARGE})
    assert found(code, {"a.js": "const q = /[\"'{]/g; f(/it's {/);" + CHARGE}) == plain


def test_require_targets_and_arrow_names(spark, code):
    files = code({"a.js": "const pay = async (amount, user) => {\n  require(amount > 0);\n  user.balance -= amount;\n}\n"})
    nodes = signatures.fn_nodes(files).collect()
    assert {n.fn for n in nodes} == {"pay"}
    assert [(n.target, n.op) for n in nodes if n.kind == "validation"] == [("amount", ">")]


def test_nodes_of_files_without_a_mutation(spark, code):
    files = code({"a.js": "async function f(s) {\n  if (!session) { return; }\n  await load(s);\n}\n"})
    assert {n.kind for n in signatures.fn_nodes(files).collect()} >= {"auth", "external_call"}
    assert signatures.worth_matching(files).count() == 0


def test_patches_overlap_the_last_accepted_one(spark):
    rows = [("p", "f", 2, 3, "a", "A"), ("p", "f", 3, 6, "b", "B"), ("p", "f", 5, 7, "c", "C")]
    patches = spark.createDataFrame(rows, "project string, file_path string, line_start int, line_end int, id string, patch string")
    files = spark.createDataFrame([("p", "f", "\n".join("123456789"))], "project string, path string, content string")
    got = report.splice(files, patches).first()
    assert (got.applied, got.rejected, got.content) == (2, 1, "1\nA\n4\nC\n8\n9")


def test_large_and_long_texts_are_analysed(spark):
    call = "    " + "x" * 400 + " = target.call{value: v}(data);"
    body = "pragma solidity ^0.7.0;\ncontract C {\n  function f() public {\n" + call + "\n  }\n}\n// " + "y" * (3 << 20)
    files = spark.createDataFrame([("p", "c.sol", bytearray(body.encode()), False)], "project string, path string, raw binary, is_symlink boolean")
    record = solidity_index.solidity_index(files).first()
    assert record.original_size > 2 << 20 and record.external_calls[0].text == call.strip()
    assert corpus.solidity_summary(files).first().total_too_large == 1
    # the result of the call is assigned, although behind character 300
    dropped = signatures.web3_matches(solidity_index.solidity_index(files)).where("vulnerability_class = 'UNCHECKED_EXTERNAL_CALL'")
    assert dropped.count() == 0


def test_reports_of_clean_manifests(spark):
    manifests = spark.createDataFrame([("p", "h1"), ("q", "h2")], "project string, project_hash string")
    rows = spark.createDataFrame([("p", 0, "i", "f", 1, 2, "c", "HIGH", "d", "", "")],
                                 "project string, idx int, id string, file_path string, line_start int, line_end int, vulnerability_class string,"
                                 "severity string, description string, patch string, explanation string")
    got = {r.project: r for r in report.reports(rows, manifests, F.lit("now")).collect()}
    assert got["q"].status == "NO_FINDINGS" and got["q"].findings == [] and got["q"].summary.total_findings == 0
    assert got["p"].status == "OK" and got["p"].summary.high == 1


def test_report_files(spark, tmp_path):
    manifests = spark.createDataFrame([("q", "h2")], "project string, project_hash string")
    rows = spark.createDataFrame([], "project string, idx int, id string, file_path string, line_start int, line_end int, vulnerability_class string,"
                                     "severity string, description string, patch string, explanation string")
    report.write_reports(report.reports(rows, manifests, F.lit("now")), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).first()
    assert got.project_hash == "h2" and '"status":"NO_FINDINGS"' in got.value


def test_statement_texts(spark, code):
    rows = structure.statements(code({"a.js": "let s = 'a;b';\nlet r = x / 2; let q = y / 3;\n"})).collect()
    assert [r.text for r in rows] == ["let s = 'a;b';", "let r = x / 2;", "let q = y / 3;"]


def test_patches_are_chosen_like_one_walk_over_them(spark):
    """Many random patches, some without a range, on two files, against a loop; a file takes any number of them."""
    import random
    draw = random.Random(6)
    lines = {"a.js": [f"a{k}" for k in range(9_000)], "b.js": ["one", "two"]}
    patches = []
    for n in range(4_000):
        start = draw.choice([draw.randint(-1, 9_100), None])
        patches.append(("p", draw.choice(["a.js", "a.js", "b.js"]), start, None if start is None else start + draw.randint(-1, 4), f"id{n}", f"new{n}\nmore"))
    files = spark.createDataFrame([("p", f, "\n".join(x)) for f, x in lines.items()], "project string, path string, content string")
    rows = spark.createDataFrame(patches, "project string, file_path string, line_start int, line_end int, id string, patch string")
    got = {r.path: r for r in report.splice(files, rows).collect()}
    for name, old in lines.items():
        end, new, applied, all_ = 0, [], 0, [p for p in patches if p[1] == name]
        for _, _, first, last, _, patch in sorted(all_, key=lambda p: (p[2] is not None, p[2] or 0, p[4])):
            if first is not None and max(end, 0) < first <= last:
                new += old[end:first - 1] + patch.split("\n")
                end, applied = last, applied + 1
        assert got[name].content == "\n".join(new + old[end:])
        assert (got[name].applied, got[name].rejected) == (applied, len(all_) - applied)


def test_files_outside_the_index_are_violations(spark):
    from sourceassay.operators import contracts
    findings = spark.createDataFrame([("m", "1", "x.js", "code"), ("m", "2", "y.js", "code"), ("n", "3", "x.js", "code")],
                                     "project string, idx string, file_path string, owner string")
    index = spark.createDataFrame([("code", "x.js")], "project string, path_relative string")
    found = contracts.check_known_files(findings, index, "owner")
    assert [(r.project, r.entity, r.idx, r.field, r.rule, r.level) for r in found.collect()] == [("m", "finding", "2", "file_path", "B-001", "ERROR")]
    heads = spark.createDataFrame([("m",), ("n",)], "project string")
    assert {r.project: r.is_valid for r in contracts.verdicts(heads, found).collect()} == {"m": False, "n": True}
    assert {r.idx: r.is_valid for r in contracts.with_validity(findings, found).collect()} == {"1": False, "2": False, "3": True}
