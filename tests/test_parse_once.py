"""Files are read once, and only where every word is there that a match needs."""

from dataclasses import replace

from pyspark.sql import functions as F

from sourceassay.functions.sizing import number_rows
from sourceassay.operators import rules, signatures, structure
from sourceassay.plans import demo_corpus

SOL = "contract C {\n    function f() external {\n        if (a) { b(); }\n    }\n}\n"


def _folds(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


def test_blocks_come_out_of_one_reading(code):
    rows = structure.with_blocks(code({"a.sol": SOL, "b.sol": ""}))
    found = structure.inlined(rows, "blocks", "path")
    assert _folds(found) == _folds(rows)
    assert sorted(found.collect()) == sorted(rows.select("path", F.inline("blocks")).collect())
    assert found.where("path = 'a.sol'").count() == 3


def test_signatures_are_put_together_once(code):
    grouped = signatures.match_signatures(signatures.fn_nodes(code({"a.js": "function f(a) { a.balance = 0; }"})))
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert "size(flatten" not in plan and {r.vulnerability_class for r in grouped.collect()} == {
        "BROKEN_AUTH", "BROKEN_ACCESS_CONTROL", "LOGIC_FLAW"}


def _scripts(*scenario_lists):
    bodies = [lines for scenarios in scenario_lists for _, lines in scenarios]
    return {f"f{i}.js": "async function f(req, acct) {\n" + "\n".join(lines) + "\n}\n" for i, lines in enumerate(bodies)}


def test_words_of_a_signature_lose_no_match(code):
    files = code(_scripts(demo_corpus.JS_SCENARIOS))
    whole = {}
    for row in signatures.match_signatures(signatures.fn_nodes(files)).collect():
        whole.setdefault(row.vulnerability_class, []).append(row)
    assert set(whole) == set(signatures.NEEDED)
    worth = None
    for name in signatures.NEEDED:
        found = signatures.match_signatures(signatures.fn_nodes(signatures.worth_matching(files, name))).withColumn("asked", F.lit(name))
        worth = found if worth is None else worth.unionByName(found)
    part = {}
    for row in worth.where("asked = vulnerability_class").drop("asked").collect():
        part.setdefault(row.vulnerability_class, []).append(row)
    assert {k: sorted(v) for k, v in part.items()} == {k: sorted(v) for k, v in whole.items()}


def test_files_without_a_needed_word_are_not_read(code):
    files = code({"a.js": "function f(a) { a.balance -= 1; }", "b.js": "async function f(a) { if (a.balance < 1) { return; } await b(); a.balance -= 1; }"})
    assert [r.path for r in signatures.worth_matching(files, "DOUBLE_SPEND").collect()] == ["b.js"]
    race = tuple(r for r in rules.CATALOGUE if r.rule_id == "web2-double-spend-race")
    assert {r.path for r in rules.tagged_statements(files, race).collect()} == {"b.js"}


def test_words_of_a_rule_stand_in_every_match(code):
    texts = _scripts(demo_corpus.JS_SCENARIOS)
    for kind, scenarios, head, tail in ((".sol", demo_corpus.SOL_SCENARIOS, "contract C {\n%s\n", "\n}\n}\n"),
                                        (".py", demo_corpus.PY_SCENARIOS, "async def f(self, req):\n", "\n"),
                                        (".mq5", demo_corpus.MQ_SCENARIOS, "void f() {\n", "\n}\n")):
        indent = "    " if kind == ".py" else ""
        for i, (header, lines) in enumerate(scenarios):
            top = head % (header or "function f(address to, uint amount) external {") if "%" in head else head
            texts[f"f{i}{kind}"] = top + "\n".join(indent + x for x in lines) + tail
    wordless = tuple(replace(r, words=()) for r in rules.CATALOGUE)
    assert sorted(rules.match_rules(code(texts)).collect()) == sorted(rules.match_rules(code(texts), wordless).collect())


def test_numbers_follow_from_rows_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    rows = spark.range(1000, numPartitions=4).selectExpr("id % 3 AS g", "id").mapInPandas(look, "g long, id long")
    found = number_rows(rows, "g", ["id"], "seq").collect()
    assert all(r.seq == r.id // 3 + 1 for r in found) and len(found) == 1000
    assert seen.value == 1000
