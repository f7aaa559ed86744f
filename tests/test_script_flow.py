"""Script files are read and followed in their own rows."""

from pyspark.sql import functions as F

from sourceassay.operators import dataflow, script_flow, structure

TRICKY = {
    "plain.js": "async function f(req, a) {\n  const x = req.body.sum;\n  a.balance -= x;\n}\n",
    "literals.js": "let s = 'a;{b'; let t = \"(\\\"\"; let u = `x;\n}`; f(s);\nlet r = s.replace(/[;{/]\\//g, '('); let q = x / 2; let p = y / 3;\n",
    "comments.ts": "// f(1); {\nf(/* ; { */ 2);\n/* a\n b */ g(3); h(\n  4,\n  5);\n",
    "objects.jsx": "const a = { b: 1, c: { d: [2, { e: 3 }] } };\nreturn { a };\nf({ x: 1 });\nif (a) { b = 2 }\n",
    "loops.js": "for (let i = 0; i < 3; i++) { f(i); }\nfor (const k in o) {\n g(k)\n}\nx = 1\n  + 2\n  .c(3)\ny =\n 4\n",
    "shapes.js": "class A {\n async run(a, b) {\n  return a\n }\n get(x) { return x; }\n}\nconst go = async (p) => {\n q(p);\n};\nmap(z => {\n w(z);\n});\nnames: function (v) { u(v); }\n",
    "broken.js": "}\n}\nfunction f(a) {\n if (a) {\n  b(a);\n",
    "marks.js": "a\x01 = b\x02(\x03c);\r\n\td = 'é\x05';\re = f( g)  \n\fh(i);\u0085\n",
    "words.js": "éif (a) { b = 1; }\nreturné = 2;\nif (ß) { c(1); }\n$x.$y = z\n",
    "empty.js": "",
}


def test_statements_are_those_of_the_table(code):
    files = code(TRICKY)
    rows = structure.statements(files, wanted=lambda p: p.rlike(r"[=(]|\breturn\b"), scoped=True).select(
        "path", "seq", "line", F.size("inside").alias("depth"), F.col("own_end").isNotNull().alias("opens"), "text").collect()
    want = sorted((r.path, r.seq, r.line) for r in rows)
    got = sorted((path, s.seq, s.line) for path, text in TRICKY.items() for s in script_flow.statements(text))
    assert got == want and len(want) > 40
    texts = {(path, i): script_flow._text(p) for path, text in TRICKY.items() for i, p in enumerate(script_flow._pieces(text))}
    assert {(r.path, r.seq): r.text for r in rows} == {k: texts[k] for k in {(r.path, r.seq) for r in rows}}


def test_functions_are_those_of_the_table(code):
    rows = structure.statements(code(TRICKY), wanted=lambda p: p.rlike(r"[=(]|\breturn\b"), scoped=True).select(
        "path", "seq", F.filter("inside", lambda b: b["is_function"])["open_seq"].alias("functions")).collect()
    named = {path: {s.seq for s in script_flow.statements(text) if s.head} for path, text in TRICKY.items()}
    want = {(r.path, r.seq): max((f for f in r.functions if f in named[r.path]), default=-1) for r in rows}
    assert {(path, s.seq): s.fn_seq for path, text in TRICKY.items() for s in script_flow.statements(text)} == want


def test_only_matches_are_shuffled(spark, code):
    files = code({"a.js": TRICKY["plain.js"]})
    spark.sparkContext.setJobGroup("flow-plans", "")
    found = [f(dataflow.flow(files)) for f in (dataflow.missing_validation, dataflow.unchecked_external_call, dataflow.broken_access_control)]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("flow-plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs  # no table of reads or edges is written on the way
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    assert [(r.line_start, r.line_end, r.field) for r in found[0].collect()] == [(2, 3, "sum")]
