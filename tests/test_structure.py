import random

from pyspark.sql import functions as F

from sourceassay.operators import facts, solidity_index, structure


def test_statements_and_lines(code):
    files = code({
        "a.js": 'app.post("/x;", async (req) => {\n  const r = await pay({a: 1,\n b: {c: 2}})\n  for (let i=0;i<2;i++) {\n'
                " x = `;{`;\n }\n  if (a) { return; } else { b() }\n})\n",
        "b.py": "x = 1\nasync def f(self,\n   b):\n    if a:\n        y = foo(1,\n   [2,\n 3])\n    z = 3 # c {\nq = \"a;{\"\n",
    })
    rows = structure.statements(files).orderBy("path", "seq").collect()
    js = [(r.line, r.text) for r in rows if r.path == "a.js"]
    assert js[:4] == [(1, 'app.post("/x;", async (req) => {'), (2, "const r = await pay({a: 1,  b: {c: 2}})"),
                      (4, "for (let i=0;i<2;i++) {"), (5, "x = `;{`;")]
    py = [(r.line, r.last_line, r.text) for r in rows if r.path == "b.py"]
    assert py[1][:2] == (2, 3) and py[3] == (5, 7, "y = foo(1,    [2,  3])") and py[-1][2] == 'q = "a;{"'
    spans = structure.with_blocks(files).where("path = 'b.py'").select(F.inline("blocks")).collect()
    assert {(b.line_start, b.line_end) for b in spans} == {(2, 8), (4, 7)}


def brace_spans(source):
    stack, spans = [], []
    for n, line in enumerate(source.split("\n"), 1):
        for c in line:
            if c == "{":
                stack.append(n)
            elif c == "}" and stack:
                spans.append((stack.pop(), n))
    return sorted(spans + [(s, None) for s in stack], key=str)


def test_blocks_equal_brace_counter(code):
    rng = random.Random(11)
    texts = {}
    for i in range(60):
        lines = [rng.choice(["a {", "}", "x;", "f() {", "} }", "b { c { }"]) for _ in range(rng.randint(3, 40))]
        texts[f"f{i}.sol"] = "\n".join(lines)
    rows = structure.with_blocks(code(texts)).select("path", F.inline("blocks")).collect()
    for path, source in texts.items():
        expected = sorted(s for s in brace_spans(source) if s[1] is not None)
        unclosed = [s[0] for s in brace_spans(source) if s[1] is None]
        got = sorted((r.line_start, r.line_end) for r in rows if r.path == path)
        for start in unclosed:  # open blocks reach to the last statement
            got.remove(max(g for g in got if g[0] == start))
        assert got == expected, path


SOL = """pragma solidity ^0.6.0;
contract C {
    uint[] public xs;
    function f(uint a)
        external onlyRole(X) payable returns (uint) {
        to.call{value: a}("");  // } not a brace
        total = 1;
    }
    function g() external;
    modifier m(uint z) { _; }
    constructor() {}
    receive() external payable { x.transfer(1); }
    function one() public { y.send(1); z = 2; }
}
"""


def test_functions(code):
    rows = {r["name"]: r for r in structure.functions(code({"a.sol": SOL})).collect()}
    f = rows["f"]
    assert (f.visibility, f.mutability, f.modifiers, f.parameters) == ("external", "payable", ["onlyRole(X)"], ["uint a"])
    assert (f.line_start, f.line_end, f.is_payable, f.is_external) == (4, 8, True, True)
    assert (rows["g"].line_start, rows["g"].line_end) == (9, 9)
    assert rows["m"].node_type == "modifier_definition" and rows["m"].parameters == ["uint z"]
    assert rows["constructor"].visibility == "internal"
    assert rows["receive"].node_type == "fallback_receive_definition"


def test_nested_record_equals_tables(spark, code):
    files = code({"a.sol": SOL}).withColumn("hash", F.lit("h")).withColumn("original_size", F.lit(1).cast("bigint"))
    record = solidity_index.sol_files(files).collect()[0]
    calls = facts.external_calls(files).orderBy("line").collect()
    assert [(c.line, c.call_type, c.callee, c.value) for c in record.external_calls] == [
        (c.line, c.call_type, c.callee, c.value) for c in calls]
    risk = facts.reentrancy(structure.functions(files), facts.external_calls(files), facts.state_writes(files)).collect()
    assert [(r.function, r.external_call_line, r.state_write_line) for r in risk] == [("f", 6, 7)]
    assert [(r.function, r.external_call_line, r.state_write_line) for r in record.reentrancy_risk] == [("f", 6, 7)]
    assert [m.name for m in record.modifiers] == ["m"] and len(record.functions) == 7 - 1
    assert [v.name for v in record.state_variables] == ["xs"]


def test_repartitioning_changes_nothing(code):
    files = code({f"f{i}.sol": SOL for i in range(20)})
    a = structure.functions(files.repartition(7)).drop("seq").collect()
    b = structure.functions(files.coalesce(1)).drop("seq").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def block_stack(kinds):
    """(open_seq, close_seq, parent, depth) by a stack; ``kinds`` are braces, or (indent, opens) of Python statements."""
    stack, out = [], []
    def close(keep, seq):
        while len(stack) > keep:
            i, nth = stack.pop()[:2]
            out.append((i, seq, stack[-1][1] if stack else -1, len(stack) + 1))
    opened = 0
    for i, kind in enumerate(kinds):
        if isinstance(kind, str):
            if kind == "}" and stack:
                close(len(stack) - 1, i)
            opens, indent = kind == "{", 0
        else:
            indent, opens = kind
            close(sum(s[2] < indent for s in stack), i - 1)
        if opens:
            stack.append((i, opened, indent))
            opened += 1
    close(0, len(kinds) - 1)
    return sorted(out)


def test_blocks_of_many_chunks_equal_a_stack(code):
    rng = random.Random(3)
    braces = {f"f{n}.sol": ["}", "}", *(rng.choice("{{{}}}x") for _ in range(n))] for n in (1, 126, 127, 128, 300, 1000)}
    deep = {"deep.sol": ["{"] * 400 + ["}"] * 500 + ["{"] * 3}
    indents = {}
    for n in (50, 129, 700):
        rows = [(0, True)]
        for _ in range(n):
            rows.append((rows[-1][0] + 1 if rows[-1][1] else rng.randint(0, rows[-1][0]), rng.random() < 0.5))
        indents[f"p{n}.py"] = rows[:-1] + [(rows[-1][0], False)]
    texts = {p: "\n".join({"{": "f() {", "}": "}", "x": "x;"}[k] for k in ks) for p, ks in (braces | deep).items()}
    texts |= {p: "\n".join(" " * i + ("if a:" if o else "x = 1") for i, o in rows) for p, rows in indents.items()}
    rows = structure.with_blocks(code(texts)).select("path", F.inline("blocks")).collect()
    for path, kinds in (braces | deep | indents).items():
        got = sorted((r.open_seq, r.close_seq, r.parent, r.depth) for r in rows if r.path == path)
        assert got == block_stack(kinds), path


def test_first_calls_and_writes_by_line(spark):
    """Random ranges, calls and writes against all pairs."""
    rng = random.Random(8)
    functions, calls, writes = [], set(), set()
    for f in range(20):
        for seq in range(rng.randint(0, 12)):
            start = rng.randint(1, 200)
            functions.append(("p", f"f{f}", seq, f"n{seq}", start, start + rng.choice([0, 3, 90])))
        calls |= {("p", f"f{f}", rng.randint(1, 220)) for _ in range(rng.randint(0, 15))}
        writes |= {("p", f"f{f}", 210, n, f"w{n}") for n in (rng.randint(1, 210) for _ in range(rng.randint(0, 25)))}
    fs = spark.createDataFrame(functions, "project string, path string, seq int, name string, line_start int, line_end int")
    cs = spark.createDataFrame(sorted(calls), "project string, path string, line int")
    ws = spark.createDataFrame(sorted(writes), "project string, path string, n_lines int, line int, state_write_text string")
    inside = sorted((r.path, r.seq, r.line) for r in facts.calls_in_functions(fs, cs).collect())
    assert inside == sorted((p, s, c[2]) for _, p, s, _, a, b in functions for c in calls if c[1] == p and a <= c[2] <= b)
    want, risky = [], []
    for _, p, s, n, a, b in functions:
        first = min((c[2] for c in calls if c[1] == p and a <= c[2] <= b), default=None)
        if first is not None:
            want.append((p, s, first))
            write = min((w[3] for w in writes if w[1] == p and first <= w[3] <= min(b, 210) - 1), default=None)
            risky += [(p, n, first, write)] if write is not None else []
    assert sorted((r.path, r.seq, r.external_call_line) for r in facts.first_calls(fs, cs).collect()) == sorted(want)
    found = facts.reentrancy(fs, cs, ws).collect()
    assert sorted((r.path, r.function, r.external_call_line, r.state_write_line) for r in found) == sorted(risky) and len(risky) > 20
