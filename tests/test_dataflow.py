"""Flows through assignments, calls and returns."""

import pytest

from sourceassay.operators import dataflow


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


HANDLER = "async function h(req, u) {\n%s\n}\n"


@pytest.fixture(scope="module")
def flow_of(code):
    def build(**bodies):
        return dataflow.flow(code({f"{name}.js": text if "function" in text else HANDLER % text for name, text in bodies.items()}))
    return build


def test_fields_reach_balances(flow_of):
    f = flow_of(
        chain="a = req.body.x;\nb = a;\nc = f(b);\nu.balance -= c;",
        direct="u.balance -= req.body.x;",
        on_alias="a = req.body.x;\nb = a;\nif (b > 10) { return; }\nu.balance -= a;",
        on_field="if (req.body.x > 10) { return; }\nconst a = req.body.x;\nu.balance -= a;",
        too_late="a = req.body.x;\nu.balance -= a;\nif (a > 10) { return; }",
        other_field="a = req.body.x;\nif (req.body.y > 10) { return; }\nu.balance -= a;",
        overwritten="a = req.body.x;\na = 1;\nu.balance -= a;",
        maybe="let a = req.body.x;\nif (z) {\n    a = 1;\n}\nu.balance -= a;",
        update="let a = 1;\na += req.body.x;\nu.balance -= a;",
        literal="a = 'req.body.x';\nu.balance -= a;",
        property="a = req.body.x;\nu.balance -= q.a;",
        callback="a = req.body.x;\nitems.forEach((i) => {\n    u.balance -= a;\n});",
    )
    assert rows(dataflow.missing_validation(f), "path", "line_start", "line_end", "field") == [
        ("callback.js", 2, 4, "x"), ("chain.js", 2, 5, "x"), ("direct.js", 2, 2, "x"), ("maybe.js", 2, 6, "x"),
        ("other_field.js", 2, 4, "x"), ("too_late.js", 2, 3, "x"), ("update.js", 3, 4, "x")]


def test_fields_go_through_calls(flow_of):
    pay = "function pay(row, sum) {\nrow.balance -= sum;\n}\n"
    f = flow_of(
        argument=pay + HANDLER % "a = req.body.x;\npay(u, a);",
        nested=pay + HANDLER % "a = req.body.x;\npay(u, Number(trim(a), 10));",
        wrong_place=pay + HANDLER % "a = req.body.x;\npay(a, 1);",
        checked_before=pay + HANDLER % "a = req.body.x;\nif (a > 1) { return; }\npay(u, a);",
        checked_behind=pay + HANDLER % "a = req.body.x;\npay(u, a);\nif (a > 1) { return; }",
        checked_inside="function pay(row, sum) {\nif (sum > 1) { return; }\nrow.balance -= sum;\n}\n" + HANDLER % "pay(u, req.body.x);",
        returned="const get = (q) => {\nreturn q;\n};\n" + HANDLER % "const a = get(req.body.x);\nu.balance -= a;",
        checker="function check(q) {\nif (q > 1) { throw 1; }\n}\n" + HANDLER % "const a = req.body.x;\ncheck(a);\nu.balance -= a;",
        recursive="function pay(row, n) {\npay(row, n);\nrow.balance -= n;\n}\n" + HANDLER % "pay(u, req.body.x);",
    )
    assert rows(dataflow.missing_validation(f), "path", "fn", "line_start", "line_end") == [
        ("argument.js", "h", 5, 2), ("checked_behind.js", "h", 5, 2), ("nested.js", "h", 5, 2), ("recursive.js", "h", 6, 3),
        ("returned.js", "h", 5, 6), ("wrong_place.js", "h", 5, 2)]


def test_results_of_calls(flow_of):
    f = flow_of(
        plain="const r = await pay(x);\nu.balance -= 1;",
        derived="const r = await pay(x);\nconst ok = r.status;\nif (!ok) { return; }\nu.balance -= 1;",
        late="const r = await pay(x);\nu.balance -= 1;\nif (!r) { return; }",
        dropped="await pay(x);\nu.balance -= 1;",
        inline="if (!(await pay(x))) { return; }\nu.balance -= 1;",
        other="const r = await pay(x);\nif (!q) { return; }\nu.balance -= 1;",
        helper="function sure(q) {\nif (!q) { throw 1; }\n}\n" + HANDLER % "const r = await pay(x);\nsure(r);\nu.balance -= 1;",
    )
    assert rows(dataflow.unchecked_external_call(f), "path", "line_start", "line_end") == [
        ("dropped.js", 2, 3), ("late.js", 2, 3), ("other.js", 2, 4), ("plain.js", 2, 3)]


def test_owners_of_aliases(flow_of):
    f = flow_of(
        bare="u.balance -= 1;",
        alias="const a = u;\nif (a.owner !== req.user) { return; }\nu.balance -= 1;",
        two="const a = u;\nconst b = a;\nif (u.ownerId !== me) { return; }\nb.wallet.balance -= 1;",
        again="let a = u;\nif (a.owner !== req.user) { return; }\na = load(1);\na.balance -= 1;",
        other="if (w.owner !== req.user) { return; }\nu.balance -= 1;",
        late="u.balance -= 1;\nif (u.owner !== req.user) { return; }",
    )
    assert rows(dataflow.broken_access_control(f), "path", "line_start") == [
        ("again.js", 5), ("bare.js", 2), ("late.js", 2), ("other.js", 3)]


def test_empty_and_repeated(spark, code):
    empty = dataflow.flow(code({"a.js": "x"}).where("false"))
    assert not dataflow.missing_validation(empty).collect() and not dataflow.unchecked_external_call(empty).collect()
    assert not dataflow.broken_access_control(empty).collect()
    once = code({"a.js": HANDLER % "u.balance -= req.body.x;"})
    null = spark.createDataFrame([("p", "n.js", "js", None)], once.schema)
    many = once.unionByName(once).unionByName(null).selectExpr("*", "1 AS seq", "'q' AS node")
    assert rows(dataflow.missing_validation(dataflow.flow(many)), "path", "line_end") == [("a.js", 2)]


def test_long_chains_take_no_more_jobs(spark):
    """A fixpoint in rounds of joins starts jobs for every few steps of the longest chain."""
    length = 60
    edges = spark.createDataFrame([("p", "a.js", i, i, f"d{i}", f"d{i + 1}") for i in range(length)],
                                  "project string, path string, fn_seq int, seq int, node string, to string")
    seeds = spark.createDataFrame([("p", "a.js", "d0", 3, "d0", -1), (None, "a.js", "d0", 3, "d0", -1)],
                                  "project string, path string, source string, home int, node string, pos int")
    spark.sparkContext.setJobGroup("long-chain", "")
    found = rows(dataflow.reach(seeds, edges).where("project is not null"), "node", "pos")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("long-chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == sorted((f"d{i}", 3 if i > 3 else -1) for i in range(length + 1))
    assert len(jobs) < 10
