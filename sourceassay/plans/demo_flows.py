"""Script files whose values go through aliases, calls and returns, one per row of ``orders``.

Built inside the row like the rest of the corpus; lengths and choices come from the order's columns.  The oracle reads the
same texts line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceassay.functions.sizing import spread
from sourceassay.plans.demo_corpus import NL, ORDER_PROJECT, literal, pick

KEYS = ("o_orderkey AS k", "CAST(floor(o_orderkey / 10) AS BIGINT) AS b", "o_custkey AS ck",
        "CAST(floor(o_totalprice) AS BIGINT) AS n0")
SOURCES = ("req.body.amount", "await pay(acct)", "read(req.body.amount)", "5", "req.body.amount")
CHECKS = ("", "    if (v1 <= 0) { return; }", "    if (req.body.amount > 100) { return; }", "    if (!v2) { return; }",
          "    if (v9 > 1) { return; }", "    verify(v1);", "")
OWNERS = ("", "    if (who.owner !== req.user) { return; }", "    if (acct.ownerId !== req.user) { return; }",
          "    if (other.owner !== req.user) { return; }")
CHANGES = ("", "    w = 1;", "    if (flag) {" + NL + "        w = 1;" + NL + "    }", "    w += req.body.fee;")
SINKS = ("    acct.balance -= w;", "    settle(acct, w);", "    who.wallet.balance -= w;", "    acct.credits += 3;", "    bound(who, w);",
         "    acct.balance -= read(w);")
LATE = ("", "    if (w < 5) { return; }")
HELPERS = NL.join((
    "function read(body) {", "    const got = body;", "    return got;", "}",
    "function verify(sum) {", "    if (sum > 7) { throw 1; }", "}",
    "function settle(row, sum) {", "    const own = row;", "    own.balance -= sum;", "}",
    "function bound(row, sum) {", "    if (sum > 9) { return; }", "    row.balance -= sum;", "}", ""))


def content(dialect: str) -> str:
    def line(items, index: str) -> str:
        return f"{pick(items, index, dialect)} || {literal(NL, dialect)}"

    step = f"'    const v' || (i + 1) || ' = v' || i || ';' || {literal(NL, dialect)}"
    # As many copies as the order's number asks for.
    if dialect == "spark":
        copies = f"array_join(transform(sequence(0, CAST(b % 9 AS INT)), i -> {step}), '')"
    else:
        copies = f"array_to_string(list_transform(range(0, CAST(b % 9 AS INT) + 1), lambda i: {step}), '')"
    return " || ".join((
        literal(HELPERS, dialect), "'async function handle' || k || '(req, acct) {'", literal(NL + "    const v0 = ", dialect),
        pick(SOURCES, "k % 5", dialect), literal(";" + NL, dialect), copies, literal("    const who = acct;" + NL, dialect),
        line(CHECKS, "n0 % 7"), line(OWNERS, "ck % 4"), "'    let w = v' || (b % 9 + 1) || ';'", literal(NL, dialect),
        line(CHANGES, "(n0 + ck) % 4"), line(SINKS, "(b + ck) % 6"), line(LATE, "n0 % 2"), literal("}" + NL, dialect)))


PATH = "'flow/H' || k || '.js'"


def flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*KEYS))
    return orders.selectExpr(f"{ORDER_PROJECT} AS project", f"{PATH} AS path", "'js' AS language", f"{content('spark')} AS content")


def flow_files_sql() -> str:
    return (f"SELECT {ORDER_PROJECT} AS project, {PATH} AS path, {content('duckdb')} AS content "
            f"FROM (SELECT {', '.join(KEYS)} FROM orders)")
