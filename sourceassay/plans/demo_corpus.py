"""A source corpus derived from the driver's tables.

The tables hold no source code, so every row is turned into one file:

* ``orders``    -> a Solidity / JavaScript / Python / MQL / Markdown file whose
  functions carry scenarios for the rules plus noise lines,
* ``documents`` -> a file holding the whole text as comments, literals or bare prose,
* ``pages``     -> an HTML file (never a source file),
* ``customer``  -> the project's configuration files.

A file is built inside its row: no grouping, no join, no shuffle, so a key that
occurs very often only gives many files.  The same expressions, spelled for the
two SQL dialects, feed Spark and the oracle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from sourceassay.functions.sizing import spread
from sourceassay.operators.corpus import with_suffix
from sourceassay.session import ensure_checkpoint_dir

NL = "\n"
SCHEMA = "project string, path string, raw binary, is_symlink boolean, ext string"
_WRITTEN: set[str] = set()

SOL_DIRS = (
    "src", "src/controllers", "latest", "vendor/x", "node_modules/x",
    "test", "lib", "src/__tests__", "external/a", "contracts",
)

_WITHDRAW = "function withdraw(address to, uint amount) external {"
_RECEIVER = "function executeOperation(address to, uint amount) external {"

#: (header or None, body lines); the counts are primes so that every scenario
#: meets every directory and file family.
SOL_SCENARIOS = (
    (None, ()),
    (None, ('to.call{value: amount}("");', "balances[msg.sender] -= amount;")),
    (None, ("balances[msg.sender] -= amount;", 'to.call{value: amount}("");')),
    (None, ('(bool ok,) = to.call{value: amount}("");', "balances[to] = 0;")),
    (None, ("balances[to] = 0;", '(bool ok,) = to.call{value: amount}("");')),
    (None, ("balances[to] = 0;", '(bool ok,) = to.call{value: amount}("");', "balances[to] = 0;")),
    (None, ("require(tx.origin == owner);",)),
    (None, ("if (tx.origin == owner) { y = 1; }",)),
    (None, ("require(msg.sender == owner);",)),
    (None, ("uint256 a;", "c = a + b;")),
    (None, ("c = a + b;",)),
    (_WITHDRAW, ("to.transfer(amount);",)),
    ("function withdraw(address to, uint amount) external onlyOwner {", ("to.transfer(amount);",)),
    (_WITHDRAW, ('require(msg.sender == owner, "no");', "to.transfer(amount);")),
    (None, ("uint bal = balances[to];", 'to.call{value: 1}("");', "balances[to] = bal - amount;")),
    (None, ("uint bal = balances[to];", 'to.call{value: 1}("");',
            "balances[msg.sender] = bal - amount;")),
    (None, ("bool sent = to.send(amount);",)),
    (None, ("to.delegatecall{gas: 5}(data);",)),
    ("function onFlashLoan(address to, uint amount) external {", ("uint r = pair.getReserves();",)),
    (_RECEIVER, ("uint p = pool.slot0();",)),
    (_RECEIVER, ("uint p = pool.slot0();", "uint t = twap.consult();")),
    (None, ("uint256 a;", "if (a > 0) { c = a + b; }")),
    (None, ("require(ok == true);", "assert(hasRole(admin));")),
)
JS_SCENARIOS = (
    (None, ()),
    (None, ("acct.balance = 0;",)),
    (None, ("if (!req.session) { return; }", "acct.balance = 0;")),
    (None, ("require(ok);", "acct.balance = 0;")),
    (None, ("acct.balance -= amount;",)),
    (None, ("if (isOwner) {", "    acct.balance -= amount;", "}")),
    (None, ("require(isOwner);", "acct.balance -= amount;")),
    (None, ("await stripe.charges.create(c);", "acct.balance -= amount;")),
    (None, ("const r = await stripe.charges.create(c);",
            'if (r.status !== "succeeded") { return; }', "acct.balance -= amount;")),
    (None, ("const r = await stripe.charges.create(c);", "acct.balance -= amount;")),
    (None, ("await flutterwave.transfer(c);", "acct.balance -= amount;")),
    (None, ("const r = await flutterwave.transfer(c);",
            'if (r.status !== "success") { return; }', "acct.balance -= amount;")),
    (None, ("if (acct.balance < amount) { return; }", "await pay(x);", "acct.balance -= amount;")),
    (None, ("if (acct.balance < amount) { return; }", "acct.balance -= amount;", "await pay(x);")),
    (None, ("if (acct.balance < amount) { return; }", "await pay(x);", "other.balance -= amount;")),
    (None, ('if (req.body.role === "admin") { grant(); }',)),
    (None, ("const q = req.body.role;",)),
    (None, ("if (req.body.isAdmin) { grant(); }",)),
    (None, ("if (req.session.isAdmin) { grant(); }",)),
    (None, ("const amount = req.body.amount;", "acct.balance -= amount;")),
    (None, ("const amount = req.body.amount;", "if (amount <= 0) { return; }",
            "acct.balance -= amount;")),
    (None, ("const amount = req.body.amount;", "acct.balance -= price;")),
    (None, ('order.status = "completed";',)),
    (None, ('if (payment.status === "success") {', '    order.status = "completed";', "}")),
    (None, ('if (payment.status === "successful") {', '    order.status = "completed";', "}")),
    (None, ("authorize(req);", "if (acct.owner !== req.user) { return; }",
            "acct.balance -= amount;")),
    (None, ("transfer(acct, amount);", "authorize(req);")),
    ("function plain(req, acct) {", ("acct.balance = 0;", 'subscription.status = "active";')),
    (None, ("const r = await pay(x);", "if (r.ok) { acct.balance -= amount; }")),
)
PY_SCENARIOS = (
    (None, ()),
    (None, ("broker.send_order(symbol=s, volume=v, type=t)",)),
    (None, ("broker.send_order(symbol=s, volume=v, type=t, deviation=5)",)),
    (None, ("broker.send_order(symbol=s, volume=v, type=t, slippage=5)",)),
    (None, ("broker.send_order(symbol=s, volume=v, type=t, sl=1)",)),
    (None, ("broker.send_order(symbol=s, volume=v, type=t, stop_loss=1)",)),
    (None, ("r = broker.send_order(symbol=s)",)),
    (None, ("r = broker.send_order(symbol=s)", "if r.retcode != 0: return")),
    (None, ("r = broker.send_order(symbol=s)", "if not r: return")),
    (None, ("lot = req.lot", "broker.send_order(symbol=s, volume=lot)")),
    (None, ("lot = req.lot", "if lot <= 0: return", "broker.send_order(symbol=s, volume=lot)")),
    (None, ("lot = req.lot", "if lot > MAX: return", "broker.send_order(symbol=s, volume=lot)")),
    (None, ("await broker.buy(x)", "self.balance -= amount")),
    (None, ("async with self.lock:", "    await broker.buy(x)", "    self.balance -= amount")),
    (None, ("self.balance -= amount", "await broker.buy(x)")),
    (None, ("r = broker.send_order(symbol=s)", "q = broker.send_order(symbol=s)",
            "if not q: return")),
    (None, ()),
)
MQ_SCENARIOS = (
    (None, ()),
    (None, ("OrderSend(s, c, l, p, sl, st, tp);",)),
    (None, ("int t = OrderSend(s, c, l, p, sl, st, tp);",)),
    (None, ("OrderSend(s, c, l, p, sl, 0, tp);",)),
    (None, ("int t = OrderSend(s, c, l, p, sl, 0, tp);",)),
)

SOL_NOISE = (
    "uint x = a + b;", "total += amount;", '// note "x" tx.origin',
    'require(msg.sender == owner, "no");', "uint p = oracle.latestAnswer();",
    "uint r = pair.getReserves();", "uint b = token.balanceOf(to);",
    'string memory s = "http://x//y";', "/* block */ count++;", "x = x.add(y);", "",
    "emit Done(to, amount);  \t",
)
JS_NOISE = (
    'const u = "http://x//y";', "const t = 'it\\'s'; // tail", "/* block */ let n = 1;", "",
    "const v = `a // b`;", "const  w\t=  2;", "/* two" + NL + "   lines */", "return;  ",
    'call("/* not */");', "// only comment", "n = n / 2;", "const g = x => x + 1;",
)
PY_NOISE = (
    "x = 1", "", "y = x + 1", "# note", "z = 'a # b'", "x = 1", "", "y = x + 1", "# note",
    "z = 'it\\'s'", "x = 2", "",
)
MQ_NOISE = (
    "x = 1;", "", "y = x + 1;", "// note", "x = 1;", "", "y = x + 1;", "// note", "x = 2;", "",
    "z = 3;", "",
)


def literal(text: str, dialect: str) -> str:
    if dialect == "spark":
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + text.replace("'", "''") + "'"


def pick(items, index: str, dialect: str) -> str:
    """``items[index]`` with a constant list (index from 0)."""
    values = ", ".join(literal(x, dialect) for x in items)
    index = f"CAST({index} AS INT)"
    if dialect == "spark":
        return f"element_at(array({values}), {index} + 1)"
    return f"list_extract([{values}], {index} + 1)"


def _unit(scenarios, noise, indent, headers, footer, sid, u, dialect):
    """One function: header, scenario, three noise lines, footer."""
    def body(lines):
        return "".join(indent + "    " + x + NL for x in lines)

    n = len(scenarios)
    own = [indent + h if h else "" for h, _ in scenarios]
    default = headers.replace("@", f"' || k || '_{u}")
    header = (
        f"CASE WHEN {pick(own, f'{sid} % {n}', dialect)} <> '' "
        f"THEN {pick(own, f'{sid} % {n}', dialect)} ELSE {default} END"
    )
    padded = [indent + "    " + x if x else "" for x in noise]
    noise_lines = " || ".join(
        f"{pick(padded, f'(n0 + {5 * u + 7 * i}) % 12', dialect)} || {literal(NL, dialect)}"
        for i in range(3)
    )
    return (
        f"{header} || {literal(NL, dialect)} || "
        f"{pick([body(lines) for _, lines in scenarios], f'{sid} % {n}', dialect)} || "
        f"{noise_lines} || {literal(footer + NL, dialect)}"
    )


def order_content(dialect: str) -> str:
    """Text of an order's file from ``k`` (order key), ``b`` (= k div 10), ``n0`` and ``ck``."""
    lit = lambda s: literal(s, dialect)
    units = lambda *a: " || ".join(
        _unit(*a, sid, u, dialect) for u, sid in enumerate(("b", "(b * 3 + 5)"))
    )
    pragma = pick(
        ("pragma solidity ^0.8.19;", "pragma solidity >=0.7.0 <0.9.0;",
         "pragma solidity ^0.6.12;", "pragma solidity ^0.8;"), "ck % 4", dialect)
    sol_header = (
        "'    function ' || CASE WHEN k % 9 = 1 THEN 'onFlashLoan' ELSE 'f@' END || "
        "'(address to, uint amount) external ' || "
        "CASE WHEN k % 5 = 0 THEN 'onlyOwner ' WHEN k % 7 = 0 THEN 'payable ' ELSE '' END || '{'"
    )
    sol = " || ".join((
        pragma, lit(NL + "contract C"), "k", lit(" {" + NL
        + "    mapping(address => uint) public balances;" + NL
        + "    uint256 constant FEE = 3;" + NL
        + "    address immutable owner;" + NL
        + "    event Done(address indexed to, uint amount);" + NL
        + "    modifier onlyOwner() {" + NL
        + '        require(msg.sender == owner, "no"); _;' + NL
        + "    }" + NL),
        units(SOL_SCENARIOS, SOL_NOISE, "    ", sol_header, "    }"),
        lit("    function view" ), "k", lit("(uint a) public view returns (uint) { return a; }"
            + NL + "}" + NL),
    ))
    js = " || ".join((
        lit("// service "), "k", lit(NL),
        units(JS_SCENARIOS, JS_NOISE, "", "'async function f@(req, acct) {'", "}"),
    ))
    py = " || ".join((
        lit("# strategy "), "k", lit(NL),
        units(PY_SCENARIOS, PY_NOISE, "", "'async def f@(self, req):'", ""),
    ))
    mq = " || ".join((
        lit("// expert "), "k", lit(NL),
        units(MQ_SCENARIOS, MQ_NOISE, "", "'void f@() {'", "}"),
    ))
    return (
        f"CASE WHEN k % 10 < 3 THEN {sol} WHEN k % 10 < 7 THEN {js} "
        f"WHEN k % 10 = 7 THEN {py} WHEN k % 10 = 8 THEN {mq} "
        f"ELSE {lit('# notes ')} || k END"
    )


ORDER_KEYS = (
    "o_orderkey AS k", "CAST(floor(o_orderkey / 10) AS BIGINT) AS b",
    "CAST(floor(o_totalprice) AS BIGINT) AS n0", "o_custkey AS ck",
)
ORDER_PROJECT = "CASE WHEN b % 3 = 0 THEN 'proj0' ELSE 'proj' || ck END"
EXTENSIONS = (".sol", ".sol", ".sol", ".js", ".js", ".ts", ".tsx", ".py", ".mq5", ".md")


def order_path(dialect: str) -> str:
    return (
        f"{pick(SOL_DIRS, 'b % 10', dialect)} || '/F' || k || "
        f"CASE WHEN k % 13 = 0 THEN '.spec' ELSE '' END || {pick(EXTENSIONS, 'k % 10', dialect)}"
    )


def document_file(dialect: str) -> tuple[str, str]:
    lit = lambda s: literal(s, dialect)
    big = "doc_id % 1000 = 7"
    path = (
        f"CASE WHEN {big} THEN 'contracts/Big' || doc_id || '.sol' "
        "WHEN doc_id % 5 = 0 THEN 'docs/D' || doc_id || '.md' "
        "WHEN doc_id % 5 = 1 THEN 'src/D' || doc_id || '.js' "
        "WHEN doc_id % 5 = 2 THEN 'src/D' || doc_id || '.ts' "
        "WHEN doc_id % 5 = 3 THEN 'src/D' || doc_id || '.tsx' "
        "ELSE 'src/D' || doc_id || '.jsx' END"
    )
    nl = lit(NL)
    content = (
        f"CASE WHEN {big} THEN {lit('pragma solidity ^0.8.19;' + NL + 'string constant PAD = ' + chr(34))}"
        f" || repeat('pad ', 550000) || {lit(chr(34) + ';' + NL)} "
        "WHEN doc_id % 5 = 0 THEN text "
        f"WHEN doc_id % 5 = 1 THEN '// ' || replace(text, {nl}, {lit(NL + '// ')}) || {nl} "
        f"|| 'const d' || doc_id || ' = 1;' || {nl} "
        f"WHEN doc_id % 5 = 2 THEN '/* ' || text || ' */ let e = 1;' || {nl} "
        "WHEN doc_id % 5 = 3 THEN text "
        f"ELSE {lit('const t = `')} || replace(text, {lit('`')}, '') || {lit('`;' + NL)} END"
    )
    return path, content


#: (condition, path, content) of the configuration files of a customer's project
CONFIG_FILES = (
    ("c_custkey % 5 IN (0, 4)", "'package.json'",
     """'{"name": "app-' || c_custkey || '", "version": "1.' || c_custkey % 10 || '.0"}'"""),
    ("c_custkey % 5 = 3", "'package.json'", """'{"name": "app-' || c_custkey || '", "version": '"""),
    ("c_custkey % 5 IN (1, 4)", "'hardhat.config.js'", "'module.exports = {};'"),
    ("c_custkey % 5 = 2 OR c_custkey % 4 = 0", "'foundry.toml'", "'[profile.default]'"),
)


def derive_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, path, raw, is_symlink`` of every file of the corpus."""
    d = "spark"
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # Only the four narrow columns move; the texts are written after the spread.
    orders = spread(read("orders").selectExpr(*ORDER_KEYS)).selectExpr(
        f"{ORDER_PROJECT} AS project", f"{order_path(d)} AS path",
        f"concat(encode({order_content(d)}, 'utf-8'), "
        "CASE WHEN k % 53 = 0 THEN unhex('FF') ELSE unhex('') END) AS raw",
        "k % 29 = 0 AS is_symlink",
    )
    path, content = document_file(d)
    documents = read("documents").selectExpr(
        "'proj' || doc_id % 100 AS project", f"{path} AS path",
        f"encode({content}, 'utf-8') AS raw", "false AS is_symlink")
    pages = read("pages").selectExpr(
        "'proj' || page_id % 100 AS project", "'web/P' || page_id || '.html' AS path",
        "encode(html, 'utf-8') AS raw", "false AS is_symlink")
    customer = read("customer")
    files = orders.unionByName(documents).unionByName(pages)
    for condition, path, content in CONFIG_FILES:
        files = files.unionByName(customer.where(condition).selectExpr(
            "'proj' || c_custkey AS project", f"{path} AS path",
            f"encode({content}, 'utf-8') AS raw", "false AS is_symlink"))
    return files


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as a stored table, written once per application and input folder.

    The corpus lies in the shared checkpoint folder, partitioned by suffix, so a
    scan for one language never opens the other languages' contents.
    """
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    location = f"{base}/corpus-{name}"
    if location not in _WRITTEN:
        derived = with_suffix(derive_source_files(spark, sf_dir))
        writer = derived.write.mode("overwrite").partitionBy("ext")
        if spark.sparkContext.master.startswith("local"):
            # A parquet row group is one task's work; small test data needs small ones.
            writer = writer.option("maxRecordsPerFile", 2000)
        writer.parquet(location)
        _WRITTEN.add(location)
    return spark.read.schema(SCHEMA).parquet(location)


def source_files_sql() -> str:
    """The same table for the oracle."""
    d = "duckdb"
    path, content = document_file(d)
    parts = [
        f"SELECT {ORDER_PROJECT} AS project, {order_path(d)} AS path, "
        f"encode({order_content(d)}) || CASE WHEN k % 53 = 0 THEN unhex('FF') ELSE unhex('') END AS raw, "
        f"k % 29 = 0 AS is_symlink FROM (SELECT {", ".join(ORDER_KEYS)} FROM orders)",
        f"SELECT 'proj' || doc_id % 100, {path}, encode({content}), false FROM documents",
        "SELECT 'proj' || page_id % 100, 'web/P' || page_id || '.html', encode(html), false FROM pages",
    ]
    for condition, path, content in CONFIG_FILES:
        parts.append(
            f"SELECT 'proj' || c_custkey, {path}, encode({content}), false "
            f"FROM customer WHERE {condition}")
    return "\nUNION ALL\n".join(parts)
