"""Signatures over the ordered nodes of a function.

The classes are documented only as one-line meanings, so the definitions here
are our own; agreement with any closed analyzer cannot be claimed.

Script functions: statements become nodes (validation, auth, ownership, input,
external call, transfer, state mutation, lifecycle, settlement check); the nodes
of one function are gathered once and all signatures read that one array.
Solidity: the facts of a file's nested record are turned into matches in place.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import findings as fn
from sourceassay.functions.sizing import number_rows
from sourceassay.operators import rules, structure

#: kind -> (pattern, group of the target, group of the operator)
NODE_PATTERNS = {
    "validation": (r"(?:\bif\s*\(|^(?:require|assert)\s*\()\s*!?\s*([\w$.]+)\s*([<>=!]=*)?", 1, 2),
    "auth": (r"\bif\s*\(.*\b(?:session|isOwner|isAdmin|role|authorized)\b"
             r"|\b(?:authorize|authenticate|requireAuth|checkAuth)\w*\s*\(|^require\s*\(", 0, None),
    "ownership": (r"\bif\s*\(.*?([\w$]+)\.(?:ownerId|owner|userId|user)\s*[!=]==?", 1, None),
    "settlement": (r"\bif\s*\(.*\.status\s*[!=]==?\s*[\"'](?:success|succeeded|successful|paid|settled)[\"']",
                   0, None),
    "input": (r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*req\.body\.\w+", 1, None),
    "external_call": (r"(?:\b(?:const|let|var)\s+([\w$]+)\s*=\s*)?\bawait\s+[\w$.]+\s*\(", 1, None),
    "transfer": (r"(?:^|[^\w$])(transfer|withdraw|payout)\s*\(", 1, None),
    "state_mutation": (r"([\w$.]+\.(?:balance|credits|funds))\s*(-=|\+=|=)[^=]", 1, 2),
    "lifecycle": (r"([\w$.]+)\.(?:status|state)\s*=\s*[\"'](\w+)[\"']", 1, 2),
}
#: words one of which a file must hold to have a mutation, a transfer or a lifecycle change
_WORDS = (".balance", ".credits", ".funds", ".status", ".state", "transfer", "withdraw", "payout",
          "req.body.")
_MONEY, _LIFECYCLE = (".balance", ".credits", ".funds"), (".status", ".state")
#: signature -> sets of plain texts, of each of which its nodes need one; none of them can reach over a comment or a line's end
NEEDED = {
    "DOUBLE_SPEND": ((".balance",), ("await",), ("<",), ("-=",)),
    "BROKEN_AUTH": (_MONEY,),
    "BROKEN_ACCESS_CONTROL": (_MONEY,),
    "PRIVILEGE_ESCALATION": (("req.body.",),),
    "UNCHECKED_EXTERNAL_CALL": (_MONEY, ("await",)),
    "SETTLEMENT_BYPASS": (_LIFECYCLE,),
    "FINANCIAL_ACTION_ORDERING": (("transfer", "withdraw", "payout"),),
    "INVALID_STATE_TRANSITION": (_LIFECYCLE, ("completed",)),
    "MISSING_VALIDATION": (_MONEY, ("req.body.",)),
    "LOGIC_FLAW": (_MONEY,),
}
#: class of Solidity matches -> plain text that a line of its facts holds
WEB3_NEEDED = {"TX_ORIGIN_ABUSE": "tx.origin"}
#: every node pattern needs one of these in its statement
_TRIGGER = (r"\bif\b|require|assert|auth|checkAuth|req\.body|await|transfer|withdraw|payout|balance|credits|funds"
            r"|status|state")


def _nodes_of(text: Column) -> Column:
    """Node array of one statement; a statement can be several things at once."""
    def node(kind: str) -> Column:
        pattern, target, op = NODE_PATTERNS[kind]
        pattern = "(?s)" + pattern
        return F.when(text.rlike(pattern), F.struct(
            F.lit(kind).alias("kind"),
            (F.regexp_extract(text, pattern, target) if target else F.lit("")).alias("target"),
            (F.regexp_extract(text, pattern, op) if op else F.lit("")).alias("op")))

    return F.array_compact(F.array(*[node(k) for k in NODE_PATTERNS]))


def worth_matching(files: DataFrame, name: str | None = None) -> DataFrame:
    """Files that hold a word without which no signature, or not the one of this name, can match."""
    content = F.col("content")

    def holds(words: tuple[str, ...]) -> Column:
        return reduce(or_, [F.contains(content, F.lit(w)) for w in words])
    return files.where(reduce(and_, [holds(words) for words in NEEDED.get(name, (_WORDS,))]))


def worth_recording(files: DataFrame, name: str) -> DataFrame:
    """Solidity files that hold the text without which this class can't match."""
    words = WEB3_NEEDED.get(name)
    return files if words is None else files.where(F.contains("content", F.lit(words)))


def fn_nodes(files: DataFrame) -> DataFrame:
    """Nodes of every function of the script files, in source order."""
    possible = files.where(F.col("language").isin(*rules.SCRIPT))
    tagged = (
        structure.exploded_parts(
            structure.with_blocks(possible), "project", "path", "language",
            wanted=lambda part: part.rlike(_TRIGGER))
        .select("project", "path", "language", "inside", "seq", "text", "part",
                F.explode_outer(_nodes_of(F.col("text"))).alias("node"))
        .where(F.col("node").isNotNull())
        .withColumn("line", structure.piece_line(F.col("part")))
    )
    named = r"\bfunction\s*\*?\s*([\w$]+)|([\w$]+)\s*(?:=|:)\s*(?:async\s*)?\("
    name = F.concat(F.regexp_extract("fn.header", named, 1), F.regexp_extract("fn.header", named, 2))  # one of them is empty
    return structure.with_scope(tagged).where(F.col("fn").isNotNull()).select(
        "project", "path", F.col("fn.open_seq").alias("fn_seq"), name.alias("fn"),
        "seq", "line", "node.kind", "node.target", "node.op", F.col("text").alias("args"),
    )


_MATCH = "array<struct<vulnerability_class:string,line_start:int,line_end:int,snippet:string>>"


def _match(name: str, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(name).alias("vulnerability_class"), start["line"].alias("line_start"),
        end["line"].alias("line_end"), end["args"].alias("snippet"))


def _hits(name: str, nodes: Column) -> Column:
    return F.transform(nodes, lambda n: _match(name, n, n))


def match_signatures(nodes: DataFrame) -> DataFrame:
    """All script signatures; one group is one function's nodes."""
    words = F.regexp_extract_all(F.col("args"), F.lit(r"([\w$]+)"), F.lit(1))
    grouped = nodes.groupBy("project", "path", "fn_seq", "fn").agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "line", "kind", "target", "op", "args", words.alias("words")))).alias("nodes"))
    kinds = ("state_mutation", "auth", "external_call", "validation", "ownership", "input",
             "transfer", "lifecycle", "settlement")
    for k in kinds:
        grouped = grouped.withColumn(k, F.expr(f"filter(nodes, n -> n.kind = '{k}')"))
    col = F.col

    def first(*names: str) -> Column:
        seqs = F.concat(*[F.transform(n, lambda x: x.seq) for n in names])
        return F.coalesce(F.array_min(seqs), F.lit(rules.FOREVER))

    grouped = (
        grouped.withColumn("first_auth", first("auth"))
        .withColumn("first_settlement", first("settlement"))
        .withColumn("first_cleared", first("auth", "settlement"))
    )

    def base(m: Column) -> Column:
        return F.regexp_extract(m.target, r"^([\w$]+)", 1)

    mutations = col("state_mutation")
    owned = F.filter(mutations, lambda m: ~F.exists(
        "ownership", lambda o: (o.target == base(m)) & (o.seq < m.seq)))
    # check(balance) < await < decrement of the same target
    raced = F.filter(
        F.transform(
            F.filter("validation", lambda v: (v.op == "<") & v.target.endswith(".balance")),
            lambda v: F.struct(v.alias("v"), F.array_min(F.transform(
                F.filter("external_call", lambda c: c.seq > v.seq), lambda c: c.seq)).alias("call"))),
        lambda r: r["call"].isNotNull())
    raced = F.transform(raced, lambda r: F.struct(r["v"].alias("v"), F.array_min(F.filter(
        mutations,
        lambda m: (m.op == "-=") & (m.target == r["v"].target) & (m.seq > r["call"]))).alias("m")))
    called = F.transform("external_call", lambda c: F.struct(
        c.alias("c"), F.array_min(F.filter(mutations, lambda m: m.seq > c.seq)).alias("m")))
    unchecked = F.filter(
        F.filter(called, lambda r: r["m"].isNotNull()),
        lambda r: (r["c"].target == "") | ~F.exists("validation", lambda v: (
            (v.seq > r["c"].seq) & (v.seq < r["m"].seq) & F.array_contains(v.words, r["c"].target))))
    reached = F.transform("input", lambda i: F.struct(i.alias("i"), F.array_min(F.filter(
        mutations, lambda m: (m.seq > i.seq) & F.array_contains(m.words, i.target))).alias("m")))
    unbounded = F.filter(
        F.filter(reached, lambda r: r["m"].isNotNull()),
        lambda r: ~F.exists("validation", lambda v: (
            (v.seq > r["i"].seq) & (v.seq < r["m"].seq) & (v.target == r["i"].target)
            & v.op.rlike("[<>]"))))
    bare = (F.size("auth") == 0) & (F.size("validation") == 0) & (F.size("ownership") == 0)
    matches = F.flatten(F.array(
        F.transform(F.filter(raced, lambda r: r["m"].isNotNull()),
                    lambda r: _match("DOUBLE_SPEND", r["v"], r["m"])),
        _hits("BROKEN_AUTH", F.filter(mutations, lambda m: m.seq < col("first_auth"))),
        _hits("BROKEN_ACCESS_CONTROL", owned),
        _hits("PRIVILEGE_ESCALATION", F.filter("auth", lambda a: F.contains(a.args, F.lit("req.body.")))),
        F.transform(unchecked, lambda r: _match("UNCHECKED_EXTERNAL_CALL", r["c"], r["m"])),
        _hits("SETTLEMENT_BYPASS", F.filter("lifecycle", lambda n: n.seq < col("first_settlement"))),
        _hits("FINANCIAL_ACTION_ORDERING",
              F.filter("transfer", lambda n: n.seq < col("first_cleared"))),
        _hits("INVALID_STATE_TRANSITION", F.filter(
            "lifecycle", lambda n: (n.op == "completed") & (n.seq < col("first_settlement")))),
        F.transform(unbounded, lambda r: _match("MISSING_VALIDATION", r["i"], r["m"])),
        F.when(bare, _hits("LOGIC_FLAW", mutations)).otherwise(F.array().cast(_MATCH)),
    ))
    return structure.inlined(grouped, matches, "project", "path", "fn")


def slippage_omissions(files: DataFrame) -> DataFrame:
    """Market orders without a slippage bound, from the rule of that name."""
    rule = tuple(r for r in rules.CATALOGUE if r.vulnerability_class == "SLIPPAGE_OMISSION")
    return rules.match_rules(files, rule).select(
        "project", F.col("file_path").alias("path"), "vulnerability_class", "line_start", "line_end")


def web3_matches(records: DataFrame, name: str | None = None) -> DataFrame:
    """Solidity matches out of the nested records, of all classes or of one: a map over the files.

    What the classes asked for don't look at is not worked out.
    """
    def hits(name: str, rows: Column, start: str, end: str, text: Column | str | None) -> Column:
        return F.transform(rows, lambda r: F.struct(
            F.lit(name).alias("vulnerability_class"), r[start].alias("line_start"),
            r[end].alias("line_end"),
            (r[text] if text else F.lit("")).alias("snippet")))

    spot = F.exists("oracle_uses", lambda o: o.source.isin("uniswap", "balanceof"))
    average = F.exists("oracle_uses", lambda o: o.source == "twap")
    no_rows = F.array().cast(_MATCH)
    open_functions = F.filter("functions", lambda f: (
        (f.node_type == "function_definition") & f.is_external & ~f.mutability.isin("view", "pure")
        & F.exists("external_calls", lambda c: c.line.between(f.line_start, f.line_end))
        & ~F.exists("access_controls", lambda a: a.line.between(f.line_start, f.line_end))))
    dropped = F.filter("external_calls", lambda c: (
        c.call_type.isin("call", "send", "delegatecall")
        & ~F.regexp_extract(c.text, r"(?s)^(.*?)\.\s*(?:call|send|delegatecall)\s*[({]", 1).rlike(
            r"=|\b(?:require|assert|if|return)\b")))
    by_class = {
        "REENTRANCY": hits("REENTRANCY", F.col("reentrancy_risk"), "external_call_line", "state_write_line",
                           "state_write_text"),
        "TX_ORIGIN_ABUSE": hits("TX_ORIGIN_ABUSE", F.filter("access_controls", lambda a: a.type == "tx_origin"),
                                "line", "line", "condition"),
        "ARITHMETIC_OVERFLOW": hits("ARITHMETIC_OVERFLOW", F.filter("arithmetic_ops", lambda a: a.on_uint),
                                    "line", "line", "operands"),
        "FLASH_LOAN_ORACLE_MANIPULATION": F.when(spot & ~average, hits(
            "FLASH_LOAN_ORACLE_MANIPULATION", F.col("flash_loan_markers"), "line_start", "line_end", "function")).otherwise(no_rows),
        "BROKEN_ACCESS_CONTROL": hits("BROKEN_ACCESS_CONTROL", open_functions, "line_start", "line_end", "name"),
        "UNCHECKED_EXTERNAL_CALL": hits("UNCHECKED_EXTERNAL_CALL", dropped, "line", "line", "text"),
    }
    matches = F.flatten(F.array(*[found for kind, found in by_class.items() if name in (None, kind)]))
    return structure.inlined(records, matches, "project", "path_relative").withColumnRenamed("path_relative", "path")


def web3_findings(matches: DataFrame) -> DataFrame:
    """Matches -> numbered finding rows with the documented defaults.

    Expects ``project, path, vulnerability_class, line_start, line_end, snippet`` and
    optionally ``description, fix_principle, confidence``.  The number is one
    counter per project over all files and classes.
    """
    for name, kind in (("description", "string"), ("fix_principle", "string"), ("confidence", "double")):
        if name not in matches.columns:
            matches = matches.withColumn(name, F.lit(None).cast(kind))
    shaped = matches.select(
        "project", F.col("path").alias("file_path"),
        F.coalesce("line_start", F.lit(1)).alias("line_start"),
        F.coalesce("line_end", F.lit(1)).alias("line_end"),
        F.coalesce("vulnerability_class", F.lit("UNKNOWN")).alias("vulnerability_class"),
        F.left(F.coalesce("snippet", F.lit("")), F.lit(fv.MAX_SNIPPET)).alias("code_snippet"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("fix_principle", F.lit("")).alias("fix_principle"),
        F.coalesce("confidence", F.lit(fv.WEB3_CONFIDENCE)).alias("confidence"),
    )
    order = ["file_path", "line_start", "vulnerability_class", "line_end", "code_snippet"]
    return number_rows(shaped, "project", order, "seq").select(
        "project", "seq",
        fn.finding_id(fn.web3_abbreviation(F.col("vulnerability_class")), F.col("seq")).alias("id"),
        "file_path", "line_start", "line_end", "vulnerability_class",
        fn.web3_severity(F.col("vulnerability_class")).alias("severity"),
        "code_snippet", "description", "fix_principle", "confidence",
        F.lit("MEDIUM").alias("false_positive_risk"), F.lit("web3").alias("track"),
    )
