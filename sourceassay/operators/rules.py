"""Pattern rules over statements.

A rule is an ordered list of steps inside one scope.  Steps and guards are regular
expressions over a statement; captured groups that have to be equal between them
make up the rule's *binding*.  Matching runs in three moves:

1. files that hold none of the rules' words are dropped before they are parsed,
2. one projection over the statements tags every statement with the steps it
   fits (rule, step, binding); almost everything is dropped right there,
3. the events meet in (rule, file, scope) groups, and windows over each group's
   ordered events point from every step to the next one: every first step that
   completes is a match.

The texts are read and parsed once and only events are shuffled, once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceassay.operators import structure

FOREVER = 2147483647


@dataclass(frozen=True)
class Step:
    """A pattern over one statement.

    ``key`` lists the groups that form the binding; ``None`` fits any binding.
    ``every`` takes all matches of a one-group pattern, not only the first.
    ``has`` / ``lacks`` are further patterns the statement must (not) fit.
    """

    pattern: str
    key: tuple[int, ...] | None = ()
    every: bool = False
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Guard:
    """A pattern that takes matches back.

    ``block``  matches after it, as far as its enclosing block reaches
    ``scope``  matches after it, to the end of the scope
    ``reset``  a sequence under way starts again
    """

    pattern: str
    kind: str
    key: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    track: str
    vulnerability_class: str
    severity: str
    languages: tuple[str, ...]
    words: tuple[str, ...]  # plain texts without any one of which the file cannot match; none spans a blank or a line's end
    steps: tuple[Step, ...]
    message: str
    guards: tuple[Guard, ...] = ()
    cwe: str | None = None
    owasp: str | None = None
    swc: str | None = None
    function: tuple[str, ...] = ()  # patterns the function's header must fit
    not_function: tuple[str, ...] = ()
    inside: str | None = None  # header of some enclosing block, or the statement itself
    not_inside: str | None = None
    not_file: str | None = None  # pattern over the file's code
    per_file: bool = False  # scope is the file, not the function
    needs_guard: bool = False  # guards allow the match instead of taking it back
    to_scope_end: bool = False  # complete only if no guard follows in the scope
    per_binding: bool = False  # a single step counts once per binding

    @property
    def keyed(self) -> bool:
        """Do all steps and guards carry the binding?"""
        parts = (*self.steps, *self.guards)
        return all(p.key for p in parts)


SCRIPT = ("js", "jsx", "ts", "tsx")
SOLIDITY = ("sol",)
PYTHON = ("py",)
MQL = ("mq4", "mq5")

_REF = r"([\w$.]+)"
_DECREMENT = rf"{_REF}\.([\w$]+)\s*-=\s*[\w$.]"
_CALL = r"\.\s*call\s*\{[^}]*\}\s*\("
_ARG = r"(?:[^,()]|\([^()]*\))+"
_ORDER = r"\bbroker\.send_order\s*\("


def _kwarg(name: str) -> str:
    return rf"[(,]\s*{name}\s*="


CATALOGUE: tuple[Rule, ...] = (
    Rule("web2-broken-auth-balance-mutation", "web2", "BROKEN_AUTH", "ERROR", SCRIPT, (".balance", "=", "async", "function"),
         (Step(rf"{_REF}\.balance\s*=[^=]", (1,)),),
         "A balance is assigned in an async function with no check of the caller before it.",
         (Guard(r"\bif\s*\(\s*!\s*[\w$]+\.session\b", "scope"), Guard(r"^require\s*\(", "scope")),
         cwe="CWE-306", owasp="A01:2021", function=(r"\basync\s+function\b",), per_binding=True),
    Rule("web2-broken-auth-balance-decrement", "web2", "BROKEN_AUTH", "ERROR", SCRIPT, (".balance", "-="),
         (Step(rf"{_REF}\.balance\s*-=\s*{_REF}", (1, 2)),),
         "A balance is decremented with no authorisation check around or before it.",
         (Guard(r"^(?:else\s+)?if\s*\(.*\{$", "block"), Guard(r"^require\s*\([^,]*\)\s*;?$", "block")),
         cwe="CWE-306"),
    Rule("web2-unchecked-stripe-before-mutation", "web2", "UNCHECKED_EXTERNAL_CALL", "ERROR", SCRIPT, ("stripe.charges.create", "await", "-="),
         (Step(r"(?:\b(?:const|let|var)\s+(\w+)\s*=\s*)?\bawait\s+stripe\.charges\.create\s*\(", (1,)),
          Step(_DECREMENT, None)),
         "The charge result is not looked at before the balance is decremented.",
         (Guard(r"\bif\s*\(\s*(\w+)\.status\s*!==?\s*[\"']succeeded[\"']", "reset", (1,)),),
         cwe="CWE-754"),
    Rule("web2-unchecked-flutterwave-before-mutation", "web2", "UNCHECKED_EXTERNAL_CALL", "ERROR", SCRIPT, ("flutterwave.", "await", "-="),
         (Step(r"(?:\b(?:const|let|var)\s+(\w+)\s*=\s*)?\bawait\s+flutterwave\.\w+\s*\(", (1,)),
          Step(_DECREMENT, None)),
         "The payment result is not looked at before state is changed.",
         (Guard(r"\bif\s*\(\s*(\w+)\.status\s*!==?\s*[\"']success[\"']", "reset", (1,)),),
         cwe="CWE-754"),
    Rule("web2-double-spend-race", "web2", "DOUBLE_SPEND", "ERROR", SCRIPT, (".balance", "if", "<", "await", "-="),
         (Step(rf"\bif\s*\(\s*{_REF}\.balance\s*<\s*{_REF}\s*\)", (1, 2)),
          Step(r"\bawait\s+[\w$.]+\s*\(", None),
          Step(rf"{_REF}\.balance\s*-=\s*{_REF}", (1, 2))),
         "A balance is checked, an await suspends, and only then the balance is decremented.",
         cwe="CWE-362", owasp="A04:2021"),
    Rule("web2-privilege-escalation-role-from-body", "web2", "PRIVILEGE_ESCALATION", "ERROR", SCRIPT, ("req.body.role", "if"),
         (Step(r"\breq\.body\.role\b"),),
         "An authorisation decision uses a role the caller sends.",
         cwe="CWE-269", owasp="A01:2021", inside=r"\bif\s*\(.*req\.body\.role\b"),
    Rule("web2-privilege-escalation-isadmin-from-body", "web2", "PRIVILEGE_ESCALATION", "ERROR", SCRIPT, ("req.body.isAdmin",),
         (Step(r"\breq\.body\.isAdmin\b"),),
         "An administrator flag is taken from the caller's input.", cwe="CWE-269"),
    Rule("web2-missing-amount-validation", "web2", "MISSING_VALIDATION", "WARNING", SCRIPT, ("req.body.amount", "const", ".balance", "-="),
         (Step(r"\bconst\s+(\w+)\s*=\s*req\.body\.amount\b", (1,)),
          Step(r"\.balance\s*-=\s*(\w+)", (1,))),
         "An amount from the request reaches a balance without a range check.",
         (Guard(r"\bif\s*\(\s*(\w+)\s*<=\s*0", "reset", (1,)),), cwe="CWE-20"),
    Rule("web2-order-completed-without-payment", "web2", "INVALID_STATE_TRANSITION", "WARNING", SCRIPT, (".status", "completed"),
         (Step(rf"{_REF}\.status\s*=\s*[\"']completed[\"']", (1,)),),
         "An order is completed without a payment check around it.", cwe="CWE-840",
         not_inside=r"\bif\s*\(.*\.status\s*===\s*[\"'](?:success|successful)[\"']"),
    Rule("web3-reentrancy-balance-after-call", "web3", "REENTRANCY", "ERROR", SOLIDITY, ("balances[", "call", "-=", "external"),
         (Step(_CALL), Step(r"\bbalances\[[^\]]+\]\s*-=")),
         "A balance is deducted only after the external call.",
         cwe="CWE-841", swc="SWC-107", function=(r"^function\b.*\bexternal\b",)),
    Rule("web3-reentrancy-transfer-after-call", "web3", "REENTRANCY", "ERROR", SOLIDITY, ("balances[", "bool", ".call", "value"),
         (Step(r"\(\s*bool\s+\w+\s*,\s*\)\s*=\s*([\w.]+)\.call\s*\{\s*value\s*:[^}]+\}\s*\(\s*\"\"\s*\)", (1,)),
          Step(r"\bbalances\[([\w.]+)\]\s*=\s*0\s*;", (1,))),
         "A balance is zeroed only after the transfer.",
         (Guard(r"\bbalances\[([\w.]+)\]\s*=\s*0\s*;", "scope", (1,)),),
         cwe="CWE-841", swc="SWC-107"),
    Rule("web3-tx-origin-auth", "web3", "TX_ORIGIN_ABUSE", "ERROR", SOLIDITY, ("tx.origin", "require"),
         (Step(r"\brequire\s*\(\s*tx\.origin\s*==[^,]*\)\s*;"),),
         "Authorisation rests on tx.origin.", cwe="CWE-807", swc="SWC-115"),
    Rule("web3-tx-origin-if", "web3", "TX_ORIGIN_ABUSE", "ERROR", SOLIDITY, ("tx.origin", "if"),
         (Step(r"\bif\s*\(\s*tx\.origin\s*==.*\{$"),),
         "A branch rests on tx.origin.", swc="SWC-115"),
    Rule("web3-unchecked-uint-arithmetic", "web3", "ARITHMETIC_OVERFLOW", "WARNING", SOLIDITY, ("uint", "+"),
         (Step(r"(\w+)\s*\+\s*\w", (1,), every=True),),
         "Integer addition that can wrap before 0.8.",
         (Guard(r"^uint\d*\s+(\w+)\s*;$", "block", (1,)),), swc="SWC-101",
         not_file=r"pragma\s+solidity\s+\^0\.8\.\w", per_file=True, needs_guard=True),
    Rule("web3-missing-owner-guard", "web3", "BROKEN_ACCESS_CONTROL", "ERROR", SOLIDITY, ("withdraw", ".transfer", "external"),
         (Step(r"([\w.()\[\]]+)\.transfer\s*\(([^,()]*)\)", (1, 2)),),
         "Anyone can call this withdrawal.",
         (Guard(r"^require\s*\(\s*msg\.sender\s*==\s*owner\s*,", "scope"),),
         cwe="CWE-284", swc="SWC-105",
         function=(r"^function\s+withdraw\s*\([^)]*\)\s*external\b",),
         not_function=(r"\bonlyOwner\b",), per_binding=True),
    Rule("web3-balance-read-before-update", "web3", "DOUBLE_SPEND", "ERROR", SOLIDITY, ("balances[", "uint", "call", "-"),
         (Step(r"\buint\s+(\w+)\s*=\s*balances\[([^\]]+)\]\s*;", (1, 2)),
          Step(_CALL, None),
          Step(r"\bbalances\[([^\]]+)\]\s*=\s*(\w+)\s*-", (2, 1))),
         "A stale copy of the balance is written back after an external call.", swc="SWC-107"),
    Rule("quant-python-slippage-omission", "quant", "SLIPPAGE_OMISSION", "ERROR", PYTHON, ("broker.send_order", "symbol", "volume", "type"),
         (Step(_ORDER, has=(rf"{_ORDER}(?:\s*(?:symbol|volume|type)\s*=\s*{_ARG},?){{3}}\s*\)",
                            _kwarg("symbol"), _kwarg("volume"), _kwarg("type"))),),
         "A market order is sent without a slippage bound."),
    Rule("quant-python-order-no-retcode-check", "quant", "UNCHECKED_EXTERNAL_CALL", "ERROR", PYTHON, ("broker.send_order", "="),
         (Step(r"^(\w+)\s*=\s*(?:await\s+)?broker\.send_order\s*\(", (1,)),),
         "The order's return code is never looked at.",
         (Guard(r"\bif\s+(\w+)\.retcode\s*!=", "reset", (1,)), Guard(r"\bif\s+not\s+(\w+)\s*:", "reset", (1,))),
         to_scope_end=True),
    Rule("quant-python-unbounded-lot", "quant", "MISSING_VALIDATION", "ERROR", PYTHON, ("broker.send_order", "volume"),
         (Step(r"^(\w+)\s*=\s*\w+\.\w+$", (1,)),
          Step(rf"{_ORDER}.*\bvolume\s*=\s*(\w+)", (1,))),
         "A lot size from outside is used without bounds.",
         (Guard(r"\bif\s+(\w+)\s*<=\s*0", "reset", (1,)), Guard(r"\bif\s+(\w+)\s*>\s*\w", "reset", (1,)))),
    Rule("quant-python-concurrent-order-no-lock", "quant", "RACE_CONDITION", "WARNING", PYTHON, ("self.", "await", "-=", "async"),
         (Step(r"\bawait\s+[\w.]+\.\w+\s*\("), Step(r"^self\.\w+\s*-=")),
         "Shared state changes after an await without a lock.",
         function=(r"^async\s+def\b",), not_inside=r"^async\s+with\s+self\.\w+"),
    Rule("quant-python-missing-stoploss", "quant", "LOGIC_FLAW", "WARNING", PYTHON, ("broker.send_order", "type"),
         (Step(_ORDER, has=(_kwarg("type"),), lacks=(_kwarg("sl"), _kwarg("stop_loss"))),),
         "An order is placed without a stop-loss."),
    Rule("quant-mql-ordersend-no-check", "quant", "UNCHECKED_EXTERNAL_CALL", "ERROR", MQL, ("OrderSend",),
         (Step(rf"^OrderSend\s*\((?:{_ARG},){{6}}{_ARG}\)\s*;$"),),
         "The ticket number is thrown away."),
    Rule("quant-mql-zero-stoploss", "quant", "LOGIC_FLAW", "WARNING", MQL, ("OrderSend", "0"),
         (Step(rf"\bOrderSend\s*\((?:{_ARG},){{5}}\s*0\s*,{_ARG}\)"),),
         "The stop-loss is zero."),
)


#: Every step and guard of a language's rules fits its trigger somewhere, so a
#: statement without one is dropped before any rule looks at it.
TRIGGERS = {
    SCRIPT: r"balance|-=|await|req\.body|\.status|require|\bif\b",
    SOLIDITY: r"call|balances|tx\.origin|\+|uint|transfer|require",
    PYTHON: r"send_order|await|self\.|\bif\b|=\s*\w+\.\w",
    MQL: r"OrderSend",
}


def rules(spark: SparkSession, catalogue: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """The catalogue as a table."""
    rows = [
        (r.rule_id, r.track, r.vulnerability_class, r.severity, r.message, r.cwe, r.owasp, r.swc,
         list(r.languages),
         [(i + 1, s.pattern, [str(k) for k in s.key or ()]) for i, s in enumerate(r.steps)],
         [(g.kind, g.pattern, "file" if r.per_file else "function") for g in r.guards])
        for r in catalogue
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, track string, vulnerability_class string, severity string, message string, "
        "cwe string, owasp string, swc string, languages array<string>, "
        "steps array<struct<no:int,regex:string,binds:array<string>>>, "
        "negations array<struct<kind:string,regex:string,scope:string>>",
    )


def _fits(text: Column, pattern: str, has=(), lacks=()) -> Column:
    test = text.rlike(f"(?s){pattern}")
    for p in has:
        test = test & text.rlike(f"(?s){p}")
    for p in lacks:
        test = test & ~text.rlike(f"(?s){p}")
    return test


def _binding(text: Column, pattern: str, key: tuple[int, ...] | None) -> Column:
    if key is None:
        return F.lit(None).cast("string")
    groups = [F.regexp_extract(text, f"(?s){pattern}", g) for g in key]
    return F.concat_ws("|", *groups) if groups else F.lit("")


_EVENT = "array<struct<rule:int,step:int,kind:string,binding:string>>"


def _event(rule: int, step: int, kind: str, binding: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"),
                    F.lit(kind).alias("kind"), binding.alias("binding"))


def _events(rule: Rule, number: int, text: Column, nothing: Column) -> list[Column]:
    """Event arrays of one rule for a statement: step 0 is a guard."""
    wanted = F.get("worded", F.lit(number))

    def all_matches(step: Step, no: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s){step.pattern}"), F.lit(step.key[0]))
        return F.transform(F.array_distinct(found), lambda m: _event(number, no, "step", m))

    found = []
    for no, s in enumerate(rule.steps, 1):
        matches = (
            all_matches(s, no) if s.every
            else F.array(_event(number, no, "step", _binding(text, s.pattern, s.key)))
        )
        found.append(F.when(wanted & _fits(text, s.pattern, s.has, s.lacks), matches).otherwise(nothing))
    for g in rule.guards:
        matches = F.array(_event(number, 0, g.kind, _binding(text, g.pattern, g.key)))
        found.append(F.when(wanted & _fits(text, g.pattern), matches).otherwise(nothing))
    return found


def _statement_events(catalogue: tuple[Rule, ...], text: Column) -> Column:
    """All events of a statement; only the rules of its language are looked at."""
    nothing = F.array().cast(_EVENT)
    by_language: dict[tuple[str, ...], list[Column]] = {}
    for i, r in enumerate(catalogue):
        by_language.setdefault(r.languages, []).extend(_events(r, i, text, nothing))
    events = None
    for languages, found in by_language.items():
        test, value = F.col("language").isin(*languages), F.flatten(F.array(*found))
        events = F.when(test, value) if events is None else events.when(test, value)
    return events


def _any(blocks: Column, pattern: str) -> Column:
    return F.exists(blocks, lambda b: b.header.rlike(f"(?s){pattern}"))


def _context(rule: Rule) -> Column | None:
    """What must surround a step; None if nothing has to."""
    header = F.coalesce(F.col("fn.header"), F.lit(""))
    tests = [header.rlike(f"(?s){p}") for p in rule.function]
    tests += [~header.rlike(f"(?s){p}") for p in rule.not_function]
    if rule.inside:
        tests.append(F.col("text").rlike(f"(?s){rule.inside}") | _any(F.col("inside"), rule.inside))
    if rule.not_inside:
        tests.append(~_any(F.col("inside"), rule.not_inside))
    if rule.not_file:
        tests.append(~F.col(f"file_{rule.rule_id}"))
    return reduce(lambda a, b: a & b, tests) if tests else None


def tagged_statements(files: DataFrame, catalogue: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Statements that fit some step or guard, one row per event."""
    numbered = list(enumerate(catalogue))
    marks = {f"file_{r.rule_id}": r.not_file for r in catalogue if r.not_file}
    contains = {w: F.contains(F.col("content"), F.lit(w)) for r in catalogue for w in r.words}
    words = F.array(*[reduce(and_, [contains[w] for w in r.words], F.col("language").isin(*r.languages)) for r in catalogue])
    possible = (
        files.where(F.col("language").isin(*sorted({x for r in catalogue for x in r.languages})))
        .withColumn("worded", words)
        .where(F.array_contains("worded", True))
        .select("project", "path", "language", "content", "worded",
                *[F.col("content").rlike(p).alias(n) for n, p in marks.items()])
    )
    text = F.col("text")
    keep = ("project", "path", "language", "worded", *marks)
    events = _statement_events(catalogue, text)

    def triggered(part: Column) -> Column:
        tests = [F.col("language").isin(*languages) & part.rlike(t) for languages, t in TRIGGERS.items()]
        return reduce(lambda a, b: a | b, tests)
    # The generator comes before any filter on the events, so the patterns run once.
    tagged = (
        structure.exploded_parts(
            structure.with_blocks(possible, "worded", *marks), *keep, wanted=triggered)
        .select("project", "path", "language", "inside", *marks, "seq", "part", "text",
                F.explode_outer(events).alias("e"))
        .where(F.col("e").isNotNull())
        .withColumn("line", structure.piece_line(F.col("part")))
        .withColumn("last_line", structure.piece_last_line(F.col("part")))
        .drop("part")
    )
    per_file = [i for i, r in numbered if r.per_file]
    keyed = [i for i, r in numbered if r.keyed]
    context = F.when(F.col("e.step") == 0, True)  # guards count wherever they stand
    for i, test in ((i, _context(r)) for i, r in numbered):
        if test is not None:
            context = context.when(F.col("e.rule") == i, test)
    scoped = structure.with_scope(tagged).where(context.otherwise(True))
    function = F.coalesce(F.col("fn.open_seq"), F.lit(-1))
    return scoped.select(
        "project", "path", "seq", "line", "last_line", "e.rule", "e.step", "e.kind", "e.binding",
        F.when(_one_of("e.rule", per_file), -1).otherwise(function).alias("scope"),
        F.when(_one_of("e.rule", keyed), F.col("e.binding")).alias("own"),
        F.when(F.col("e.kind") == "block", F.col("block_end")).otherwise(FOREVER).alias("until"),
    )


def _one_of(name: str, numbers: list[int]) -> Column:
    return F.col(name).isin(*numbers) if numbers else F.lit(False)


def _chains(events: DataFrame, group: list[str], catalogue: tuple[Rule, ...]) -> DataFrame:
    """Every first step with what guards say about it: covered by one before it, taken back by the next one behind it."""
    def pick(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))

    every, own = [*group], [*group, "binding"]
    ahead, behind = [F.col("seq").desc(), F.col("step").asc()], [F.col("seq").asc(), F.col("step").desc()]
    cover = F.when((F.col("step") == 0) & (F.col("kind") != "reset"), F.col("until"))
    reset = F.when((F.col("step") == 0) & (F.col("kind") == "reset"), F.col("seq"))
    wild = F.col("binding").isNull()
    def last(value, part, order):
        return F.last(value, ignorenulls=True).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    def widest(value, part):
        return F.max(value).over(W.partitionBy(*part).orderBy(*behind).rowsBetween(W.unboundedPreceding, -1))
    return (
        events.withColumn("steps", pick([len(r.steps) for r in catalogue]))
        # Groups without a last step can't hold a match.
        .withColumn("complete", F.max(F.col("step") == F.col("steps")).over(W.partitionBy(*every))).where("complete")
        .withColumn("covered", F.greatest(widest(F.when(wild, cover), every), widest(F.when(~wild, cover), own)))
        .withColumn("reset", F.least(last(F.when(wild, reset), every, ahead), last(F.when(~wild, reset), own, ahead)))
        .where("step > 0")
        .withColumn("needs_guard", pick([r.needs_guard for r in catalogue]))
        .withColumn("chain", (F.col("step") == 1) & (F.coalesce(F.col("covered") >= F.col("seq"), F.lit(False)) == F.col("needs_guard")))
        .where(F.col("chain") | (F.col("step") > 1))
        .drop("complete", "covered", "needs_guard", "kind", "until")
    )


def match_events(events: DataFrame, catalogue: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Events -> matches, one row for each first step that completes.

    A chain starts at every first step that no guard covers.  Its next step is the nearest event behind it that fits, found by a
    window over the events of one rule and scope; k steps take k - 1 such pointers.  A guard that resets breaks the
    chains under way.  Windows spill, so neither a function nor a file of a single scope has to fit in memory.
    Rules ``per_binding`` report their first match of a binding.
    """
    group = ["rule", "project", "path", "scope", "own"]

    def pick(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))

    rows = _chains(events, group, catalogue)
    steps_of = [r.steps for r in catalogue]
    for no in range(2, max((len(s) for s in steps_of), default=1) + 1):
        # Where the step is keyed only those of the chain's binding count, any other one fits all bindings.  What is behind a row is
        # read as the running last one from the far end; of one statement later steps come first, so it can't take two.
        keyed = pick([len(s) >= no and s[no - 1].key is not None for s in steps_of])
        back = W.partitionBy(*group, "link").orderBy(F.col("seq").desc(), F.col("step").asc()).rowsBetween(W.unboundedPreceding, -1)
        target = F.when(~F.col("chain") & (F.col("step") == no), F.struct("seq", "last_line"))
        onward = F.col("chain") & (F.col("steps") >= no)
        # The chain goes on from the place that its pointer shows, with its own binding; it ends if there is none.
        rows = (rows.withColumn("link", F.when(keyed, F.col("binding"))).withColumn("ahead", F.last(target, ignorenulls=True).over(back))
                .where(~onward | F.col("ahead").isNotNull())
                .withColumns({"seq": F.when(onward, F.col("ahead.seq")).otherwise(F.col("seq")),
                              "last_line": F.when(onward, F.col("ahead.last_line")).otherwise(F.col("last_line")),
                              "step": F.when(onward, no).otherwise(F.col("step"))}))
    whole, reset = pick([r.to_scope_end for r in catalogue]), F.col("reset")
    kept = rows.where(F.col("chain") & (reset.isNull() | (~whole & (reset >= F.col("seq")))))
    first = pick([r.per_binding and len(r.steps) == 1 for r in catalogue])
    earlier = F.row_number().over(W.partitionBy(*group, "binding").orderBy("seq"))
    kept = kept.withColumn("number", earlier).where(~first | (F.col("number") == 1))
    return kept.select("rule", "project", "path", F.col("line").alias("line_start"), F.col("last_line").alias("line_end"))


def match_rules(files: DataFrame, catalogue: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """Findings of a rule catalogue over decoded files of every language."""
    matches = match_events(tagged_statements(files, catalogue), catalogue)

    def fact(name: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, name)) for r in catalogue]), F.col("rule"))

    return matches.select(
        fact("rule_id").alias("rule_id"), "project", F.col("path").alias("file_path"),
        "line_start", "line_end", fact("message").alias("message"),
        fact("severity").alias("severity"), fact("vulnerability_class").alias("vulnerability_class"),
    )
