import pytest

from sourceassay.operators import rules
from sourceassay.plans import demo_corpus


def hits(files, code):
    rows = rules.match_rules(code(files)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.file_path, set()).add((r.rule_id, r.line_start, r.line_end))
    return found


def js(body):
    return "async function f(req, acct) {\n" + "\n".join("    " + x for x in body) + "\n}\n"


CASES = {
    # rule -> (positive, negative ...); the file's language follows from the rule
    "web2-broken-auth-balance-mutation": (["acct.balance = 0;"], ["if (!req.session) { return; }", "acct.balance = 0;"],
                                          ["require(ok);", "acct.balance = 0;"]),
    "web2-broken-auth-balance-decrement": (["acct.balance -= amount;"], ["if (isOwner) {", "acct.balance -= amount;", "}"],
                                           ["require(isOwner);", "acct.balance -= amount;"]),
    "web2-unchecked-stripe-before-mutation": (
        ["await stripe.charges.create({ amount,", " currency });", "acct.balance -= amount;"],
        ["const r = await stripe.charges.create(c);", 'if (r.status !== "succeeded") { return; }', "acct.balance -= amount;"]),
    "web2-unchecked-flutterwave-before-mutation": (
        ["await flutterwave.transfer(c);", "acct.balance -= amount;"],
        ["const r = await flutterwave.transfer(c);", "if (r.status !== 'success') { return; }", "acct.balance -= amount;"]),
    "web2-double-spend-race": (
        ["if (acct.balance < amount) { return; }", "await pay(x);", "acct.balance -= amount;"],
        ["if (acct.balance < amount) { return; }", "acct.balance -= amount;", "await pay(x);"],
        ["if (acct.balance < amount) { return; }", "await pay(x);", "other.balance -= amount;"]),
    "web2-privilege-escalation-role-from-body": (['if (req.body.role === "admin") { grant(); }'], ["const q = req.body.role;"]),
    "web2-privilege-escalation-isadmin-from-body": (["if (req.body.isAdmin) { grant(); }"], ["if (req.session.isAdmin) { grant(); }"]),
    "web2-missing-amount-validation": (
        ["const amount = req.body.amount;", "acct.balance -= amount;"],
        ["const amount = req.body.amount;", "if (amount <= 0) { return; }", "acct.balance -= amount;"],
        ["const amount = req.body.amount;", "acct.balance -= price;"]),
    "web2-order-completed-without-payment": (
        ['order.status = "completed";'],
        ['if (payment.status === "success") {', 'order.status = "completed";', "}"],
        ['if (payment.status === "successful") {', 'order.status = "completed";', "}"]),
}


@pytest.fixture(scope="module")
def script_hits(code):
    files = {f"r{i}_{n}.js": js(body) for i, case in enumerate(CASES.values()) for n, body in enumerate(case)}
    return hits(files, code)


@pytest.mark.parametrize("i, rule", list(enumerate(CASES)))
def test_script_rules(script_hits, i, rule):
    for n in range(len(CASES[rule])):
        found = {r for r, _, _ in script_hits.get(f"r{i}_{n}.js", ())}
        assert (rule in found) == (n == 0), (rule, n)


def test_guard_only_reaches_to_the_end_of_its_block(code):
    nested = js(["for (const a of b) {", "if (a) { log(); }", "}", "acct.balance -= amount;"])
    found = hits({"a.js": nested}, code)["a.js"]
    assert ("web2-broken-auth-balance-decrement", 5, 5) in found


def test_steps_do_not_cross_functions(code):
    two = "async function a() {\n if (x.balance < n) { return; }\n await p(1);\n}\nasync function b() {\n x.balance -= n;\n}\n"
    assert "web2-double-spend-race" not in {r for r, _, _ in hits({"a.js": two}, code).get("a.js", ())}


def test_multi_line_order(code):
    text = "def go(self):\n    broker.send_order(\n        symbol=s,\n        volume=v,\n        type=t,\n    )\n"
    found = hits({"a.py": text}, code)["a.py"]
    assert ("quant-python-slippage-omission", 2, 6) in found
    assert ("quant-python-missing-stoploss", 2, 6) in found


def test_lock_and_order(code):
    held = "async def f(self):\n    async with self.lock:\n        await b.buy(x)\n        self.balance -= a\n"
    free = "async def f(self):\n    await b.buy(x)\n    self.balance -= a\n"
    found = hits({"held.py": held, "free.py": free}, code)
    assert ("quant-python-concurrent-order-no-lock", 2, 3) in found["free.py"]
    assert "held.py" not in found


def test_comments_do_not_match(code):
    assert hits({"a.js": js(["// acct.balance = 0;", "/* req.body.isAdmin */"])}, code) == {}


def test_every_rule_word_and_trigger_fits_its_scenarios():
    """A word or trigger that is too narrow would silently lose matches."""
    families = {rules.SCRIPT: demo_corpus.JS_SCENARIOS, rules.SOLIDITY: demo_corpus.SOL_SCENARIOS,
                rules.PYTHON: demo_corpus.PY_SCENARIOS, rules.MQL: demo_corpus.MQ_SCENARIOS}
    import re
    for rule in rules.CATALOGUE:
        trigger = re.compile(rules.TRIGGERS[rule.languages])
        for _, lines in families[rule.languages]:
            for part in (*rule.steps, *rule.guards):
                for line in lines:
                    if re.search(part.pattern, line.strip()):
                        assert trigger.search(line), (rule.rule_id, line)


def test_catalogue(spark):
    table = rules.rules(spark)
    assert table.count() == 23 and table.select("rule_id").distinct().count() == 23


STRIPE = "web2-unchecked-stripe-before-mutation"


def test_every_first_step_that_completes_is_a_match(code):
    two = js(["await stripe.charges.create(a);", "acct.balance -= one;", "await stripe.charges.create(b);", "acct.balance -= two;"])
    shared = js(["await stripe.charges.create(a);", "await stripe.charges.create(b);", "acct.balance -= one;"])
    race = js(["if (x.balance < n) { return; }", "await pay(1);", "x.balance -= n;", "if (x.balance < n) { return; }", "if (y.balance < n) { return; }",
               "await pay(2);", "y.balance -= n;", "x.balance -= n;"])
    found = hits({"two.js": two, "shared.js": shared, "race.js": race}, code)
    assert {h for h in found["two.js"] if h[0] == STRIPE} == {(STRIPE, 2, 3), (STRIPE, 4, 5)}
    assert {h for h in found["shared.js"] if h[0] == STRIPE} == {(STRIPE, 2, 4), (STRIPE, 3, 4)}
    assert {h[1:] for h in found["race.js"] if h[0] == "web2-double-spend-race"} == {(2, 4), (5, 9), (6, 8)}


def test_a_reset_breaks_only_the_chains_under_way(code):
    body = ["const r = await stripe.charges.create(a);", "acct.balance -= one;", "const r = await stripe.charges.create(b);",
            'if (r.status !== "succeeded") { return; }', "acct.balance -= two;", "const s = await stripe.charges.create(c);",
            'if (r.status !== "succeeded") { return; }', "acct.balance -= three;"]
    found = hits({"a.js": js(body)}, code)["a.js"]
    assert {h[1:] for h in found if h[0] == STRIPE} == {(2, 3), (7, 9)}


def test_orders_are_checked_one_by_one(code):
    text = ("def f(self):\n    a = broker.send_order(x)\n    if a.retcode != 0:\n        return\n    a = broker.send_order(y)\n"
            "    b = broker.send_order(z)\n    c = broker.send_order(z)\n    if not b:\n        return\n")
    found = hits({"a.py": text}, code)["a.py"]
    assert {h[1:] for h in found if h[0] == "quant-python-order-no-retcode-check"} == {(5, 5), (7, 7)}


def test_sequences_match_a_walk_over_the_events(spark):
    """Random events of all rules against chains followed one by one in Python."""
    import random
    draw = random.Random(7)
    catalogue = rules.CATALOGUE
    rows = []
    for scope in range(40):
        for number, rule in enumerate(catalogue):
            for _ in range(draw.choice([0, 3, 12])):
                part = draw.choice([(n, s.key) for n, s in enumerate(rule.steps, 1)] * 2 + [(0, g) for g in rule.guards])
                kind = "step" if part[0] else part[1].kind
                key = part[1] if part[0] else part[1].key
                seq = draw.randrange(20)
                binding = None if key is None else draw.choice("ab") if key else ""
                until = seq + draw.randrange(6) if kind == "block" else rules.FOREVER
                rows.append((number, "p", "f", scope, binding if rule.keyed else None, seq, seq + 1, seq + 1, part[0], kind, binding, until))
    rows = list(dict.fromkeys(rows))
    schema = ("rule int, project string, path string, scope int, own string, seq int, line int, last_line int, step int, kind string, "
              "binding string, until int")
    found = rules.match_events(spark.createDataFrame(rows, schema)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[3], r[4]), []).append(r)
    want = []
    for (number, _, _), events in groups.items():
        rule, seen = catalogue[number], set()
        for e in sorted(e for e in events if e[8] == 1):
            fits = [x for x in events if x[10] is None or x[10] == e[10]]
            covered = any(x[8] == 0 and x[9] != "reset" and x[5] < e[5] <= x[11] for x in fits)
            resets = [x[5] for x in fits if x[9] == "reset" and x[5] >= e[5]]
            at = e[5]
            for no in range(2, len(rule.steps) + 1):
                at = min((x[5] for x in fits if x[8] == no and at is not None and x[5] > at), default=None)
            if covered != rule.needs_guard or at is None or (resets and (rule.to_scope_end or min(resets) < at)):
                continue
            if rule.per_binding and e[10] in seen:
                continue
            seen.add(e[10])
            want.append((number, e[6], at + 1))
    assert sorted((r["rule"], r.line_start, r.line_end) for r in found) == sorted(want) and len(want) > 300
