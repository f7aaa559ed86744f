import random

import pytest
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import findings, paths, solidity, text


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def strip_by_hand(s):
    """Character scanner: the same rules without a regular expression."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c in "\"'`":
            j = i + 1
            while j < len(s) and s[j] != c:
                j += 2 if s[j] == "\\" else 1
            if j < len(s):
                out.append(s[i:j + 1])
                i = j + 1
                continue
        elif s.startswith("//", i):
            end = s.find("\n", i)
            i = len(s) if end < 0 else end
            continue
        elif s.startswith("/*", i):
            end = s.find("*/", i + 2)
            if end >= 0:
                out.append(" ")
                i = end + 2
                continue
        out.append(c)
        i += 1
    return "".join(out)


def test_strip_comments_equals_scanner(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab\"'`/*\\ \n\t;") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert apply(spark, text.strip_comments, texts) == [strip_by_hand(t) for t in texts]


@pytest.mark.parametrize("before, after", [
    ('a="//x"; // y', 'a="//x"; '),
    ("foo/* c */bar", "foo bar"),
    ('a = "b // c', 'a = "b '),
    ("a /* b", "a /* b"),
])
def test_strip_comments_cases(spark, before, after):
    assert apply(spark, text.strip_comments, [before]) == [after]


def test_long_literal(spark):
    long = '"' + "x" * 200_000 + '"'
    assert apply(spark, text.strip_comments, [long + "// tail"]) == [long]


def test_normalise(spark):
    got = apply(spark, text.normalise, ["\n\na \t b  \n\n\n\nc // d\r\n\n"])
    assert got == ["a b\n\nc"]


def test_py_strip_equals_python(spark):
    values = ["\u00a0 a \u2003", "\x1c\x85b\u3000", " c\x0b"]
    assert apply(spark, text.py_strip, values) == [v.strip() for v in values]


def test_paths(spark):
    assert apply(spark, paths.language, ["src/.js", "A.JS", "a.test.ts", "a.sol", "b"]) == [None, None, "ts", "sol", None]
    assert apply(spark, paths.is_test, ["latest/a.js", "a.test.ts"]) == [True, False]
    assert apply(spark, lambda c: paths.is_test(c, "solidity"), ["a.test.sol"]) == [True]
    assert apply(spark, lambda c: paths.pruned_dir(c, fv.GENERAL_IGNORED_DIRS),
                 ["a/dist/b/dist/c.js", "dist.js", "x/dist"]) == ["a/dist", "", ""]
    assert apply(spark, paths.is_relative, ["a/b", "/a", "C:\\a", "\\\\s\\x", "~/a", "", None]) == [
        True, False, False, False, False, False, False]


def test_versions(spark):
    values = ["^0.8.19", "^0.8", ">=0.7.0 <0.9.0", "0.10.1", None]
    assert apply(spark, solidity.is_08_plus, values) == [True, False, False, True, False]
    assert apply(spark, solidity.pragma_version, ["pragma solidity  ^0.8.1 ;", "x"]) == ["^0.8.1", None]


def test_call_shapes(spark):
    lines = ["x.call(d)", 'x.call{value: 1}("")', "t.transfer(a)", "y . send (1)"]
    assert apply(spark, solidity.call_type, lines) == [None, "call", "transfer", "send"]


def test_state_write_modes(spark):
    lines = ["balances[msg.sender] -= a;", "require(ok == true);", "balances(x) = 1", "f(x);"]
    assert apply(spark, solidity.is_state_write, lines) == [False, True, True, False]
    assert apply(spark, lambda c: solidity.is_state_write(c, "indexed"), lines) == [True, True, True, False]


def test_arithmetic_equals_python(spark):
    import re

    pattern = re.compile(r"(\w[\w.\[\]]*)\s*(\+\+|--|\+=|-=|\*=|/=|\+|-|\*|/)\s*([\w.\[\]]*)")
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab1.[] +-*/=;") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    got = apply(spark, solidity.arithmetic, lines)
    assert [[tuple(x) for x in g] for g in got] == [pattern.findall(x) for x in lines]


def test_finding_ids(spark):
    rows = spark.createDataFrame(
        [(1, "BROKEN_AUTH", 7), (2, "SETTLEMENT_BYPASS", 1234), (3, "", -1), (4, "UNCHECKED_EXTERNAL_CALL", 0)],
        "i int, c string, s int")
    got = rows.select("i", findings.finding_id(findings.class_abbreviation(F.col("c")), F.col("s"))).orderBy("i")
    assert [r[1] for r in got.collect()] == ["FSA-BAUTH-007", "FSA-SETTLE-1234", "FSA-UNKNOWN-000", "FSA-UNCHK-000"]
