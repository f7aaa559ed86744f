"""Column functions over Solidity sources and single source lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions.paths import contains_any


def pragma_version(source: Column) -> Column:
    """Text of the first ``pragma solidity``; null when there is none."""
    found = F.regexp_extract(source, r"pragma\s+solidity\s+([^;]+);", 1)
    return F.nullif(F.btrim(found, F.lit(fv.PYTHON_WHITESPACE)), F.lit(""))


def is_08_plus(version: Column) -> Column:
    """First ``0.<minor>.`` is 8 or more; ``^0.8`` without a patch part is not."""
    minor = F.nullif(F.regexp_extract(version, r"0\.(\d+)\.", 1), F.lit(""))
    return F.coalesce(minor.try_cast("bigint") >= 8, F.lit(False))


def call_type(line: Column) -> Column:
    """External-call type of a line, the first that fits in the fixed order."""
    cases = [F.when(line.rlike(pattern), name) for name, pattern in fv.CALL_PATTERNS.items()]
    return F.coalesce(*cases)


def call_callee(statement: Column) -> Column:
    """Expression the call is made on, with the method name."""
    names = "|".join(fv.CALL_PATTERNS)
    return F.regexp_extract(statement, rf"([\w.\[\]()]+\.\s*(?:{names}))\s*[{{(]", 1)


def call_value(statement: Column) -> Column:
    """Ether sent along: what follows ``value:`` in the call options."""
    return F.btrim(
        F.regexp_extract(statement, r"value\s*:\s*([^,}]+)", 1), F.lit(fv.PYTHON_WHITESPACE)
    )


def owner_modifier(line: Column) -> Column:
    """First owner/role modifier named on the line, '' when none is."""
    return F.regexp_extract(line, rf"\b({'|'.join(fv.OWNER_MODIFIERS)})\b", 1)


def is_auth_requirement(statement: Column) -> Column:
    return statement.rlike(r"\b(require|assert)\s*\(") & contains_any(statement, fv.AUTH_KEYWORDS)


def oracle_source(line: Column) -> Column:
    """Kind of price source named on the line; null when none is."""
    return (
        F.when(contains_any(line, fv.CHAINLINK_FRAGMENTS), "chainlink")
        .when(contains_any(line, fv.UNISWAP_FRAGMENTS), "uniswap")
        .when(line.rlike(r"\.balanceOf\s*\("), "balanceof")
        .when(line.rlike(r"\bTWAP\b|\btwap\b|\bTimeWeighted\b"), "twap")
    )


def mentions_integer(line: Column) -> Column:
    return line.rlike(r"\buint\d*\b|\bint\d*\b")


# A run of operand characters can only start an operation at its first word
# character, so the search anchors there and never backtracks into the run.
_RUN = r"[\w.\[\]]"
ARITHMETIC = (
    rf"(?<!{_RUN})[.\[\]]*+(\w{_RUN}*+)\s*+(\+\+|--|\+=|-=|\*=|/=|\+|-|\*|/)\s*+({_RUN}*+)"
)


def arithmetic(line: Column) -> Column:
    """All arithmetic operations of a line as ``array<struct<left, operator, right>>``."""
    groups = [F.regexp_extract_all(line, F.lit(ARITHMETIC), F.lit(g)) for g in (1, 2, 3)]
    return F.arrays_zip(
        groups[0].alias("left"), groups[1].alias("operator"), groups[2].alias("right")
    )


def has_unchecked_arithmetic(line: Column) -> Column:
    """Gate in front of :func:`arithmetic`: integer line or compound operator, no safe wrapper."""
    return (mentions_integer(line) | contains_any(line, fv.COMPOUND_OPERATORS)) & ~contains_any(
        line, ("SafeMath", ".add(", ".sub(")
    )


def is_state_write(line: Column, mode: str = "compat") -> Column:
    """Line that assigns to state.

    ``compat`` keeps two known quirks: ``balances[x] -= y`` is missed because the
    text between bracket and operator has to end in ``)``, and any ``word ==`` is
    taken for a write.  ``indexed`` also accepts ``]`` before the operator.
    """
    close = r"[\])]" if mode == "indexed" else r"\)"
    named = rf"\b(?:{'|'.join(fv.STATE_NAMES)})\s*[\[(].*?{close}\s*[-+*/]?="
    return line.rlike(rf"(?s){named}|\b\w+\s*[-+*/]?=")
