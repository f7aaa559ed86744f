"""Column functions over whole source texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceassay.fixed_values import PYTHON_WHITESPACE


def _quoted(q: str) -> str:
    # Possessive and unrolled: linear time, no recursion in the regex engine on
    # long literals.
    return rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}"


#: One match per string literal, comment or run of anything else.
C_TOKENS = (
    "(?s)" + "|".join(_quoted(q) for q in ('"', "'", "`")) + r"|//[^\n]*+|/\*.*?\*/|[^\"'`/]++|."
)
#: The same for matching code: a quoted literal ends with its line, so an apostrophe in markup hides nothing,
#: and a regex literal is one token.  A slash starts one only where an operand is expected.
CODE_TOKENS = (
    "(?s)" + "|".join(rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}" for q in ('"', "'")) + "|" + _quoted("`")
    + r"|//[^\n]*+|/\*.*?\*/"
    + r"|(?<=[(,=:\[!&|?;{}]\s{0,2})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
    + r"|[^\"'`/]++|."
)
PY_TOKENS = (
    r'(?s)""".*?"""|' + r"'''.*?'''|" + _quoted('"') + "|" + _quoted("'") + r"|#[^\n]*+|[^\"'#]++|."
)


def tokens(content: Column, pattern: str = C_TOKENS) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def strip_comments(content: Column) -> Column:
    """Line comments vanish, block comments become one blank, literals stay."""
    kept = F.transform(
        tokens(content),
        lambda t: F.when(F.startswith(t, F.lit("//")), F.lit(""))
        .when(F.startswith(t, F.lit("/*")), F.lit(" "))
        .otherwise(t),
    )
    commented = F.contains(content, F.lit("//")) | F.contains(content, F.lit("/*"))
    return F.when(commented, F.array_join(kept, "")).otherwise(content)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def strip_line_ends(text: Column) -> Column:
    """Drop blanks before every newline and at the very end."""
    return F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")


def squeeze_newlines(text: Column) -> Column:
    """At most one empty line in a row, none at either end."""
    return F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit("\n"))


def normalise(content: Column) -> Column:
    return squeeze_newlines(strip_line_ends(collapse_blanks(strip_comments(content))))


def py_strip(col: Column) -> Column:
    """Strip every Unicode blank, not only U+0020 as ``trim`` does."""
    return F.btrim(col, F.lit(PYTHON_WHITESPACE))


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def utc_iso(ts: Column) -> Column:
    """ISO-8601 with a ``Z``; the session time zone has to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
