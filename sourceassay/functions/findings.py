"""Column functions over findings: severities, abbreviations, ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Small fixed map as a literal: no join, null for unknown keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def web3_severity(vulnerability_class: Column) -> Column:
    return F.coalesce(lookup(vulnerability_class, fv.WEB3_SEVERITIES), F.lit(fv.DEFAULT_SEVERITY))


def promoted_severity(vulnerability_class: Column) -> Column:
    """Severity a rule finding takes when it becomes a manifest finding."""
    return F.coalesce(
        lookup(vulnerability_class, fv.CLASS_SEVERITIES), web3_severity(vulnerability_class)
    )


def class_abbreviation(vulnerability_class: Column) -> Column:
    letters = F.regexp_replace(F.coalesce(vulnerability_class, F.lit("")), "[^A-Za-z0-9]", "")
    fallback = F.coalesce(
        F.nullif(F.upper(F.substring(letters, 1, 6)), F.lit("")), F.lit("UNKNOWN")
    )
    return F.coalesce(lookup(vulnerability_class, fv.CLASS_ABBREVIATIONS), fallback)


def web3_abbreviation(vulnerability_class: Column) -> Column:
    return F.coalesce(lookup(vulnerability_class, fv.WEB3_ABBREVIATIONS), F.lit("UNKN"))


def finding_id(abbreviation: Column, seq: Column) -> Column:
    """At least three digits, never cut off; a negative number counts as 0."""
    return F.format_string(fv.FINDING_ID_FORMAT, abbreviation, F.greatest(seq, F.lit(0)))


def confidence(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(fv.DEFAULT_CONFIDENCE))
