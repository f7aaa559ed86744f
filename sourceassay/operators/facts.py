"""Line and statement facts of Solidity files.

Every fact is a condition plus output columns over one line, so the same
definition serves the exploded tables here and the nested record of a file.
Line facts read the raw text: commented code counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import solidity as sol
from sourceassay.functions.text import py_strip
from sourceassay.operators import structure

Fact = Callable[[Column], tuple[Column, dict[str, Column]]]


def call_fact(line: Column) -> tuple[Column, dict[str, Column]]:
    kind = sol.call_type(line)
    return kind.isNotNull(), {
        "callee": F.lit(""), "method": kind, "call_type": kind, "value": F.lit(""),
        "text": py_strip(line),
    }


def modifier_fact(line: Column) -> tuple[Column, dict[str, Column]]:
    name = sol.owner_modifier(line)
    return name != "", {"type": F.lit("modifier"), "condition": name}


def tx_origin_fact(line: Column) -> tuple[Column, dict[str, Column]]:
    return F.contains(line, F.lit("tx.origin")), {
        "type": F.lit("tx_origin"), "condition": py_strip(line),
    }


def oracle_fact(line: Column) -> tuple[Column, dict[str, Column]]:
    source = sol.oracle_source(line)
    return source.isNotNull(), {"source": source, "identifier": py_strip(line)}


def line_facts(files: DataFrame, fact: Fact) -> DataFrame:
    """Rows of one fact with their line: one scan of the text, no shuffle."""
    lines = structure.explode_lines(files.select("project", "path", "content"))
    condition, columns = fact(F.col("text"))
    return lines.where(condition).select(
        "project", "path", *[c.alias(n) for n, c in columns.items()], "line"
    )


def nested_facts(lines: Column, fact: Fact) -> Column:
    """The same rows as an array inside the file's row."""
    def one(line: Column, i: Column) -> Column:
        condition, columns = fact(line)
        return F.when(
            condition, F.struct(*[c.alias(n) for n, c in columns.items()], (i + 1).alias("line"))
        )

    return F.filter(F.transform(lines, one), lambda s: s.isNotNull())


def call_statement(s: structure.Statement) -> tuple[Column, dict[str, Column]]:
    kind = sol.call_type(s.text)
    return kind.isNotNull(), {
        "callee": sol.call_callee(s.text), "method": kind, "call_type": kind,
        "value": sol.call_value(s.text), "text": s.text,
        "line": s.line,
    }


def statement_calls(files: DataFrame) -> DataFrame:
    """Calls with callee and value, read from whole statements."""
    return structure.statement_facts(files, call_statement, "call|transfer|send")


def external_calls(files: DataFrame) -> DataFrame:
    """Both call detectors; a line only takes the line detector's row if the other has none.

    One row per line: ``min_by`` pre-aggregates, so nothing but the calls moves.
    """
    fields = ("callee", "method", "call_type", "value", "text")
    merged = (
        statement_calls(files).withColumn("prio", F.struct(F.lit(0).alias("d"), "seq")).drop("seq")
        .unionByName(
            line_facts(files, call_fact).withColumn(
                "prio", F.struct(F.lit(1).alias("d"), F.lit(0).alias("seq"))
            )
        )
    )
    return (
        merged.groupBy("project", "path", "line")
        .agg(F.min_by(F.struct(*fields), "prio").alias("call"))
        .select("project", "path", "call.*", "line")
    )


def auth_statement(s: structure.Statement) -> tuple[Column, dict[str, Column]]:
    condition = F.regexp_extract(s.text, r"(?s)\b((?:require|assert)\s*\(.*\))", 1)
    return sol.is_auth_requirement(s.text), {
        "type": F.lit("require"), "condition": condition,
        "line": s.line,
    }


def auth_requirements(files: DataFrame) -> DataFrame:
    """``require`` / ``assert`` statements that look like an authorisation check."""
    return structure.statement_facts(files, auth_statement, "require|assert").drop("seq")


def access_controls(files: DataFrame) -> DataFrame:
    """Modifier uses, then requirements, then tx.origin lines; duplicates stay."""
    parts = [line_facts(files, modifier_fact), auth_requirements(files),
             line_facts(files, tx_origin_fact)]
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2])


def arithmetic_ops(files: DataFrame, gate_version: bool = True) -> DataFrame:
    """Arithmetic on integer lines; files from 0.8 on are left out before the split."""
    if gate_version:
        files = files.where(~sol.is_08_plus(sol.pragma_version(F.col("content"))))
    line = F.col("text")
    return (
        structure.explode_lines(files.select("project", "path", "content"))
        .where(sol.has_unchecked_arithmetic(line))
        .select("project", "path", "line", sol.mentions_integer(line).alias("on_uint"),
                F.posexplode_outer(sol.arithmetic(line)).alias("nth", "op"))
        .where(F.col("op").isNotNull())
        .select(
            "project", "path", "nth", F.col("op.operator").alias("operator"),
            py_strip(F.concat_ws(" ", "op.left", "op.operator", "op.right")).alias("operands"),
            "line", "on_uint",
        )
    )


def flash_loan_markers(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("name").isin(*fv.FLASH_LOAN_RECEIVERS)).select(
        "project", "path", F.col("name").alias("function"), "line_start", "line_end",
        F.lit(fv.FLASH_LOAN_NOTE).alias("note"),
    )


def versions(files: DataFrame) -> DataFrame:
    version = sol.pragma_version(F.col("content"))
    return files.select(
        "project", "path", version.alias("solidity_version"),
        sol.is_08_plus(version).alias("is_solidity_08_plus"),
    )


def state_writes(files: DataFrame, mode: str = "compat") -> DataFrame:
    """Lines that assign to state, with the file's number of lines."""
    lines = F.split("content", "\n")
    return (
        files.select("project", "path", F.size(lines).alias("n_lines"),
                     F.posexplode_outer(lines).alias("pos", "text"))
        .where(sol.is_state_write(F.col("text"), mode))
        .select("project", "path", "n_lines", (F.col("pos") + 1).alias("line"),
                py_strip(F.col("text")).alias("state_write_text"))
    )


#: Lines of a file that meet in one group when calls are looked up in functions.
_LINES = 64


def calls_in_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls inside function ranges.

    A function is laid out over the stretches of ``_LINES`` lines that it touches, so a call only meets
    functions of its own stretch, not all of its file.
    """
    stretch = F.floor(F.col("line") / _LINES)
    laid = functions.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("line_start") / _LINES), F.floor(F.col("line_end") / _LINES))))
    return laid.join(calls.withColumn("stretch", stretch), ["project", "path", "stretch"]).where(
        F.col("line").between(F.col("line_start"), F.col("line_end"))).drop("stretch")


def next_line(rows: DataFrame, at: str, events: DataFrame, name: str, *values: str) -> DataFrame:
    """``rows`` with a struct ``name`` of the first of ``events`` on line ``at`` of the same file or behind it; null if there is none.

    Rows and events of a file are one ordered stream and a row sees the running last event from its far end, so no row meets
    an event that it doesn't get.
    """
    event = F.struct("line", *values)
    stream = rows.select("project", "path", F.col(at).alias("line"), F.struct(*[c for c in rows.columns if c not in ("project", "path")]).alias("row"),
                         F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("event"))
    stream = stream.unionByName(events.select("project", "path", "line", event.alias("event")), allowMissingColumns=True)
    # Events come in front of rows of the same line.
    back = W.partitionBy("project", "path").orderBy(F.col("line").desc(), F.col("event").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (stream.withColumn(name, F.last("event", ignorenulls=True).over(back)).where(F.col("row").isNotNull())
            .select("project", "path", "row.*", name))


def first_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """First external call line of every function that has one."""
    spans = functions.select("project", "path", "seq", F.col("name").alias("function"),
                             "line_start", "line_end")
    found = next_line(spans, "line_start", calls.select("project", "path", "line"), "call")
    return found.where(F.col("call.line") <= F.col("line_end")).select(
        "project", "path", "seq", "function", "line_start", "line_end", F.col("call.line").alias("external_call_line"))


def reentrancy(functions: DataFrame, calls: DataFrame, writes: DataFrame) -> DataFrame:
    """First state write from the first call on, per function; its last line is not looked at."""
    found = next_line(first_calls(functions, calls), "external_call_line", writes, "write", "n_lines", "state_write_text")
    return (
        found.where(F.col("write.line") <= F.least("line_end", "write.n_lines") - 1)
        .select("project", "path", "function", "external_call_line",
                F.col("write.line").alias("state_write_line"),
                F.col("write.state_write_text").alias("state_write_text"),
                F.lit("CRITICAL").alias("severity"))
    )
