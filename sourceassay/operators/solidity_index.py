"""The nested Solidity record: one row per file, all facts as arrays.

Every array is computed inside the file's row, so the whole index is a map over
the files: one parse of each text, nothing shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv
from sourceassay.functions import paths
from sourceassay.functions import solidity as sol
from sourceassay.functions.text import py_strip
from sourceassay.operators import corpus, facts, structure

_OPERATION = "array<struct<operator:string,operands:string,line:int,on_uint:boolean>>"
_PARTS = "array<struct<left:string,operator:string,right:string>>"


def _arithmetic(lines: Column) -> Column:
    def of_line(line: Column, i: Column) -> Column:
        found = F.when(sol.has_unchecked_arithmetic(line), sol.arithmetic(line)).otherwise(
            F.array().cast(_PARTS)
        )
        return F.transform(
            found,
            lambda op: F.struct(
                op["operator"].alias("operator"),
                py_strip(F.concat_ws(" ", op["left"], op["operator"], op["right"])).alias("operands"),
                (i + 1).alias("line"),
                sol.mentions_integer(line).alias("on_uint"),
            ),
        )

    return F.flatten(F.transform(lines, of_line))


def _next(rows: Column, at: Column) -> Column:
    """The first of ``rows``, which are ordered by their line, on line ``at`` or behind it; by halving."""
    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc.lo + acc.hi, 1)
        low = F.get(rows, mid)["line"] < at
        return (F.when(acc.lo >= acc.hi, acc).when(low, F.struct((mid + 1).alias("lo"), acc.hi.alias("hi")))
                .otherwise(F.struct(acc.lo.alias("lo"), mid.alias("hi"))))
    n = F.size(rows)
    rounds = F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))).cast("int"))
    return F.get(rows, F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc.lo))


def _reentrancy(functions: Column, calls: Column, writes: Column, n_lines: Column) -> Column:
    """First state write from a function's first call on, its last line left out; calls and writes are ordered by line."""
    called = F.transform(
        functions,
        lambda f: F.struct(
            f["name"].alias("name"), f["line_end"].alias("line_end"),
            F.least(f["line_end"], n_lines).alias("stop"), _next(calls, f["line_start"])["line"].alias("call")),
    )
    written = F.transform(
        F.filter(called, lambda f: f["call"] <= f["line_end"]),
        lambda f: F.struct(f.alias("f"), _next(writes, f["call"]).alias("write")),
    )
    return F.transform(
        F.filter(written, lambda r: r["write"]["line"] < r["f"]["stop"]),
        lambda r: F.struct(
            r["f"]["name"].alias("function"), r["f"]["call"].alias("external_call_line"),
            r["write"]["line"].alias("state_write_line"),
            r["write"]["text"].alias("state_write_text"),
            F.lit("CRITICAL").alias("severity"),
        ),
    )


def sol_files(files: DataFrame, mode: str = "compat") -> DataFrame:
    """Decoded Solidity files -> full records."""
    lines, rows, blocks = F.col("lines"), F.col("rows"), F.col("blocks")
    version = sol.pragma_version(F.col("content"))

    def by_statement(fact):
        return structure.nested_statement_facts(rows, blocks, fact)

    writes = F.filter(
        F.transform(lines, lambda t, i: F.when(
            sol.is_state_write(t, mode),
            F.struct((i + 1).alias("line"), py_strip(t).alias("text")))),
        lambda w: w.isNotNull(),
    )
    parsed = (
        files.withColumn("lines", F.split("content", "\n"))
        .withColumn("parts", structure.pieces(F.col("content"), F.col("language")))
        .withColumn("events", structure.block_events(F.col("parts"), F.col("language")))
        .withColumn("blocks", structure.blocks(F.col("events"), F.col("parts"), F.col("language"))).drop("events")
        .withColumn("rows", structure.nested_statements(F.col("parts")))
        .withColumn("solidity_version", version)
        .withColumn("is_solidity_08_plus", sol.is_08_plus(F.col("solidity_version")))
        .withColumn("functions", by_statement(structure.function_fact))
        .withColumn("by_statement", by_statement(facts.call_statement))
        .withColumn("at", F.transform("by_statement", lambda c: c["line"]))
        # the first statement call per line, then line calls on lines that have none
        .withColumn("external_calls", F.concat(
            F.filter("by_statement", lambda c, i: F.array_position("at", c["line"]) == i + 1),
            F.filter(facts.nested_facts(lines, facts.call_fact),
                     lambda c: ~F.array_contains(F.col("at"), c["line"])),
        ))
        .withColumn("writes", writes)
        .withColumn("call_lines", F.array_sort(F.transform("external_calls", lambda c: F.struct(c["line"].alias("line")))))
    )
    functions = F.col("functions")
    return parsed.select(
        "project",
        F.col("path").alias("path_relative"),
        "language",
        "hash",
        F.col("content").alias("stripped_content"),
        "original_size",
        F.col("original_size").alias("stripped_size"),
        paths.is_test(F.col("path"), "solidity").alias("is_test_file"),
        paths.is_third_party(F.col("path"), "solidity").alias("is_third_party"),
        "solidity_version",
        "is_solidity_08_plus",
        "functions",
        by_statement(structure.variable_fact).alias("state_variables"),
        F.transform(
            F.filter(functions, lambda f: (f["node_type"] == "modifier_definition") & (f["name"] != "")),
            lambda f: F.struct(f["name"].alias("name"), f["parameters"].alias("parameters"),
                               f["line_start"].alias("line_start"), f["line_end"].alias("line_end")),
        ).alias("modifiers"),
        by_statement(structure.event_fact).alias("events"),
        "external_calls",
        F.concat(
            facts.nested_facts(lines, facts.modifier_fact),
            by_statement(facts.auth_statement),
            facts.nested_facts(lines, facts.tx_origin_fact),
        ).alias("access_controls"),
        facts.nested_facts(lines, facts.oracle_fact).alias("oracle_uses"),
        F.when(F.col("is_solidity_08_plus"), F.array().cast(_OPERATION))
        .otherwise(_arithmetic(lines)).alias("arithmetic_ops"),
        _reentrancy(functions, F.col("call_lines"), F.col("writes"), F.size(lines)).alias("reentrancy_risk"),
        F.transform(
            F.filter(functions, lambda f: f["name"].isin(*fv.FLASH_LOAN_RECEIVERS)),
            lambda f: F.struct(f["name"].alias("function"), f["line_start"].alias("line_start"),
                               f["line_end"].alias("line_end"), F.lit(fv.FLASH_LOAN_NOTE).alias("note")),
        ).alias("flash_loan_markers"),
    )


def solidity_index(source_files: DataFrame, mode: str = "compat") -> DataFrame:
    return sol_files(corpus.solidity_sources(source_files), mode)
