"""Signatures that follow values through assignments, aliases, calls and returns of script functions.

A value lives in a node: a definition (``d<seq>``), a parameter (``p<fn>.<nth>``), what a function returns (``r<fn>``), a field
of the request body (``b<fn>.<name>``), or a name the function doesn't define (``v<fn>.<name>``).  Every read of a name points
to the nearest definition in front of it, so there are no more edges than reads.  Calls lead from
arguments to the parameters of the functions of that name in the same file, returns lead back.  What a source reaches is
a least fixpoint within the file.  No value leaves its file, so a file is read and followed in its own row (``script_flow``) and
only matches are shuffled.

The reading is lexical.  A definition inside a block of its function may not happen, so it keeps the value before it as well.
Unnamed functions belong to the function around them; code outside of functions is a function of its own.  Destructuring
assignments and assignments behind a condition without braces define nothing; calls may be nested three deep.  Null contents and
empty tables give no rows, files that repeat in full give their matches once, further columns of ``files`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.functions.sizing import written
from sourceassay.operators import rules, script_flow

#: a state is (file, source, its function, node, place in the source's function)
_STATE = ["project", "path", "source", "home", "node", "pos"]
_FILE = ["project", "path"]
_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
_MATCH = ("project string, path string, fn string, vulnerability_class string, line_start int, line_end int, field string, "
          "source string, seq int")
_MATCH_TYPES = {"project": pa.string(), "path": pa.string(), "fn": pa.string(), "vulnerability_class": pa.string(),
                "line_start": pa.int32(), "line_end": pa.int32(), "field": pa.string(), "source": pa.string(), "seq": pa.int32()}


class Flow(NamedTuple):
    """Script files whose values are followed: ``project, path, content``."""

    files: DataFrame


def flow(files: DataFrame) -> Flow:
    """All script files with a text."""
    return Flow(files.where(F.col("language").isin(*rules.SCRIPT) & F.col("content").isNotNull()).select(*_FILE, "content"))


def _finder(name: str, types: dict = _MATCH_TYPES, most: int = 20_000):
    """Matches of one signature, file by file.

    Built here so that it travels to the workers by value.
    """
    find, reading = getattr(script_flow, name), script_flow.reading
    kind = name.upper()
    names = list(types)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for project, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                # Rows without a file's whole name meet no others, so of them only what asks no other row is known.
                named = project is not None and path is not None
                if not named and kind != "UNCHECKED_EXTERNAL_CALL":
                    continue
                file = reading(content)
                for source, seq, fn, start, end, field in find(file) if named else find(file, followed=False):
                    yield project, path, fn, kind, start, end, field, source, seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while piece := list(islice(rows, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), types.values())], names=names)
    return run


def _matches(f: Flow, name: str) -> DataFrame:
    """Matches of files that repeat in full count once."""
    return f.files.mapInArrow(_finder(name), _MATCH).distinct().drop("source", "seq")


def _follower(names: tuple[str, ...], types: tuple, most: int = 20_000):
    """Rows of whole files, edges first, then seeds by source; holds the edges of one file and the states of one of its sources.

    Built here so that it travels to the workers by value.
    """
    ends = script_flow.ends

    def followed(rows: Iterator[tuple]) -> Iterator[tuple]:
        here, onward = None, {}
        for (project, path, seed, source, home), group in groupby(rows, lambda row: row[:5]):
            if (project, path) != here:
                here, onward = (project, path), {}
            if not seed:
                for *_, node, pos, to, fn_seq in group:
                    onward.setdefault(node, []).append((to, fn_seq, pos))
            else:
                for state in ends([(node, pos) for *_, node, pos, _, _ in group], onward, home):
                    yield (project, path, source, home, *state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = followed(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        while piece := list(islice(rows, most)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), types)], names=list(names))
    return run


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All states that ``seeds`` lead to, themselves included.

    ``pos`` is the statement of the source's function at which a value arrives, also where it goes on in functions called there.
    No value leaves its file, so edges and seeds are dealt by file, once, and every source is followed to its end where they meet.
    """
    col = F.col
    none = {k: F.lit(None).cast(t).alias(k) for k, t in (("source", "string"), ("home", "int"), ("to", "string"), ("fn_seq", "int"))}
    known = edges.where("project is not null and path is not null and node is not null").select(
        *_FILE, F.lit(False).alias("seed"), none["source"], none["home"], "node", col("seq").alias("pos"), "to", "fn_seq")
    asked = seeds.select(*_FILE, F.lit(True).alias("seed"), "source", "home", "node", "pos", none["to"], none["fn_seq"])
    dealt = known.unionByName(asked).repartition(*_FILE).sortWithinPartitions(*_FILE, "seed", "source", "home")
    return written(dealt.mapInArrow(_follower(tuple(_STATE), _TYPES), seeds.select(*_STATE).schema), "reached")


def missing_validation(f: Flow) -> DataFrame:
    """Fields of the request body that reach a balance with no bounds check on any alias before it."""
    return _matches(f, "missing_validation")


def unchecked_external_call(f: Flow) -> DataFrame:
    """Awaited calls whose result, or what comes of it, meets no check before the next change of a balance."""
    return _matches(f, "unchecked_external_call").drop("field")


def broken_access_control(f: Flow) -> DataFrame:
    """Changes of a balance with no ownership check on an alias of its object earlier in the function."""
    return _matches(f, "broken_access_control").drop("field")
