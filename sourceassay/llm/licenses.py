"""Operator 4, license scan: fuzzy search for short notices.

A notice may be written with a few errors.  By the pigeonhole principle one of ``errors + 1`` parts of the notice
then stands in the text unchanged: an automaton finds all such seeds in one pass over the text, each seed
points at the window in which its notice may lie, and the regex library's bounded-error matching
verifies the window and gives the span.  Windows that share too few 4-grams with the notice to hold it are passed over (the
q-gram lemma: no match is lost).  Notices are searched in a view of the text in which white space and the marks at the beginnings of lines
are one space, and spans are mapped back.  Phrases of consecutive words are found exactly besides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name
from sourceassay.llm.words import ALNUM, word_list

# Phrases of words and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, lower case, and their labels; written from the well-known wording of each license's notice.
NOTICES = {
    "this work is licensed under the gnu general public license, version 3": "notice-gpl-3",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license": "notice-gpl",
    "licensed under the apache license, version 2.0": "notice-apache-2.0",
    "released under the mit license": "notice-mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software": "notice-mit",
    "redistribution and use in source and binary forms, with or without modification, are permitted": "notice-bsd",
    "licensed under cc by-nc 4.0": "notice-cc-by-nc-4.0",
    "licensed under a creative commons attribution 4.0 international license": "notice-cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "notice-mpl",
    "all rights reserved": "notice-all-rights-reserved",
}
#: One error for so many characters of a notice, and the most errors of a notice.
CHARS_PER_ERROR, MOST_ERRORS = 10, 6
FOUND = ("struct<n_words:long,places:array<struct<word:long,label:string>>,"
         "spans:array<struct<start:long,end:long,label:string,errors:int>>,score:double>")

#: White space; behind a line break also what comments begin their lines with.
_GAP = regex.compile(r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D/*#;%|>!-]*|[\x20\x09-\x0D]+")
_GRAM = 4
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def allowed_errors(notice: str) -> int:
    return min(MOST_ERRORS, len(notice) // CHARS_PER_ERROR)


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` parts of nearly equal length that make up the notice, with their offsets."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class View:
    """A text with one space for each gap, and the way back to places of the text."""

    def __init__(self, text: str):
        self.at, self.gaps, parts, done, size = [], [], [], 0, 0
        for gap in _GAP.finditer(text):
            a, b = gap.span()
            if b - a > 1 or text[a] != " ":
                parts += (text[done:a], " ")
                size += a - done + 1
                done = b
                self.at.append(size - 1)
                self.gaps.append((a, b))
        parts.append(text[done:])
        self.text = "".join(parts)

    def start(self, place: int) -> int:
        """Where the character at ``place`` of the view begins in the text."""
        k = bisect_left(self.at, place)
        if k < len(self.at) and self.at[k] == place:
            return self.gaps[k][0]
        return place if k == 0 else self.gaps[k - 1][1] + place - self.at[k - 1] - 1

    def end(self, place: int) -> int:
        """Where the character in front of ``place`` ends in the text."""
        k = bisect_left(self.at, place - 1)
        if k < len(self.at) and self.at[k] == place - 1:
            return self.gaps[k][1]
        return self.start(place - 1) + 1


def _grams(text: str) -> Counter:
    return Counter(text[i : i + _GRAM] for i in range(len(text) - _GRAM + 1))


class Notices:
    """Automaton of all seeds, and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, str]):
        self.notices = list(notices.items())
        self.errors = [allowed_errors(n) for n, _ in self.notices]
        # BESTMATCH: of the matches in a window the one with the fewest errors.
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, special_only=True)}){{e<={e}}}")
                         for (n, _), e in zip(self.notices, self.errors)]
        self.grams = [_grams(n) for n, _ in self.notices]
        # An error breaks at most _GRAM of a notice's grams.
        self.shared = [len(n) - _GRAM + 1 - _GRAM * e for (n, _), e in zip(self.notices, self.errors)]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(self.notices):
            for offset, part in seeds(notice, self.errors[k]):
                found.setdefault(part, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for part, uses in found.items():
            self.automaton.add_word(part, (len(part), uses))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def _can_hold(self, k: int, window: str) -> bool:
        return self.shared[k] <= 0 or (self.grams[k] & _grams(window)).total() >= self.shared[k]

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, errors) of the notices in a lower-cased text, by place; non-overlapping for each notice."""
        view = View(text)
        text = view.text
        starts: dict[int, set[int]] = {}
        if self.any and text:
            for last, (size, uses) in self.automaton.iter(text):
                for k, offset in uses:
                    starts.setdefault(k, set()).add(last + 1 - size - offset)
        out = []
        for k, places in starts.items():
            (notice, label), errors, done = self.notices[k], self.errors[k], 0
            for place in sorted(places):
                low, high = max(done, place - errors), min(len(text), place + len(notice) + errors)
                if high - low < len(notice) - errors or not self._can_hold(k, text[low:high]):
                    continue
                match = self.patterns[k].search(text, low, high)
                if match:
                    out.append((view.start(match.start()), view.end(match.end()), label, sum(match.fuzzy_counts)))
                    done = match.end()
        return sorted(out)


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        at, n = -1, len(phrase)
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + n] == phrase:
                    out.append((at, label))
        except ValueError:
            continue
    return sorted(out)


def _scanner(notices: dict[str, str], phrases: dict[str, str], at: int, name: str):
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int32())]))),
        ("score", pa.float64())])

    def run(batches):
        matcher = Notices(notices)
        exact = [(p.encode().split(), label) for p, label in phrases.items()]
        length = {label: max(len(n) for n, x in notices.items() if x == label) for label in notices.values()}
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                words = word_list(text, ALNUM)
                places = phrase_places(words, exact)
                spans = matcher.spans((text or "").translate(_LOWER))
                score = 1.0 if places else max((1 - e / length[label] for _, _, label, e in spans), default=0.0)
                rows.append({"n_words": len(words), "places": [{"word": w, "label": x} for w, x in places],
                             "spans": [{"start": a, "end": b, "label": x, "errors": e} for a, b, x, e in spans], "score": score})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)],
                                             names=[*batch.schema.names, name])
    return run


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES) -> tuple[DataFrame, str]:
    """``docs`` with all columns and a struct of words, phrase places and notice spans; and that struct's name.

    Spans count code points of the whole text, end exclusive, with the notice's label and its number of errors; line breaks, repeated
    blanks and comment marks at the beginnings of lines are no errors.  ``score`` is 1 with a
    phrase, else the best share of a notice that is free of errors, else 0.  A null or empty text has nothing.  Where
    windows of one notice overlap, the earlier match stays; different notices may overlap, those with equal spans are
    sorted by label.  Repeated rows give repeated results, an empty table none; a column ``found`` of ``docs`` stays, the struct gets another name.  Work follows the length of the text and the seeds found; the notices are a
    parameter of the call, not data.
    """
    name = free_name(docs, "found")
    schema = docs.withColumn(name, F.lit(None).cast(FOUND)).schema
    return docs.mapInArrow(_scanner(notices, phrases, docs.columns.index("text"), name), schema), name


def op4(spark, sf_dir: str) -> DataFrame:
    found, name = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = found.select("doc_id", F.col(name).alias("f"))
    places, spans = F.col("f.places"), F.col("f.spans")
    base = F.array_sort(F.array_distinct("f.places.label"))
    return found.select(
        "doc_id", "f.n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min("f.places.word").alias("first_word"), F.array_max("f.places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans["label"])), ",").alias("labels"),
        "f.score",
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["errors"])), ",").alias("spans"))
