"""Operator 11 against an audit that applies the filters in every order."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from sourceassay.llm import filter_audit


def failed(rows, i, text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)]


def brute(rows, labels):
    good, toxic = ({d for d, *label in labels if label[k] == 1 and d is not None} for k in (0, 1))
    for part in {p or "" for _, _, p in rows}:
        docs = [(i, failed(rows, i, t)) for i, t, p in rows if (p or "") == part]
        found, total = [], [0] * 5
        for order in permutations(range(5)):
            left = docs
            for step, x in enumerate(order):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                total[x] += len(gone)
                found.append((part, "".join("ABCDE"[y] for y in order), step + 1, len(left), len(gone),
                              sum(f[x] for _, f in docs) - len(gone), sum(f[x] and sum(f) == 1 for _, f in docs),
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
        yield from (r[:-1] + (total[r[-1]],) for r in found)


def test_popcounts():
    draw = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 9, 1000, 4097):
        words = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_popcount(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def test_audit_matches_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    def text():
        words = draw.choices(vocabulary[:draw.choice([20, 300])], k=draw.choice([0, 5, 199, 200, 260]))
        return draw.choice([" ", "\n", " \x0b"]).join(words) + draw.choice(["", "", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHI" * 2])
    rows = [(k, text(), draw.choice(["en", "de", None, ""])) for k in range(120)]
    rows += [(200 + k, rows[3][1], "en") for k in range(60)]  # one hot text
    rows += [(None, rows[3][1], "en"), (None, None, None), (-5, None, "fr"), (-4, "", "fr"), (-4, "", "fr"), (7, rows[7][1], rows[7][2]), (500, " " * 10, "x" * 50)]
    rows += [(501, "Wort " * 300_000, "de"), (502, "x" * 2_500_000 + " y", "de")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, "s", "q") for i, t, p in rows], "doc_id long, text string, lang string, failed string, part string")
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, labels))
    assert found.columns == [f.split()[0] for f in filter_audit._AUDIT.split(", ")]


def test_words_of_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 3)
    for text in ("", "a", "abcdefg hi\nj  k", "  ", "ab cd ef"):
        assert [w for p in filter_audit._words(text.encode()) for w in p] == text.encode().split()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), labels)
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0
