"""Exact and near dedup against brute force, and their odd cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sourceassay.llm import exact_dedup, near_dedup
from sourceassay.llm.words import NON_SPACE, shingle_set, word_hashes, word_list

ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (5, "ab"), (None, "ab "), (6, "x" * 200_000), (7, "x " * 200_000), (8, "ä b")]


def test_misra_gries_keeps_frequent():
    counts = Counter({"a": 100, **{f"r{k}": 1 for k in range(50)}})
    kept = exact_dedup.merge_counts(counts, 5)
    assert len(kept) <= 5 and kept["a"] == 99


def test_exact_groups(docs, by_id):
    rows = ODD + [(100 + k, f"copy{' ' * (k % 3)}of") for k in range(300)]
    found = exact_dedup.exact_groups(docs(rows), counters=8).collect()  # small summaries: the copies are a frequent digest
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, t))
    keep = {n: min(g, key=lambda x: x[:2] + (x[2] or 0,))[2] for n, g in groups.items()}
    want = sorted((str(i), keep[n], len(g)) for n, g in groups.items() for _, _, i, _ in g)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)  # one of each group, also of repeated rows


def test_exact_stage(docs):
    kept = exact_dedup.drop_exact_duplicates(docs(ODD))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(3, 2), (4, 3), (7, 400_000), (8, 3)]
    assert exact_dedup.exact_groups(docs([])).count() == 0


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    width = min(width, len(w))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if w else set()


def brute_components(rows, width=2):
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), i), i)
    return {i: (len(sets[k]), best[find(k)]) for k, (i, _) in enumerate(rows)}


def variants(draw, n, words, changes):
    base = [f"w{draw.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[draw.randrange(words)] = f"v{draw.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_near_groups_match_brute_force(docs):
    draw = random.Random(3)
    texts = [t for words, changes in ((6, 1), (30, 2), (80, 4), (80, 8), (200, 12)) for t in variants(draw, 24, words, changes)]
    texts += ["", None, "one", "one", "ONE", "a a a a", "A a", "x " * 30_000]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows)
    for r in near_dedup.near_groups(docs(rows)).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_links_that_stars_miss(docs):
    """A chain: the bucket's smallest node is far from two others that are close to each other."""
    words = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(words[3 * k:3 * k + 40])) for k in range(7)]
    rows += [(10 + k, " ".join(words[3 * k:3 * k + 40] + ["tail"])) for k in range(7)]
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(rows)).collect()} == {i: c for i, (_, c) in want.items()}


def test_near_odd_rows(docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, ""), (2, None), (3, "other words here")]
    found = near_dedup.near_groups(docs(rows)).collect()
    assert len(found) == 6 and sum(r.kept for r in found) == 4
    kept = near_dedup.drop_near_duplicates(docs(rows), width=5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert near_dedup.near_groups(docs([])).count() == 0


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    for n in (5, 60, 2000):
        agree = []
        for _ in range(60):
            both = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            a, b = both[: int(n * 0.9)], both[int(n * 0.1):]
            agree.append(np.mean(near_dedup.signature(a) == near_dedup.signature(b)))
        assert abs(np.mean(agree) - 0.8) < 0.08


@pytest.mark.parametrize("text", ["", None, "a", "B b\x0bb", "é x  y", "w" * 5000 + " z"])
def test_word_hashes(text):
    words = word_list(text, NON_SPACE)
    h = word_hashes(text, NON_SPACE)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert len(shingle_set(h, 2)) == len({tuple(words[k:k + 2]) for k in range(max(1, len(words) - 1))} if words else ())


def test_near_stage_drops_nothing_beside_its_groups(spark):
    """A repeated text elsewhere in the table doesn't touch rows that share an id and a text without shingles."""
    words = " ".join(f"w{k}" for k in range(20))
    rows = [(2, None, "en", "m"), (2, None, "de", "m"), (3, "", "en", "m"), (3, "", "en", "m"), (4, words, "en", "m"), (4, words, "de", "m"),
            (5, words + " more", "en", "m"), (6, "other text of a few words here", "en", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark string")
    kept = near_dedup.drop_near_duplicates(docs, width=5)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "", r.lang if r.doc_id == 2 else "") for r in kept.collect())
    assert got == [(2, "", "de"), (2, "", "en"), (3, "", ""), (3, "", ""), (4, words, ""), (6, rows[-1][1], "")]
