"""Operator 12 against token-by-token alignment of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sourceassay.llm import alignment

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(alignment.A_PATH, alignment.B_PATH)


def groups_of(both, text):
    if not text:
        return []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    if not b"".join(both.a_bytes[i] for i in a) == (" " + text).encode() == b"".join(both.b_bytes[i] for i in b):
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        ga, gb = [a[i]], [b[j]]
        x, y, i, j = len(both.a_bytes[a[i]]), len(both.b_bytes[b[j]]), i + 1, j + 1
        while x != y:
            if x < y:
                ga.append(a[i])
                x, i = x + len(both.a_bytes[a[i]]), i + 1
            else:
                gb.append(b[j])
                y, j = y + len(both.b_bytes[b[j]]), j + 1
        out.append((ga, gb))
    return out


def brute(both, rows):
    docs, best, each = Counter(), {}, []
    for i, text in rows:
        groups = groups_of(both, text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        each.append((i, groups, links))
        docs.update(links.keys())
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    for i, groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
               sum(n for p, n in links.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links.items()),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


def texts():
    draw = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "漢字", "😀", "<|endoftext|>", "<0x41>", "1234", "_", "==", "'s",
             " ", "　", "\x00", "\x1c", "ñmente"]
    rows = ["".join(draw.choice(parts) + draw.choice(["", "", " "]) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    rows += [None, "", " ", "a▁b", "x" * 3000, " ".join(draw.choice(["foo", "barbaz", "qüx"]) for _ in range(2000)), "  " * 500,
             "漢字" * 700, "==- " * 400 + "a▁b " * 100, "ab cd", "ab cd", "ab cd "]
    return [(k % (len(rows) - 5), t) for k, t in enumerate(rows)]  # the last five ids repeat


@pytest.mark.parametrize("chunk, fan, heads", [(1 << 16, 16, 1 << 20), (64, 2, 50), (700, 3, 0)])
def test_op12_matches_brute_force(spark, both, chunk, fan, heads):
    """Long ranges and short ones, with several levels of the tree; all pairs broadcast, some and none."""
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string")
    aligned, name = alignment.align(docs, chunk=chunk, fan=fan, keep_groups=True)
    assert aligned.columns == ["doc_id", "n_a", name]
    found = alignment.link_scores(aligned, name, heads=heads).collect()
    assert sorted((r.doc_id, *(r[name][c] for c in COLUMNS)) for r in found) == sorted(brute(both, rows))
    for r in found:
        assert r[name]["groups_sha256"] == (hashlib.sha256(r[name]["groups"].encode()).hexdigest() if r[name]["groups"] else "")


def test_forgotten_units(both, monkeypatch):
    """Units that are forgotten and met again have the same ids, and what is kept stays in place."""
    monkeypatch.setattr(alignment, "UNITS", 6)
    units, draw = alignment.Units(both), random.Random(2)
    for _ in range(30):
        text = " ".join(draw.choices(["the", "straße", "foo", "x\n", "漢字", "barbaz", "qux", "a", "b", "c"], k=12))
        places, _ = units.of_texts([text])
        assert units.a.take(places)[0].tolist() == both.a.encode(" " + text, add_special_tokens=False).ids
        assert units.b.take(places)[0].tolist() == both.b.encode(text)
        units.trim()
        assert len(units.text) <= 6 or len(units.text) == len(units.place) == len(units.used)


def test_composition_is_associative(both):
    """Any bracketing of the ranges' fragments gives the same groups."""
    text = " ".join(["straßenbahn", "tokenizers", "漢字漢字", "supercalifragilistic"] * 8)
    a, b = np.array(both.a.encode(" " + text, add_special_tokens=False).ids), np.array(both.b.encode(text))
    parts = []
    for j, cut, head, closed, tail in alignment.fragments(a, np.cumsum(both.a_sizes[a]), b, np.cumsum(both.b_sizes[b]), 7):
        parts.append({"first_j": j, "last_j": j, "last_k": 0, "cut": cut, "head_a": head[0].tolist(), "head_b": head[1].tolist(),
                      "tail_a": tail[0].tolist(), "tail_b": tail[1].tolist()})
    def fold(items):
        whole, groups = None, []
        for x in items:
            whole, group = alignment.compose(whole, x)
            groups += [group] if group else []
        return whole, groups
    straight, groups = fold(parts)
    for width in (2, 3, 5):
        level = [fold(parts[k:k + width]) for k in range(0, len(parts), width)]
        whole, more = fold([x for x, _ in level])
        assert whole == straight
        key = lambda g: (g["j"], g["k"])
        assert sorted([g for _, x in level for g in x] + more, key=key) == sorted(groups, key=key)


def test_empty_table(spark):
    aligned, name = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert alignment.link_scores(aligned, name).count() == 0
