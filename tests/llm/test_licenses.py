"""Fuzzy notices against edit distances, wrapped and decorated notices, odd cases."""

import random
import re
import string

from sourceassay.llm import licenses

MATCHER = licenses.Notices(licenses.NOTICES)


def distance(a: str, b: str, anywhere: bool = False) -> int:
    """Edits from ``a`` to ``b``, or to the nearest part of ``b``."""
    row = [0 if anywhere else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row) if anywhere else row[-1]


def plain(text: str) -> str:
    return re.sub(r"\s*\n[\s/*#;%|>!-]*|\s+", " ", text)


def edited(notice: str, errors: int, draw: random.Random) -> str:
    text = list(notice)
    for _ in range(errors):
        k = draw.randrange(len(text))
        text[k : k + draw.choice((0, 1, 1))] = draw.choice(([], [draw.choice(string.ascii_lowercase)]))
    return "".join(text)


def wrapped(text: str, draw: random.Random) -> str:
    mark = draw.choice(("\n", "\n * ", "\n// ", "\n# ", "\r\n;;  ", "   ", "\n\n\t> "))
    return "".join(mark if c == " " and draw.random() < 0.3 else c for c in text)


def test_wrapped_and_decorated():
    text = "x = 1\n/*\n * licensed under the\n * apache license,\n * version 2.0\n */ int y;"
    (start, end, label, errors), = MATCHER.spans(text)
    assert (label, errors) == ("notice-apache-2.0", 0)
    assert text[start:end] == "licensed under the\n * apache license,\n * version 2.0"


def test_edited_and_wrapped_notices_are_found():
    draw, found, wanted = random.Random(7), 0, 0
    for _ in range(40):
        for notice, label in licenses.NOTICES.items():
            allowed = licenses.allowed_errors(notice)
            body = wrapped(edited(notice, draw.randint(0, allowed), draw), draw)
            text = "some words in front. " + body + " and some behind"
            spans = MATCHER.spans(text)
            for start, end, name, errors in spans:
                assert any(distance(n, plain(text[start:end])) <= errors <= licenses.allowed_errors(n)
                           for n, x in licenses.NOTICES.items() if x == name)
            wanted += distance(notice, plain(text), anywhere=True) <= allowed
            found += label in {s[2] for s in spans}
    assert wanted > 300 and found >= wanted


def test_labels_equal_brute_force():
    draw = random.Random(11)
    pieces = [n[a : a + 30] for n in licenses.NOTICES for a in (0, 12, 25) if n[a:]] + list(licenses.NOTICES)
    for _ in range(60):
        text = " ".join(edited(draw.choice(pieces), draw.randint(0, 3), draw) for _ in range(4))
        want = {label for n, label in licenses.NOTICES.items() if distance(n, plain(text), anywhere=True) <= licenses.allowed_errors(n)}
        assert {s[2] for s in MATCHER.spans(text)} == want


def test_view_leads_back():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("ab \n\t*/#") for _ in range(draw.randrange(40)))
        view = licenses.View(text)
        assert view.text == plain(text)
        for k, c in enumerate(view.text):
            a, b = view.start(k), view.end(k + 1)
            assert a < b and (text[a:b] == c or (c == " " and plain(text[a:b]) == " "))


def test_repeated_beginnings_cost_little():
    text = "permission is hereby granted, free of charge, " * 2000
    assert MATCHER.spans(text) == []


def test_clashing_column_and_ties(spark):
    text = "All rights reserved. RELEASED under the MIT license"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, found string")
    out, name = licenses.scan(docs)
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert name != "found" and [r["found"] for r in rows] == ["x", "x", "y", "z"]
    assert rows[0] == rows[1] and {s["label"] for s in rows[0][name]["spans"]} == {"notice-all-rights-reserved", "notice-mit"}
    assert rows[2][name]["n_words"] == 0 and not rows[3][name]["spans"] and rows[3][name]["score"] == 0
