"""Decontamination, licenses, BPE, personal data, pages and shards against brute force, and their odd cases."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken

from sourceassay.llm import bpe, decontamination, html_text, licenses, personal_data, queries, sharding
from sourceassay.llm.fm_index import FMIndex
from tests.conftest import SMALL
from tools.check_oracle import TABLES, canonical

ODD = [(1, None), (2, ""), (3, "\n \t"), (4, "Ä é " * 40_000), (4, "Ä é " * 40_000), (None, "word")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = canonical(queries.QUERIES[name](spark, SMALL).toPandas())
    assert len(got) and got.equals(canonical(db.execute(queries.ORACLE_SQL[name]).df()))


def test_fm_index_finds_all():
    draw = np.random.default_rng(2)
    text = draw.integers(0, 4, 3000)
    text[-1] = 0
    index = FMIndex(text, 3)
    for n in (1, 3, 6):
        patterns = draw.integers(1, 4, (40, n))
        which, at = index.locate(*index.ranges(patterns))
        got = sorted(zip(which.tolist(), at.tolist()))
        want = [(k, i) for k, p in enumerate(patterns) for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
        assert got == sorted(want)


def test_leaks(spark, docs, by_id):
    long_item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, long_item), (2, "Short item"), (3, None), (4, "--"), (None, "null id")], "item_id long, text string")
    rows = [(10, "x " + long_item.upper() + " y"), (11, "two three four five six seven eight nine ten eleven"), (12, "one two three"),
            (13, "short, ITEM! short item short"), (14, "a null id b"), *ODD]
    for block in (decontamination.BLOCK_BYTES, 8):  # one block of phrases, or several
        found, leak = decontamination.find_leaks(docs(rows), bench, block_bytes=block)
        got = {r.doc_id: (r[leak].n_words, list(r[leak]["items"]), [tuple(s) for s in r[leak].spans]) for r in found.collect()}
        assert got[10] == (14, ["1"], [(1, 13)]) and got[11] == (10, ["1"], [(0, 10)]) and got[12] == (3, [], [])
        assert got[13] == (5, ["2"], [(0, 4)]) and got[14] == (4, [""], [(1, 3)]) and got[1] == got[2] == (0, [], []) and got[4][0] == 80_000
    kept = decontamination.drop_leaks(docs(rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "12", "2", "3", "4", "4", "None"] and len(kept.columns) == 5
    assert decontamination.cut_spans("x Short item, y", [(1, 3)]) == "x , y"
    none = bench.where("false")
    assert decontamination.drop_leaks(docs(rows), none).count() == len(rows) and decontamination.drop_leaks(docs([]), bench).count() == 0
    clash = docs(rows).withColumnRenamed("lang", "leak")
    found, leak = decontamination.find_leaks(clash, bench)
    assert leak == "leak_" and {r.leak for r in found.collect()} == {"en"}


def test_licenses(docs, by_id):
    rows = [(10, "Licensed under the Apache License, Version 2.0."), (11, "Licenced undr the Apache Licence Version 2.0"),
            (12, "the MIT License and CC-BY, cc  by"), (13, "all rights are here"), *ODD]
    found, name = licenses.scan(docs(rows))
    got = by_id(found)
    f = {i: r[name] for i, r in got.items()}
    assert [tuple(p) for p in f[10].places] == [(3, "apache")] and [s.label for s in f[10].spans] == ["notice-apache-2.0"] and f[10].score == 1
    assert not f[11].places and [(s.label, s.errors) for s in f[11].spans] == [("notice-apache-2.0", 4)] and 0.8 < f[11].score < 1
    assert [tuple(p) for p in f[12].places] == [(1, "mit"), (4, "cc-by"), (6, "cc-by")]
    assert not f[13].spans and f[1].n_words == 0 and f[1].score == 0 and f[4].n_words == 80_000
    assert licenses.scan(docs([]))[0].count() == 0


def test_pigeonhole_seeds():
    for notice in licenses.NOTICES:
        parts = licenses.seeds(notice, licenses.allowed_errors(notice))
        assert "".join(p for _, p in parts) == notice and len(parts) == licenses.allowed_errors(notice) + 1


def test_bpe_stitches_chunks(docs, by_id):
    encoder = bpe.encoding(bpe.VOCABULARY, bpe.public_tokenizers.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    texts = ["it's   a\n\n test 1234567 ...!!! é中文字 " * 30, "a" * 700, " " * 300 + "x" + "\n" * 90 + "y" * 50, "don't we'll   " * 60, "ab " * 3 + "€" * 150 + " z"]
    rows = list(enumerate(texts, 10)) + ODD
    coded, ids = bpe.encode(docs(rows).withColumnRenamed("lang", "ids"), chunk=64, overlap=16)
    assert ids == "ids_" and coded.columns == ["doc_id", "ids", "source", "n_chars", "ids_"]
    whole = {i: t for i, t in rows}
    for r in coded.collect():
        assert list(r.ids_) == encoder.encode_ordinary(whole[r.doc_id] or "")
    for r in bpe.decode(coded, ids).collect():
        assert bytes(r.ids_) == (whole[r.doc_id] or "").encode()
    assert bpe.encode(docs([]))[0].count() == 0


def base(t):
    out = []
    for no, (kind, pattern) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            if kind == "card":
                s = sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(map(int, reversed(d))))
                if not 14 <= len(d) <= 19 or s % 10:
                    continue
            out.append((m.start(), no, m.end()))
    return sorted(out)


def test_personal_data(docs, by_id):
    texts = ["mail a.b@c.de%x@y.zz, x@y", "a@b.c.d@e.f ü@g.h 1.2.3.4.5 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
             "+1 (555) 010-9999. +12 3 +49-30-1234567890123456", "é" * 70 + " j@k.lm " + "ö" * 70, "7" * 60_000, "1 " * 30_000, "10.0.0.1 " * 3000]
    rows = list(enumerate(texts, 10)) + ODD
    found, name = personal_data.find(docs(rows))
    got = by_id(found)
    for i, t in rows:
        assert [tuple(x)[:3] for x in got[i][name]["base"]] == [(s, k, e) for s, k, e in base(t or "")], i
        assert not got[i][name]["more"]
    assert personal_data.find(docs([]))[0].count() == 0


def test_disclosing_terms(docs, by_id):
    rows = [(k, f"filler{k} the person Zanzibar here is reached at boss@firm.com and plain words{k} follow") for k in range(6)]
    rows += [(50 + k, f"clean{k} the person here is plain and words follow") for k in range(60)]
    found, name = personal_data.find(docs(rows))
    got = by_id(found)
    for k in range(6):
        more = {rows[k][1][s.start:s.end].lower(): s.kind_no for s in got[k][name]["more"]}
        assert more["zanzibar"] == len(personal_data.KINDS) and "the" not in more and "plain" not in more
    assert not any(got[50 + k][name]["more"] or got[50 + k][name]["base"] for k in range(60))
    clean = by_id(personal_data.sanitise(docs(rows + [(99, None)])))
    assert "[EMAIL]" in clean[0].text and "Zanzibar" not in clean[0].text and clean[50].text == rows[6][1] and clean[99].text is None


def test_terms_of_rare_entities(docs, by_id):
    """Mail addresses that occur once or twice: what is beside them all, and beside a repeated one, goes; also far from the entity."""
    rows = [(k, f"dear reader{k} the letter of Zanzibar {'and so on ' * 20} goes to person{k}@firm.com") for k in range(8)]
    rows += [(20, "the Quixote lives in the house of twice@else.org today"), (21, "a house where Quixote paints and twice@else.org writes")]
    rows += [(30, "the lonely Hapax asks once@third.net"), (30, "the lonely Hapax asks once@third.net")]  # copies prove nothing
    rows += [(100 + k, f"the letter and the house of a reader who paints, writes and asks today, dear {k} person lives so on" + " goes to" * (k % 5)) for k in range(300)]
    found, name = personal_data.find(docs(rows))
    more = {}
    for r in found.collect():
        text = dict(rows)[r.doc_id]
        more.setdefault(r.doc_id, set()).update((text[s.start:s.end], s.kind_no) for s in r[name]["more"])
    gone = len(personal_data.KINDS)
    assert all(("Zanzibar", gone) in more[k] for k in range(8)) and ("Quixote", gone) in more[20] & more[21]
    assert not more[30] and not any(more[100 + k] for k in range(300))
    assert not {"the", "letter", "house", "dear"} & {w for v in more.values() for w, _ in v}


PAGE = ("<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>eat</div><header>top</header><article><h1>A &amp; B</h1>"
        "<p>one<b>two</b>\n three<br>four<script>x('</p>')</script><aside>no</aside><form>f</form><p>five<section id=comments><p>troll</p></section>"
        "</article><footer>end</footer>")


def test_pages(spark, by_id):
    same = "<div>Share this story with all your many friends today</div>"
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, ""), (4, "http://h.x/4", f"<div>first own text of page</div>{same}"),
            (5, "http://H.x:80/5", f"{same}<p>second own words</p>"), (6, "http://other.x/", f"{same}<p>x"), (7, "http://h.x/7", "<main>" + "<p>w</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (html_text.PART_BYTES, 40):  # a host in one part, or in several
        found, text = html_text.extract(pages.selectExpr("page_id", "url", "url AS text", "html"), part_bytes=part)
        got = {r.page_id: r[text] for r in found.collect()}
        assert text == "text_" and got[1] == "A & B\nonetwo three four\nfive" and got[2] == got[3] == ""
        assert got[4] == "first own text of page" and got[5] == "second own words" and got[6].startswith("Share") and len(got[7]) == 39_999
    assert html_text.extract(pages.where("false"))[0].count() == 0


def test_pages_keep_their_prose(spark):
    """Without a main element: phrases inside prose, blocks of a few pages, copies of a page and pages without a host stay."""
    bar = "<div>all the topics of this site at a glance</div>"
    rows = [(k, f"http://big.x/{k}", f"{bar}<p>text{k} begins and on the other hand of it ends{k}</p>" + "<div>read it again</div>" * (k < 2)) for k in range(20)]
    rows += [(100 + k, "http://copy.x/", "<p>one and the same page is here again and again</p>") for k in range(5)]
    rows += [(200 + k, url, "<p>no host but a text of several words</p>") for k, url in enumerate((None, "odd", "odd"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (html_text.PART_BYTES, 40):
        found, text = html_text.extract(pages, part_bytes=part)
        got = {r.page_id: r[text] for r in found.collect()}
        assert len(got) == len(rows)
        for k in range(20):
            assert got[k] == f"text{k} begins and on the other hand of it ends{k}" + "\nread it again" * (k < 2)
        assert all(got[100 + k].startswith("one and") for k in range(5)) and all(got[200 + k].startswith("no host") for k in range(3))


@pytest.mark.parametrize("page, want", [
    ("<body class='single has-sidebar'><article>a b</article>x", ["a b"]),
    ("<body class='sidebar'><p>a b</p>", ["a b"]),
    ("<div id='content-sidebar-wrap'><article>a b</article><div class='sidebar'>x</div></div>", ["a b"]),
    ("<div class='sidebar'>x<article>a b</article>y</div><p>z", ["a b"]),
    ("<form id='aspnet'><nav>x</nav><main>a b</main></form>", ["a b"]),
    ("<article class='post comments-open'>a b</article>", ["a b"]),
    ("<main class='search-page'>a b</main>", ["a b"]),
    ("<main class='search'>a b</main>", ["a b"]),
    ("<article><div class='entry-header'><h1>a</h1></div><header class='header'>b</header>c</article>", ["a", "b", "c"]),
    ("<article><div class='related-work'>a</div><section id='form'>b</section><section id='related'>c</section></article>", ["a", "b", "c"]),
    ("<article>a<div class='ad'>x</div><div class='post cookie-notice'>y</div><div id='comments'>z</div><form>f</form></article>", ["a"]),
    ("<aside><article>x</article></aside><main>a b</main>", ["a b"]),
    ("<div class='widget'><article>x</article></div><article>a b</article>", ["a b"]),
])
def test_marks(page, want):
    assert html_text.blocks(page) == (("<article" in page or "<main" in page), want)


def test_repeated_runs_match_brute_force():
    draw = np.random.default_rng(5)
    streams = [draw.integers(1, 4, n).astype(np.uint64) for n in (40, 3, 60, 25)]
    want = {}
    for p, s in enumerate(streams):
        for k in range(len(s) - 4):
            want.setdefault(tuple(s[k:k + 5]), []).append((p, k))
    got = [sorted(zip(p.tolist(), s.tolist())) for _, p, s in html_text.repeated_runs(streams, 5)]
    assert sorted(got) == sorted(sorted(v) for v in want.values())


@pytest.mark.parametrize("range_bytes", [sharding.RANGE_BYTES, 500])
def test_shards(docs, range_bytes):
    rows = [(k, "copy" * 10) for k in range(400)] + [(1000 + k, "ü" * (k % 90)) for k in range(900)] + [(None, None), (None, "x"), (7777, ""), (7777, "")]
    found = sharding.shard(docs(rows).withColumnRenamed("lang", "Placed"), shards=10, range_bytes=range_bytes).collect()
    assert len(found) == len(rows) and sum(1 for r in found if r.Placed == "en") == len(rows)
    shards = {}
    for r in found:
        p = r.placed_
        assert p.size == len((r.text or "").encode()) + 16 and p.text_crc32 == zlib.crc32((r.text or "").encode())
        shards.setdefault(p.shard, []).append(p)
    assert sorted(shards) == list(range(10))
    total = [sum(p.size for p in s) for s in shards.values()]
    assert max(total) - min(total) <= 2 * 200 and all(sorted(p.slot for p in s) == list(range(len(s))) for s in shards.values())
    assert sharding.shard(docs([])).count() == 0


def test_operators_without_python(spark):
    for name in ("op8_personal_data", "op10_sharding"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_contract_digests(spark, by_id):
    """The thin queries over whole tables against plain Python."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    encoder = bpe.encoding(bpe.VOCABULARY, bpe.public_tokenizers.PATTERN)
    for r in queries.QUERIES["op5_byte_bpe"](spark, SMALL).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries.QUERIES["op8_personal_data"](spark, SMALL).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


@pytest.mark.parametrize("page, want", [
    ("<article><p title=it's>Hello it's me</p><p>two</p></article>", ["Hello it's me", "two"]),
    ("<article><p>if a<b then it's so</p><p>it's \"z\" > q</p></article>", ["if a", "it's \"z\" > q"]),
    ("<article><p title = 'a > b' lang=\"x'>\">one</p><img alt='>'/>two</article>", ["one", "two"]),
    ("<article><p title=\"never closed>one</p><p>two</p></article>", ["one", "two"]),
    ("<article><p>one</p><p>two</p><a href=", ["one", "two"]),
])
def test_quotes_in_tags(page, want):
    assert html_text.blocks(page) == (True, want)


@pytest.mark.parametrize("unit", ["<a ", "<a x=' ", "a<b 'c ", "<!", "</script ", "<a x=\"y", "<p =", "<!--"])
def test_broken_markup_is_read_in_linear_time(unit):
    import time
    page = "<article>" + unit * 300_000
    started = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - started < 20
