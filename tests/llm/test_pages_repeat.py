"""All pages of a host go through its suffix array, those with a main element too; the markup checks the outcome."""

from collections import defaultdict

import numpy as np
import pytest

from sourceassay.llm import html_text, queries
from tests.conftest import SMALL

CUTS = [{}, {"part_bytes": 300}, {"part_bytes": 300, "listed_runs": 0}]


def decided(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [(r.doc.page_id, *r.main) for r in html_text.decide(pages, **how).collect()]


@pytest.mark.parametrize("how", CUTS)
def test_pages_with_a_main_element_are_compared(spark, how):
    rows = [(k, f"http://h.x/{k}", f"<nav>one menu of the site</nav><article><p>text{k} of page{k} alone{k} in{k} here{k}</p>"
             + "<p>a passage that two pages share</p>" * (k < 2) + f"</article><footer>end{k} of{k}</footer>") for k in range(6)]
    got = {r[0]: r[1:] for r in decided(spark, rows, **how)}
    for k in range(6):
        own, shared = f"text{k} of page{k} alone{k} in{k} here{k}", "a passage that two pages share"
        assert got[k] == (f"{own}\n{shared}", 4, 2, 1) if k < 2 else got[k] == (own, 3, 1, 0)


@pytest.mark.parametrize("how", CUTS)
def test_pages_with_a_main_element_decide_others(spark, how):
    bar = "<div>all the topics of this site at a glance</div>"
    rows = [(k, f"http://h.x/{k}", f"{bar}<article>text{k} of{k} its{k} own{k}</article>") for k in range(3)]
    rows.append((3, "http://h.x/3", f"{bar}<p>the only page without a main element</p>"))
    got = {r[0]: r[1:] for r in decided(spark, rows, **how)}
    assert got[3] == ("the only page without a main element", 2, 1, 0) and got[0] == ("text0 of0 its0 own0", 2, 1, 0)


def by_force(rows, run=html_text.RUN, least=html_text.PAGES, low=html_text.CHECKED_SHARE, high=html_text.SHARE):
    read = [(key, url.split("/")[2], *html_text.placed(page)) for key, url, page in rows]

    def stream(found):
        return [t for text, _ in found for t in ("|", *text.split(" "))] + ["|"]

    first = {}
    for _, host, _, found in read:
        kept = tuple(t for t, stays in found if stays)
        if kept:
            page = min(first.get((host, kept), (html_text._digest([t for t, _ in found]), found)), (html_text._digest([t for t, _ in found]), found))
            first[host, kept] = page
    pages, on = defaultdict(int), defaultdict(set)
    for (host, kept), (_, found) in first.items():
        pages[host] += 1
        tokens = stream(found)
        for k in range(len(tokens) - run + 1):
            on[host, tuple(tokens[k:k + run])].add(kept)
    for key, host, whole, found in read:
        tokens = stream(found)
        covers = []
        for share in (low, high):
            covered = {k + i for k in range(len(tokens) - run + 1) for i in range(run)
                       if len(on[host, tuple(tokens[k:k + run])]) >= max(least, share * pages[host])}
            at, flags = 0, []
            for text, _ in found:
                end = at + len(text.split(" ")) + 1
                flags.append(all(k in covered for k in range(at, end + 1)))
                at = end
            covers.append(flags)
        stay = [kept and (whole or not often) for (_, kept), often in zip(found, covers[1])]
        yield key, "\n".join(t for (t, _), s in zip(found, stay) if s), len(found), sum(covers[0]), sum(s and c for s, c in zip(stay, covers[0]))


@pytest.mark.parametrize("how", CUTS)
def test_decisions_match_brute_force(spark, how):
    draw = np.random.default_rng(7)
    pool = ["a b c", "d e", "f", "a b c d e f", "b c d e", "g h i j k l", "x"]

    def text():
        return str(draw.choice(pool)) + (f" w{draw.integers(60)}" if draw.random() < 0.5 else "")

    rows = []
    for k in range(330):
        # 260 pages of one host: a hundredth is more than two pages.
        host = "big.x" if k < 260 else f"small{k % 7}.x"
        body = "".join(f"<p>{text()}</p>" for _ in range(draw.integers(0, 5)))
        main = f"<article>{body}</article>" if draw.random() < 0.6 else body
        rows.append((k, f"http://{host}/{k}", f"<nav>{text()}</nav>{main}<div class='ad'>{text()}</div><div>{text()}</div>"))
    rows += [(1000 + k, url, page) for k, url, page in rows[::9]] + [(None, "http://big.x/", rows[0][2])]  # copies count once
    got = decided(spark, rows, **how)
    assert sorted(got, key=str) == sorted(by_force(rows), key=str)
    assert sum(r[3] for r in got) > sum(r[4] for r in got) > 0


def test_query_reports_what_repeats(spark):
    rows = queries.QUERIES["op9_html_text"](spark, SMALL).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages) and sum(r.n_repeated for r in rows) > sum(r.n_restored for r in rows) > 0
    for r in rows:
        whole, found = html_text.placed(pages[r.page_id].html)
        assert r.n_blocks == len(found) and whole and r.text == "\n".join(text for text, kept in found if kept) and r.n_chars == len(r.text)
