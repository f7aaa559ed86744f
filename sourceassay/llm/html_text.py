"""Operator 9, HTML extraction: a host suffix array finds what pages repeat, marked structure checks it.

A page is cut into blocks, those of menus, adverts and footers too.  The token streams of all pages of a host are concatenated, a
suffix array finds the runs of tokens that distinct pages share, and blocks that such runs cover whole are boilerplate; nothing is
cut out of a block.  The markup checks this afterwards.  What stands inside ``article`` or ``main`` is the main text and stays whole, also
where pages share passages.  What doesn't, or stands in elements that mark themselves as menus, headers, footers, sidebars, notices,
adverts, forms or reader comments, goes, also where no other page repeats it.  Unmarked blocks of pages without a main element can't be checked: there
repetition decides, on a larger share of the host's pages.

A hot host is cut into parts of bounded size by page; each part has a suffix array of its own.  A run on a share of the host's pages
is on that share of a part's pages in one part at least; these runs are then counted over all distinct pages, so the result does not
depend on the cut.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceassay.llm.store import free_name, settle, slices
from sourceassay.llm.words import WordHashes, mix

#: Tokens of a repeated run at least (a block's edge counts as one), the distinct pages it must be on, and their share of a host's.
RUN, PAGES, SHARE = 5, 2, 0.25
#: The share of a host's pages where the markup checks the outcome.
CHECKED_SHARE = 0.01
#: Bytes of html in one part of a host, about.
PART_BYTES = 4 << 20
#: Bytes of html that one step of a task takes at a time.
PIECE_BYTES = 4 << 20
#: So many repeated runs go to every task; more are joined by a shuffle of the pages.
LISTED_RUNS = 1 << 20

# A quote opens a value only behind an equals sign, and only if it is closed; a tag ends at the first ``>`` outside a value, or with the page.
# Nothing is tried twice (possessive repeats), so reading is linear however broken the markup is.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never main text.
DROPPED = frozenset("head nav footer aside form button select option template noscript svg canvas object audio video dialog menu".split())
#: Words of class, id and role that mark an element as no main text, if a name holds nothing else but these and ``NEUTRAL`` words.
MARKED = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead topbar footer contentinfo colophon "
    "sidebar aside complementary ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr popup modal dialog alert overlay newsletter subscribe signup login search "
    "share sharing social related recommended widget comment comments respond replies disqus skip".split())
NEUTRAL = frozenset("site main top bottom left right primary secondary global bar box block container inner wrapper wrap list link links button buttons "
                    "item items section area slot unit".split())
#: Marks that don't count inside the main element: its own header, and, as ids, all but the readers' comments.
_HEADERS = frozenset(("header", "masthead"))
_READERS = frozenset("comment comments respond replies disqus".split())
#: Elements that end the block before them and begin a new one.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
_CELLS = frozenset(("td", "th", "br"))
_MAIN = frozenset(("article", "main"))
#: Elements whose marks say nothing about their text.
_UNMARKED = _MAIN | {"html", "body"}


def _is_marked(attributes: str, in_main: bool) -> bool:
    for kind, value in _MARK.findall(attributes):
        for name in value.strip("\"'").lower().split():
            words = set(re.split(r"[^a-z]+", name)) - {""}
            marks = words & MARKED
            if in_main:
                marks = marks & _READERS if kind.lower() == "id" else marks - _HEADERS
            if marks and words <= MARKED | NEUTRAL:
                return True
    return False


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page has a main element, and the blocks of its main text (or else of all text that is not marked)."""
    whole, found = placed(page)
    return whole, [text for text, kept in found if kept]


def placed(page: str | None) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the page has a main element, and all its blocks in page order, menus and adverts included; with each, whether the markup keeps it.

    If all its main elements stand in marked elements or forms, these are wrappers, and their marks don't count.
    """
    if not page:
        return False, []
    seen_main, hidden_main, found = _read(page, False)
    return _read(page, True)[::2] if hidden_main and not seen_main else (seen_main, found)


def _read(page: str, lift: bool) -> tuple[bool, bool, list[tuple[str, bool]]]:
    """Whether a main element is seen, whether one is only hidden by marks or forms, and the blocks; ``lift`` shows the hidden ones."""
    found: list[tuple[str, int]] = []  # blocks, and where they stand: 0 outside of main elements, 1 inside, 2 in a dropped element
    block: list[str] = []
    away: list[str] = []  # text of dropped elements since the last block
    stack: list[tuple[str, int]] = []  # open elements that matter, and whether they are dropped: 1 by their kind, 2 as what may be a wrapper
    dropped = mains = 0
    seen_main = hidden_main = False
    at, end = 0, len(page)

    def flush():
        for parts, place in (block, mains > 0), (away, 2):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    found.append((text, place))
                parts.clear()

    while at < end:
        tag = _TAG.search(page, at)
        (away if dropped else block).append(html.unescape(page[at : tag.start() if tag else end]))
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = tag[1] == "/"
        if name in BLOCKS:
            flush()
            if not closing and stack and stack[-1][0] == "p":
                dropped -= stack.pop()[1] > 0
        elif name in _CELLS:
            (away if dropped else block).append(" ")
        if closing:
            if any(n == name for n, _ in stack):
                while stack:
                    n, gone = stack.pop()
                    dropped -= gone > 0
                    mains -= n in _MAIN
                    if n == name:
                        break
            continue
        if name in VOID or (tag[3] or "").endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        gone = 0
        if name != "form" and (name in DROPPED or (name == "header" and not mains)):
            gone = 1
        elif name == "form" or (name not in _UNMARKED and _is_marked(tag[3] or "", mains > 0)):
            gone = 2
        if gone or name in _MAIN or any(n == name for n, _ in stack):
            if name in _MAIN and dropped and all(g != 1 for _, g in stack):
                hidden_main = True
                if lift:
                    stack = [(n, 0) for n, _ in stack]
                    dropped = 0
            stack.append((name, gone))
            dropped += gone > 0
            if name in _MAIN:
                mains += 1
                seen_main |= not dropped
    flush()
    return seen_main, hidden_main, [(text, place == seen_main) for text, place in found]


#: The token before, between and after the blocks of a page; no word holds it.
_EDGE = np.uint64(WordHashes()[b"\n"])


def _stream(pages: list[list[str]], hashes: WordHashes) -> np.ndarray:
    """Token hashes of the pages' blocks, page after page: words, and an edge before, between and after the blocks of a page."""
    text = " ".join("\n " + " \n ".join(parts) + " \n" for parts in pages)
    return hashes.of(text.encode("utf-8", "surrogatepass").split(b" "))


def _codes(tokens: np.ndarray, run: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``run`` tokens from each place, or from those in ``at``."""
    many = max(0, len(tokens) - run + 1)
    code = np.zeros(many if at is None else len(at), np.uint64)
    for k in range(run):
        code = code * np.uint64(0x9E3779B97F4A7C15) + (tokens[k : k + many] if at is None else tokens[at + k])
    return mix(code).view(np.int64)


def repeated_runs(streams: list[np.ndarray], run: int, least: float = 1) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(hash, pages, starts) of each distinct run of ``run`` tokens on ``least`` distinct pages, by a suffix array over all streams.

    The suffixes are sorted by their first ``run`` tokens, which is all that tells equal runs apart.
    """
    size = np.array([len(s) for s in streams])
    tokens = np.concatenate(streams)
    page = np.repeat(np.arange(len(streams)), size)
    start = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - start
    # Rank by one token, then by two, four ... tokens; the last doubling may overlap.
    _, rank = np.unique(tokens, return_inverse=True)
    span = 1
    while span < run:
        step = min(span, run - span)
        following = np.full(len(rank), -1, np.int64)
        following[:-step] = rank[step:]
        following[left <= step] = -1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + following + 1, return_inverse=True)
        span += step
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[left[suffixes] >= run]
    if not len(suffixes):
        return []
    page, start = page[suffixes], start[suffixes]
    first = np.r_[0, np.flatnonzero(np.diff(rank[suffixes])) + 1]
    end = np.r_[first[1:], len(suffixes)]
    # Equal suffixes stand in the order of their pages.
    turn = np.r_[True, page[1:] != page[:-1]]
    turn[first] = True
    often = np.add.reduceat(turn, first, dtype=np.int64) >= least
    code = _codes(tokens, run, suffixes[first[often]])
    return [(c, page[a:b], start[a:b]) for c, a, b in zip(code.tolist(), first[often].tolist(), end[often].tolist())]


def _digest(parts: list[str]) -> bytes:
    return hashlib.md5("\n".join(parts).encode("utf-8", "surrogatepass")).digest()


def _comparable(found: list[tuple[str, bool]]) -> tuple[bytes, bytes, list[str]] | None:
    """Digests of the kept and of all blocks, and all blocks, of a page that counts: one with text."""
    kept = [text for text, stays in found if stays]
    parts = [text for text, _ in found]
    return (_digest(kept), _digest(parts), parts) if kept else None


def _streams(batches):
    """Pages with text and their part of the host; copies that one task meets are given once."""
    seen = set()
    for batch in batches:
        out = []
        for host, parts, page in zip(*(batch.column(k).to_pylist() for k in ("host", "parts", "html"))):
            got = _comparable(placed(page)[1])
            if got and (key := (host, *got[:2])) not in seen:
                seen.add(key)
                out.append((host, parts, int.from_bytes(got[0][:7], "big") % parts, *got))
        if len(seen) > 100_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())))],
            names=["host", "parts", "part", "kept", "page", "blocks"])


def _host_part(run: int, least_pages: int, share: float):
    """The runs of a part that may be on ``share`` of the host's pages, and the distinct pages that they are on."""
    def of(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        pages, parts = table.num_rows, table.column("parts")[0].as_py()
        least = share * pages * (1 - 1e-9) if parts > 1 else max(least_pages, share * pages)
        found = repeated_runs([_stream([b], hashes) for b in table.column("blocks").to_pylist()], run, least)
        return pa.table({
            "host": table.column("host").slice(0, 1), "parts": pa.array([parts], pa.int64()), "all_pages": pa.array([pages], pa.int64()),
            "runs": pa.array([[c for c, _, _ in found]], pa.list_(pa.int64())),
            "pages": pa.array([[1 + np.count_nonzero(np.diff(p)) for _, p, _ in found]], pa.list_(pa.int64()))})
    return of


#: Of a host: its repeated runs, sorted, and which of them are on the larger share of its pages.
Runs = tuple[np.ndarray, np.ndarray]


def _found(tokens: np.ndarray, runs: Runs, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the run from each token: whether it is listed, and its place in the list.  No listed run reaches over two pages."""
    codes = _codes(tokens, run)
    at = np.searchsorted(runs[0], codes)
    at[at == len(runs[0])] = 0
    return runs[0][at] == codes, at


def _covered(tokens: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    """Whether runs from ``starts`` cover a block whole, with both edges; blocks of all pages in order."""
    change = np.zeros(len(tokens) + 1, np.int64)
    change[: len(starts)] += starts
    change[run : run + len(starts)] -= starts
    bare = np.r_[0, np.cumsum(np.cumsum(change[:-1]) == 0)]
    edges = np.flatnonzero(tokens == _EDGE)
    begin, end = edges[:-1], edges[1:]
    return (bare[end + 1] == bare[begin])[end > begin + 1]


def _by_host(hosts: list[str], pages: list, lists: dict[str, Runs]) -> dict[str, list[int]]:
    """The rows of each listed host whose pages are not empty."""
    rows: dict[str, list[int]] = {}
    for k, host in enumerate(hosts):
        if pages[k] and host in lists:
            rows.setdefault(host, []).append(k)
    return rows


_MAIN_TEXT = pa.struct([("text", pa.string()), ("n_blocks", pa.int64()), ("n_repeated", pa.int64()), ("n_restored", pa.int64())])


def _decide(run: int):
    """doc and main: the host's runs decide blocks, then the markup checks them."""
    def of(batch, lists: dict[str, Runs], hashes: WordHashes):
        read = [placed(page) for page in batch.column("html").to_pylist()]
        parts = [[text for text, _ in found] for _, found in read]
        marks = [([False] * len(p),) * 2 for p in parts]
        for host, rows in _by_host(batch.column("host").to_pylist(), parts, lists).items():
            tokens = _stream([parts[k] for k in rows], hashes)
            listed, at = _found(tokens, lists[host], run)
            if listed.any():
                repeated, shared = _covered(tokens, listed, run).tolist(), _covered(tokens, listed & lists[host][1][at], run).tolist()
                done = 0
                for k in rows:
                    ends = done + len(parts[k])
                    marks[k] = repeated[done:ends], shared[done:ends]
                    done = ends
        mains = []
        for (whole, found), (repeated, shared) in zip(read, marks):
            # The check: the blocks of the main element are restored, marked blocks go, repeated or not.
            stay = [kept and (whole or not often) for (_, kept), often in zip(found, shared)]
            mains.append({"text": "\n".join([text for (text, _), stays in zip(found, stay) if stays]), "n_blocks": len(found),
                          "n_repeated": sum(repeated), "n_restored": sum(stays and twice for stays, twice in zip(stay, repeated))})
        return [batch.column("doc"), pa.array(mains, _MAIN_TEXT)], ["doc", "main"]
    return of


def _occurrences(run: int):
    """host, digests of the kept and of all blocks, and the listed runs of each page that counts."""
    def of(batch, lists: dict[str, Runs], hashes: WordHashes):
        hosts = batch.column("host").to_pylist()
        read = [_comparable(placed(page)[1]) if host in lists else None for host, page in zip(hosts, batch.column("html").to_pylist())]
        out = []
        for host, rows in _by_host(hosts, read, lists).items():
            tokens = _stream([read[k][2] for k in rows], hashes)
            listed, at = _found(tokens, lists[host], run)
            # A page begins with the stream, or at the second of two edges.
            edge = tokens == _EDGE
            page = np.cumsum(edge[1:] & edge[:-1])
            page = np.r_[0, page][: len(at)][listed]
            pairs = np.unique(page * len(lists[host][0]) + at[listed])
            page, at = np.divmod(pairs, len(lists[host][0]))
            ends = np.searchsorted(page, np.arange(len(rows) + 1))
            out += [(host, *read[k][:2], lists[host][0][at[a:b]]) for k, a, b in zip(rows, ends, ends[1:])]
        types = pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())
        return [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["host", "kept", "page", "runs"]
    return of


def _listed(runs: DataFrame) -> DataFrame:
    """The sorted runs of each host in one row, and which of them are shared."""
    return (runs.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("run", "shared"))).alias("r"))
            .select("host", F.col("r.run").alias("listed"), F.col("r.shared").alias("shared")))


def _with_runs(base: DataFrame, lists: DataFrame, parts: DataFrame, work: Callable, schema: str, most: int) -> DataFrame:
    """``work`` over batches of ``base`` (doc, host, html) with the runs of their hosts (host, listed array<long>, shared array<boolean>).

    At most ``most`` runs go through the driver to every task; else pages and runs meet in a shuffle by part of a host.
    """
    def tables(rows) -> dict[str, Runs]:
        return {host: (np.array(listed, np.int64), np.array(shared, bool)) for host, listed, shared in rows}

    if (lists.agg(F.sum(F.size("listed"))).first()[0] or 0) <= most:
        known = base.sparkSession.sparkContext.broadcast(tables(lists.select("host", "listed", "shared").collect()))

        def mapped(batches):
            hashes = WordHashes()
            for batch in batches:
                for piece in slices(batch, batch.schema.get_field_index("html"), PIECE_BYTES):
                    arrays, names = work(piece, known.value, hashes)
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        return base.mapInArrow(mapped, schema)

    def grouped(pages: pa.Table, listed: pa.Table) -> pa.Table:
        rows = zip(*(listed.column(name).to_pylist() for name in ("host", "listed", "shared")))  # one, or none
        arrays, names = work(pages, tables(rows), WordHashes())
        return pa.table(arrays, names=names)

    cut = F.coalesce("parts", F.lit(1))
    dealt = base.join(parts, "host", "left").select(*base.columns, F.pmod(F.monotonically_increasing_id(), cut).alias("part"))
    copies = lists.join(parts, "host", "left").select("host", "listed", "shared", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("part"))
    return dealt.groupBy("host", "part").cogroup(copies.groupBy("host", "part")).applyInArrow(grouped, schema)


def decide(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, part_bytes: int = PART_BYTES, share: float = SHARE,
           checked_share: float = CHECKED_SHARE, listed_runs: int = LISTED_RUNS) -> DataFrame:
    """Each row of ``pages`` as ``doc`` (all columns but ``html``) and ``main``: text, n_blocks, n_repeated and n_restored.

    Null, empty and textless pages have an empty text.  All pages with text are compared within their host (the url's authority without
    user and port, lower case; pages with a null or odd url have no host, and only the markup decides them).  n_repeated blocks are
    covered by runs that stand on ``checked_share`` of the host's distinct pages (``least_pages`` at least).  n_restored of them stay: the main
    element's blocks, and unmarked blocks of a page without one, if such runs on ``share`` of the pages don't cover them.  Pages of
    equal kept blocks count once, with the smallest digest of all their blocks, so copies of a page don't cover each other.  An empty table gives no rows.
    Memory follows one page, or one part of a host.
    """
    checked_share = min(checked_share, share)
    keep = [c for c in pages.columns if c != "html"]
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc") if keep else F.struct(F.lit(1).alias("none")).alias("doc")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    base = pages.select(doc, host.alias("host"), "html")
    parts = settle(base.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")).where(F.col("size") > part_bytes)
                   .select("host", F.ceil(F.col("size") / part_bytes).cast("long").alias("parts")), "hosts")
    compared = (base.where("host <> ''").join(parts, "host", "left").select("host", F.coalesce("parts", F.lit(1)).cast("long").alias("parts"), "html")
                .mapInArrow(_streams, "host string, parts long, part long, kept binary, page binary, blocks array<string>"))
    # One shuffle: the distinct pages of a part lie where its suffix array is built.
    distinct = (compared.repartition("host", "part").groupBy("host", "part", "kept").agg(F.min_by(F.struct("parts", "blocks"), "page").alias("p"))
                .select("host", "part", "p.parts", "p.blocks"))
    runs = settle(distinct.groupBy("host", "part").applyInArrow(
        _host_part(run, least_pages, checked_share), "host string, parts long, all_pages long, runs array<long>, pages array<long>"), "runs")
    hosts = runs.groupBy("host").agg(F.sum("all_pages").alias("all_pages"))
    counted = runs.where("parts = 1").select("host", F.explode(F.arrays_zip("runs", "pages")).alias("r")).select("host", "r.runs", "r.pages")
    if not parts.isEmpty():
        likely = runs.where("parts > 1").select("host", F.explode("runs").alias("run")).distinct()
        likely = settle(_listed(likely.withColumn("shared", F.lit(False))), "likely-runs")
        on = _with_runs(base.where("host <> ''").join(parts, "host", "left_semi").select(*base.columns), likely, parts, _occurrences(run),
                        "host string, kept binary, page binary, runs array<long>", listed_runs)
        on = on.groupBy("host", "kept").agg(F.min_by("runs", "page").alias("runs")).select("host", F.explode("runs").alias("runs"))
        counted = counted.unionByName(on.groupBy("host", "runs").agg(F.count("*").alias("pages")))
    enough = (F.col("pages") >= least_pages) & (F.col("pages") >= F.col("all_pages") * checked_share)
    lists = settle(_listed(counted.join(hosts, "host").where(enough).select(
        "host", F.col("runs").alias("run"), (F.col("pages") >= F.col("all_pages") * share).alias("shared"))), "repeated-runs")
    schema = StructType([base.schema["doc"], *StructType.fromDDL("main struct<text:string,n_blocks:long,n_repeated:long,n_restored:long>")])
    return _with_runs(base, lists, parts, _decide(run), schema, listed_runs)


def extract(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, part_bytes: int = PART_BYTES, share: float = SHARE,
            **more) -> tuple[DataFrame, str]:
    """``pages`` with all columns but ``html`` and the main text of ``decide``; and that column's name (``text`` or the next free one)."""
    keep = [c for c in pages.columns if c != "html"]
    name = free_name(pages.select(*[f"`{c}`" for c in keep]), "text")
    found = decide(pages, run, least_pages, part_bytes, share, **more)
    return found.select(*[F.col("doc")[c].alias(c) for c in keep], F.col("main.text").alias(name)), name


def op9(spark, sf_dir: str) -> DataFrame:
    found = decide(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("doc.page_id", "doc.url", "main.text", F.length("main.text").cast("long").alias("n_chars"),
                        "main.n_blocks", "main.n_repeated", "main.n_restored")
