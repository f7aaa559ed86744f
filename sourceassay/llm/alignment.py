"""Operator 12, cross-tokenizer alignment: an associative fragment monoid.

Two tokenizers cut the same bytes (a space and the text).  Byte offsets at which tokens of both end cut them
into groups; every token of A is linked with every token of B in its group.

A *fragment* is what is known of a byte range on its own: an open prefix (tokens up to the first common end), the
closed groups between common ends, and an open suffix.  Fragments of neighbouring ranges compose: the suffix of
the left one and the prefix of the right one become a closed group, or stay open where a side has no
common end.  Composition is associative, so ranges are aligned in parallel and put together by a tree.

* Texts longer than ``CHUNK`` bytes are cut into byte ranges over Spark tasks.  A task encodes from the first safe place in its range
  to the first one in a later range and deals the tokens to the ranges they end in; only the open ends then go through the tree
  reduction, level by level, while closed groups stay where they are written.
* A shorter text is composed inside its task of the fragments of its *units*, which are remembered.

A unit reaches from one safe place to the next: a space behind a character that is no white space.  No token of
either vocabulary holds anything but white space in front of a space (``Tokenizers`` checks it), A's pre-tokenizer and
B's merges never reach over such a place, so ids of units in order are the ids of the whole text.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceassay.llm.store import free_name, settle, slices, tidy

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of a range; shorter texts are one range.
CHUNK = 1 << 16
#: Fragments that one step of the tree composes, and id pairs whose counts are broadcast (16 MB); all other pairs are joined by a shuffle.
FAN, HEADS = 16, 1 << 20
#: Bytes of text that a task holds as Python objects at once (plus one text), and units and bytes that it remembers.
TEXT_BYTES, UNITS, UNIT_BYTES = 1 << 20, 250_000, 16 << 20


#: A space behind a character that is no white space.
_SAFE = re.compile(r"(?<=\S) ")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.lone_space = self.b.encode("a ")[len(self.b.encode("a")):]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        if any(_SAFE.search(x.decode("utf-8", "replace")) for x in [*self.a_bytes, *self.b_bytes]):
            raise ValueError("a token reaches over a space")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and the piece; B adds the space itself, except to an empty piece."""
        a = self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)
        return [e.ids for e in a], [x if p else self.lone_space for p, x in zip(pieces, self.b.encode(pieces, num_threads=1))]


@lru_cache(maxsize=2)
def loaded(a_path: str, b_path: str) -> "Units":
    return Units(Tokenizers(a_path, b_path))


def split(text: str) -> list[str]:
    """Units of a text, without their first space."""
    units: list[str] = []
    for piece in text.split(" "):
        if units and (not units[-1] or units[-1][-1].isspace()):
            units[-1] += " " + piece
        else:
            units.append(piece)
    return units


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    return np.intersect1d(ends_a, ends_b, assume_unique=True)


def _tagged(owner: np.ndarray, ids: np.ndarray, weight: np.ndarray, base: int):
    """Distinct (owner, id) with the sum of their weights, ordered."""
    key = owner.astype(np.int64) * base + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    return key // base, key % base, total


def group_links(group_a, ids_a, group_b, ids_b, owner_of_group, size_a: int, size_b: int):
    """``owner, pair, links`` out of the tokens' groups: distinct ids of a group are crossed, their counts multiplied.

    A pair is A's id times ``size_b`` plus B's id.
    """
    ga, a, na = _tagged(group_a, ids_a, np.ones(len(ids_a), np.int64), size_a)
    gb, b, nb = _tagged(group_b, ids_b, np.ones(len(ids_b), np.int64), size_b)
    low, high = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    times = high - low
    left = np.repeat(np.arange(len(a)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    return _tagged(owner_of_group[ga[left]], a[left] * size_b + b[right], na[left] * nb[right], size_a * size_b)


def group_texts(ids_a, bounds_a, ids_b, bounds_b) -> list[str]:
    """``a1,a2|b1`` of each group."""
    a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    out, i, j = [], 0, 0
    for x, y in zip(bounds_a.tolist(), bounds_b.tolist()):
        out.append(f"{','.join(a[i:x])}|{','.join(b[j:y])}")
        i, j = x, y
    return out


class _Lists:
    """Lists of one number per unit, flat, with room to grow."""

    def __init__(self, kind):
        self.flat, self.at = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, flat, sizes) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def keep(self, units: np.ndarray) -> None:
        self.flat, sizes = self.take(units)
        self.at = np.r_[0, np.cumsum(sizes)]

    def take(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of the units in order, and their numbers."""
        sizes = self.at[units + 1] - self.at[units]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.at[units], sizes) + inner], sizes


class Units:
    """Fragments of units, remembered; both ends of a unit are common ends, so nothing of them is open."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.size_a, self.size_b = len(tok.a_bytes), len(tok.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.a, self.b, self.pair, self.links = _Lists(np.int32), _Lists(np.int32), _Lists(np.int64), _Lists(np.int64)
        self.groups, self.ok, self.open = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)
        self.bytes = 0

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces, which are encoded if they are new.  Places hold until the next ``trim``."""
        new = list(dict.fromkeys(p for p in pieces if p not in self.place))
        if new:
            self._add(new)
        places = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        self.used += np.bincount(places, minlength=len(self.used))
        return places

    def trim(self) -> None:
        """Forget the units that were used least once there are too many; half of them stay at most."""
        if len(self.text) <= UNITS and self.bytes <= UNIT_BYTES:
            return
        pieces = list(self.place)
        best = np.argsort(-self.used, kind="stable")[:UNITS // 2]
        best = best[self.used[best] > 1]
        sizes = np.cumsum([len(pieces[k]) for k in best.tolist()])
        kept = np.sort(best[sizes <= UNIT_BYTES // 2])
        self.place = {pieces[k]: n for n, k in enumerate(kept.tolist())}
        self.text = [self.text[k] for k in kept.tolist()]
        for lists in (self.a, self.b, self.pair, self.links):
            lists.keep(kept)
        self.groups, self.ok, self.open, self.used = self.groups[kept], self.ok[kept], self.open[kept], self.used[kept] // 2
        self.bytes = sum(map(len, self.place))

    def _add(self, new: list[str]) -> None:
        tok = self.tok
        a, b = tok.encode(new)
        sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.array([i for x in a for i in x], np.int64), np.array([i for x in b for i in x], np.int64)
        want = [b" " + p.encode("utf-8", "surrogatepass") for p in new]
        sizes = np.array([len(w) for w in want])
        ok = ((np.bincount(np.repeat(np.arange(len(new)), sizes_a), tok.a_sizes[ids_a], len(new)) == sizes)
              & (np.bincount(np.repeat(np.arange(len(new)), sizes_b), tok.b_sizes[ids_b], len(new)) == sizes))
        joined = b"".join(want)
        if not (ok.all() and b"".join(map(tok.a_bytes.__getitem__, ids_a.tolist())) == joined
                == b"".join(map(tok.b_bytes.__getitem__, ids_b.tolist()))):
            ok = np.array([b"".join(map(tok.a_bytes.__getitem__, x)) == w == b"".join(map(tok.b_bytes.__getitem__, y))
                           for x, y, w in zip(a, b, want)], bool)
        # Units whose bytes differ have no groups: their tokens are left out below.
        in_a, in_b = np.repeat(ok, sizes_a), np.repeat(ok, sizes_b)
        good_a, good_b = ids_a[in_a], ids_b[in_b]
        ends_a, ends_b = np.cumsum(tok.a_sizes[good_a]), np.cumsum(tok.b_sizes[good_b])
        ends = common_ends(ends_a, ends_b)
        unit_ends = np.cumsum(sizes[ok])
        unit = np.flatnonzero(ok)[np.searchsorted(unit_ends, ends)]
        texts = group_texts(good_a, np.searchsorted(ends_a, ends, "right"), good_b, np.searchsorted(ends_b, ends, "right"))
        owner, pair, links = group_links(np.searchsorted(ends, ends_a), good_a, np.searchsorted(ends, ends_b), good_b,
                                         unit, self.size_a, self.size_b)
        groups = np.bincount(unit, minlength=len(new))
        at = 0
        for k, (p, n) in enumerate(zip(new, groups.tolist())):
            self.place[p] = len(self.text)
            self.text.append(";".join(texts[at:at + n]))
            at += n
        self.a.extend(ids_a, sizes_a)
        self.b.extend(ids_b, sizes_b)
        counts = np.bincount(owner, minlength=len(new))
        self.pair.extend(pair, counts)
        self.links.extend(links, counts)
        self.groups = np.concatenate([self.groups, groups])
        self.ok = np.concatenate([self.ok, ok])
        self.open = np.concatenate([self.open, [not p or p[-1].isspace() for p in new]])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.bytes += sum(map(len, new))

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units of all texts in order, and the number of units of each text."""
        parts = [t.split(" ") for t in texts]
        places = self.look_up([p for x in parts for p in x])
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        inner = self.open[places]
        inner[ends - 1] = False  # what follows the last piece is the text's end
        merged = np.unique(np.searchsorted(ends, np.flatnonzero(inner), "right")).tolist()
        if merged:  # white space in front of a space: these texts have longer units
            for k in merged:
                parts[k] = split(texts[k])
            places = self.look_up([p for x in parts for p in x])
            sizes = np.array([len(x) for x in parts])
        return places, sizes


_STATS = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
          "pairs array<long>, links array<long>")


def _nested(values: np.ndarray, sizes: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _whole(a_path: str, b_path: str, names: list[str], keep_groups: bool):
    """Replace the texts (the last column), each of one range, by their alignment; ``names`` are those of the result."""
    def run(batches):
        known = loaded(a_path, b_path)
        for batch in (part for b in batches for part in slices(b, b.num_columns - 1, TEXT_BYTES)):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            places, sizes = known.of_texts(texts)
            owner = np.repeat(np.arange(len(texts)), sizes)
            good = np.bincount(owner, ~known.ok[places], len(texts)) == 0
            good &= np.array([bool(t) for t in texts])
            keep = good[owner]
            places, owner = places[keep], owner[keep]
            def total(per_unit):
                return np.bincount(owner, per_unit[places], len(texts)).astype(np.int64)
            # Units of a text once, with their number; then their pairs, added up for the text.
            doc, unit, times = _tagged(owner, places, np.ones(len(places), np.int64), len(known.text) + 1)
            pair, n = known.pair.take(unit)
            doc, pair, links = _tagged(np.repeat(doc, n), pair, known.links.take(unit)[0] * np.repeat(times, n),
                                       known.size_a * known.size_b)
            digests, groups, at = [], [], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].tolist()
            listed = places.tolist()
            for k in range(len(texts)):
                joined = ";".join(map(known.text.__getitem__, listed[at[k]:at[k + 1]]))
                digests.append(hashlib.sha256(joined.encode()).hexdigest() if good[k] else "")
                groups.append(joined if keep_groups else None)
            counts = np.bincount(doc, minlength=len(texts))
            columns = batch.columns[:-1] + [pa.array(total(np.diff(known.a.at))), pa.array(total(np.diff(known.b.at))), pa.array(total(known.groups)),
                        pa.array(np.bincount(doc, links, len(texts)).astype(np.int64)),
                        pa.array(digests, pa.string()), pa.array(groups, pa.string()), _nested(pair, counts), _nested(links, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            known.trim()
    return tidy(run)


def _windows(chunk: int):
    """``row, k, start, text`` of the windows of long texts, each from a safe place to the first one at least ``chunk`` code points on.

    ``start`` counts the bytes of a space and the text in front of the window; the text of a window lacks its first space.
    """
    names = ["row", "k", "start", "text"]
    def run(batches):
        for row, text in ((r, t) for b in batches for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            whole = " " + text
            begin = at = start = 0  # code points in front of the window, its number, bytes in front of it
            while begin < len(whole):
                found = _SAFE.search(whole, begin + chunk) if begin + chunk < len(whole) else None
                end = found.start() if found else len(whole)
                piece = whole[begin + 1:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([at], pa.int32()), pa.array([start], pa.int64()), pa.array([piece], pa.string())], names=names)
                start += len(piece.encode("utf-8", "surrogatepass")) + 1
                begin, at = end, at + 1
    return run


_FRAGMENT = (
    "row long, j long, k int, ok boolean, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, "
    "n_a long, n_b long, n_groups long, closed string, pairs array<long>, links array<long>")


def fragments(ids_a, ends_a, ids_b, ends_b, chunk: int):
    """Fragments of a stream of tokens, one for each byte range ``j`` (ends in ``(j * chunk, (j + 1) * chunk]``) that has any.

    Yields ``j, cut, head, closed, tail``; heads and tails are pairs of id arrays, ``closed`` is
    (ids_a, bounds_a, ids_b, bounds_b) of the groups in between.  Without a common end everything is head.
    """
    ends = common_ends(ends_a, ends_b)
    empty = ids_a[:0]
    for j in np.unique(np.r_[(ends_a - 1) // chunk, (ends_b - 1) // chunk]).tolist():
        la, ha = np.searchsorted(ends_a, [j * chunk, (j + 1) * chunk], "right")
        lb, hb = np.searchsorted(ends_b, [j * chunk, (j + 1) * chunk], "right")
        lc, hc = np.searchsorted(ends, [j * chunk, (j + 1) * chunk], "right")
        if lc == hc:
            yield j, False, (ids_a[la:ha], ids_b[lb:hb]), (empty, empty, empty, empty), (empty, empty)
            continue
        bounds_a, bounds_b = np.searchsorted(ends_a, ends[lc:hc], "right"), np.searchsorted(ends_b, ends[lc:hc], "right")
        fa, fb, ta, tb = bounds_a[0], bounds_b[0], bounds_a[-1], bounds_b[-1]
        yield (j, True, (ids_a[la:fa], ids_b[lb:fb]), (ids_a[fa:ta], bounds_a[1:] - fa, ids_b[fb:tb], bounds_b[1:] - fb),
               (ids_a[ta:ha], ids_b[tb:hb]))


def _links_of(groups, size_a: int, size_b: int):
    """Pairs and links of (ids_a, bounds_a, ids_b, bounds_b), all groups together."""
    ids_a, bounds_a, ids_b, bounds_b = groups
    n = len(bounds_a)
    group_a = np.searchsorted(bounds_a, np.arange(len(ids_a)), "right")
    group_b = np.searchsorted(bounds_b, np.arange(len(ids_b)), "right")
    _, pair, links = group_links(group_a, ids_a.astype(np.int64), group_b, ids_b.astype(np.int64), np.zeros(n, np.int64), size_a, size_b)
    return pair, links


def _fragments(a_path: str, b_path: str, chunk: int):
    """Fragments of windows."""
    def run(batches):
        known = loaded(a_path, b_path)
        tok = known.tok
        for row, k, start, text in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            places, _ = known.of_texts([text])
            ok = bool(known.ok[places].all())
            ids_a, ids_b = known.a.take(places)[0], known.b.take(places)[0]
            if not ok:  # the text has no tokens: one empty fragment says so
                ids_a = ids_b = ids_a[:0]
            rows = []
            for j, cut, head, closed, tail in fragments(ids_a, start + np.cumsum(tok.a_sizes[ids_a]),
                                                        ids_b, start + np.cumsum(tok.b_sizes[ids_b]), chunk):
                pair, links = _links_of(closed, known.size_a, known.size_b)
                texts = group_texts(*closed)
                rows.append((row, j, k, ok, cut, *map(np.ndarray.tolist, (*head, *tail)), sum(len(x[0]) for x in (head, closed, tail)),
                             len(head[1]) + len(closed[2]) + len(tail[1]), len(texts), ";".join(texts) if texts else None,
                             pair.tolist(), links.tolist()))
            if not rows:
                rows = [(row, start // chunk, k, ok, False, [], [], [], [], 0, 0, 0, None, [], [])]
            schema = _arrow(_FRAGMENT)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
            known.trim()
    return tidy(run)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def compose(left: dict | None, right: dict) -> tuple[dict, dict | None]:
    """The fragment of two neighbouring ranges, and the group that closes between them, if one does.

    ``None`` is the fragment of nothing.  A closed group is placed behind the last range of the left side.
    """
    if left is None:
        return right, None
    last = {"j": right["last_j"], "k": right["last_k"]}
    whole = {"cut": left["cut"] or right["cut"], "last_j": last["j"], "last_k": last["k"], "first_j": left["first_j"]}
    if not left["cut"]:
        return whole | {"head_a": left["head_a"] + right["head_a"], "head_b": left["head_b"] + right["head_b"],
                        "tail_a": right["tail_a"], "tail_b": right["tail_b"]}, None
    between_a, between_b = left["tail_a"] + right["head_a"], left["tail_b"] + right["head_b"]
    heads = {"head_a": left["head_a"], "head_b": left["head_b"]}
    if not right["cut"]:
        return whole | heads | {"tail_a": between_a, "tail_b": between_b}, None
    group = {"j": left["last_j"], "k": left["last_k"], "head_a": between_a, "head_b": between_b}
    return whole | heads | {"tail_a": right["tail_a"], "tail_b": right["tail_b"]}, group


_OPEN = (
    "row long, first_j long, last_j long, last_k int, cut boolean, head_a array<int>, head_b array<int>, "
    "tail_a array<int>, tail_b array<int>, closed boolean")


def _compose_group(table: pa.Table) -> pa.Table:
    """One fragment out of the neighbouring fragments of a text, and a row for each group that closes between them."""
    out, whole = [], None
    rows = sorted(table.drop_columns(["part"]).to_pylist(), key=lambda r: (r["first_j"], r["last_j"], r["last_k"]))
    for right in rows:
        whole, group = compose(whole, right)
        if group:
            out.append({"row": right["row"], "first_j": group["j"], "last_j": group["j"], "last_k": group["k"], "cut": True,
                        "head_a": group["head_a"], "head_b": group["head_b"], "tail_a": [], "tail_b": [], "closed": True})
    out.append(whole | {"row": rows[0]["row"], "closed": False})
    return pa.Table.from_pylist(out, schema=_arrow(_OPEN))


def _closed_links(size_a: int, size_b: int):
    """``row, j, k, text, pairs, links`` of groups that closed between ranges."""
    schema = _arrow(_GROUP)
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = np.array(r["head_a"], np.int64), np.array(r["head_b"], np.int64)
                groups = (a, np.array([len(a)]), b, np.array([len(b)]))
                pair, links = _links_of(groups, size_a, size_b)
                rows.append({"row": r["row"], "j": r["last_j"], "k": r["last_k"], "text": group_texts(*groups)[0],
                             "pairs": pair.tolist(), "links": links.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


_GROUP = "row long, j long, k int, text string, pairs array<long>, links array<long>"


def _digest_runs(batches):
    """SHA-256 over the texts of each row, joined by semicolons; rows come sorted, only one digest is open at a time."""
    current, digest = None, None
    for batch in batches:
        done = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if row != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = row, hashlib.sha256(text.encode())
            else:
                digest.update(b";" + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done])], names=["row", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()])], names=["row", "digest"])


def _align_long(long_texts: DataFrame, a_path: str, b_path: str, chunk: int, fan: int, keep_groups: bool) -> DataFrame:
    """``row`` and the columns of ``_STATS`` of texts longer than a range."""
    known = loaded(a_path, b_path)
    windows = (long_texts.select("row", "text").mapInArrow(_windows(chunk), "row long, k int, start long, text string")
               .repartition("row", "k"))
    found = settle(windows.mapInArrow(_fragments(a_path, b_path, chunk), _FRAGMENT), "fragments")
    bad = found.where(~F.col("ok")).select("row").distinct()
    level = found.select("row", F.col("j").alias("first_j"), F.col("j").alias("last_j"), F.col("k").alias("last_k"), "cut",
                         "head_a", "head_b", "tail_a", "tail_b")
    # The tree: as many levels as the longest text needs, at least one.
    longest, closed, width = (found.agg(F.max("j")).first()[0] or 0) + 1, [], 1
    while True:
        width *= fan
        part = F.floor(F.col("first_j") / width).alias("part")
        composed = settle(level.withColumn("part", part).groupBy("row", "part")
                          .applyInArrow(lambda t: _compose_group(t), _OPEN), "composed")
        closed.append(composed.where("closed"))
        level = composed.where("NOT closed").drop("closed")
        if width >= longest:
            break
    # What is left of a text: its first group, in front of the first common end.
    first = level.where("cut").withColumns({"last_j": F.lit(-1).cast("long"), "last_k": F.lit(0)})
    groups = first.select("row", "last_j", "last_k", "head_a", "head_b")
    for c in closed:
        groups = groups.unionByName(c.select("row", "last_j", "last_k", "head_a", "head_b"))
    groups = settle(groups.mapInArrow(_closed_links(known.size_a, known.size_b), _GROUP), "closed-groups")

    order = ["row", "j", "k", "o"]
    texts = found.where(F.col("closed").isNotNull()).select("row", "j", "k", F.lit(1).alias("o"), F.col("closed").alias("text"))
    texts = texts.unionByName(groups.select("row", "j", "k", F.lit(2).alias("o"), "text"))
    digests = (texts.repartition("row").sortWithinPartitions(*order).select("row", "text")
               .mapInArrow(_digest_runs, "row long, digest string"))
    counts = (found.select("row", "n_a", "n_b", "n_groups")
              .unionByName(groups.select("row", F.lit(0).cast("long").alias("n_a"), F.lit(0).cast("long").alias("n_b"),
                                         F.lit(1).cast("long").alias("n_groups")))
              .groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")]))
    pairs = (found.select("row", "pairs", "links").unionByName(groups.select("row", "pairs", "links"))
             .select("row", F.inline(F.arrays_zip("pairs", "links")))
             .groupBy("row", "pairs").agg(F.sum("links").alias("links"))
             .groupBy("row").agg(F.sum("links").alias("n_links"), F.sort_array(F.collect_list(F.struct("pairs", "links"))).alias("all")))
    whole = counts.join(pairs, "row").join(digests, "row").join(bad, "row", "left_anti")
    if keep_groups:  # the whole text's groups as one value, as long as the text a few times over
        joined = texts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("j", "k", "o", "text"))).alias("t"))
        whole = whole.join(joined.select("row", F.array_join("t.text", ";").alias("groups")), "row")
    none = F.array().cast("array<long>")
    found_or = {"n_a": F.lit(0), "n_b": F.lit(0), "n_groups": F.lit(0), "n_links": F.lit(0), "digest": F.lit("")}
    return (long_texts.select("row").join(whole, "row", "left")
            .select("row", *[F.coalesce(c, v.cast("long") if c != "digest" else v).alias("groups_sha256" if c == "digest" else c)
                             for c, v in found_or.items()],
                    F.coalesce("groups", F.lit("")).alias("groups") if keep_groups else F.lit(None).cast("string").alias("groups"),
                    F.coalesce("all.pairs", none).alias("pairs"), F.coalesce("all.links", none).alias("links")))


def align(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, chunk: int = CHUNK, fan: int = FAN,
          keep_groups: bool = False) -> tuple[DataFrame, str]:
    """All columns of ``docs`` but ``text`` and a struct (``aligned``, or the next free name); returned with that name.

    The struct has ``n_a, n_b, n_groups, n_links``, ``groups_sha256`` and, if asked, ``groups`` (``a1,a2|b1;a3|b2,b3``), and the
    distinct id ``pairs`` (A's id times the size of B's vocabulary plus B's id) of the text with the number of their ``links``.

    Null and empty texts, and texts whose tokens' bytes differ from a space and the text, have no tokens: zeros, '' and empty arrays.
    Repeated rows give repeated results; an empty table gives no rows.  Both paths must be readable on every executor.
    """
    name, row = free_name(docs, "aligned"), free_name(docs, "row")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.where(size <= chunk).select(*others, "text")
    stats = T.StructType.fromDDL(_STATS)
    spare = {f.name: free_name(docs, f.name) for f in stats}
    out = T.StructType([*short.schema.fields[:-1], *[T.StructField(spare[f.name], f.dataType) for f in stats]])
    short = short.mapInArrow(_whole(a_path, b_path, out.names, keep_groups), out)
    short = short.select(*others, F.struct(*[F.col(f"`{spare[f]}`").alias(f) for f in spare]).alias(name))
    long_ = settle(docs.where(size > chunk).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    whole = _align_long(long_.select(F.col(row).alias("row"), "text"), a_path, b_path, chunk, fan, keep_groups)
    whole = whole.select(F.col("row").alias(row), F.struct(*stats.names).alias(name))
    return short.unionByName(long_.join(whole, row).select(*others, name)), name


def pair_counts(aligned: DataFrame, pairs: str | Column, size_b: int) -> DataFrame:
    """``pair, docs, best``: the number of rows that hold a pair linked, and whether no pair of the same A id has more.

    Pairs are counted inside each task before anything moves; the highest count of each A id is at most one row per id of its vocabulary.
    """
    counts = settle(aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    a = F.floor(F.col("pair") / size_b)
    highest = F.broadcast(counts.groupBy(a.alias("a")).agg(F.max("docs").alias("highest")))
    return settle(counts.withColumn("a", a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best")), "counts")


def _score(shared, at: int):
    """``n_best, count_sum`` over the pairs that are known here; the others go on as ``rest``."""
    def run(batches):
        pair, docs, best = shared.value
        for batch in batches:
            lists, links = batch.column(at), batch.column(at + 1)
            sizes = np.diff(lists.offsets.to_numpy())
            own = lists.flatten().to_numpy()
            n = links.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[place] == own if len(pair) else np.zeros(len(own), bool)
            place = place[hit]
            def total(x):  # exact sums of integers
                sums = np.zeros(batch.num_rows, np.int64)
                np.add.at(sums, doc[hit], x)
                return pa.array(sums)
            left = np.bincount(doc[~hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], total(n[hit] * best[place]), total(n[hit] * docs[place]),
                 _nested(own[~hit], left), _nested(n[~hit], left)],
                names=[*batch.schema.names[:at], "n_best", "count_sum", "rest", "rest_links"])
    return run


def link_scores(aligned: DataFrame, name: str = "aligned", b_path: str = B_PATH, heads: int = HEADS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` added to its struct, without the arrays of pairs.

    Counts of the most frequent pairs, at most ``heads``, are broadcast and looked up where the rows are.  The cut is a power of two
    that a histogram of the counts gives, so no pair of the rest stands for more than a 2 / ``heads`` part of all; the rest is
    joined with its counts by a shuffle.
    """
    spark = aligned.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    others = [F.col(f"`{c}`") for c in aligned.columns if c != name]
    stats = [f for f in aligned.schema[name].dataType.names if f not in ("pairs", "links")]
    base = settle(aligned.select(F.struct(*others).alias("doc"), F.struct(*[F.col(name)[f].alias(f) for f in stats]).alias("stats"),
                                 F.col(name)["pairs"].alias("pairs"), F.col(name)["links"].alias("links"),
                                 F.monotonically_increasing_id().alias("row")), "aligned")
    counts = pair_counts(base, "pairs", size_b)
    sizes = dict(counts.groupBy(F.floor(F.log2("docs")).alias("power")).count().collect())  # at most 64 rows
    least, held = 64, 0
    for power in sorted(sizes, reverse=True):
        held += sizes[power]
        if held > heads:
            break
        least = power
    top = counts.where(F.floor(F.log2("docs")) >= least).orderBy("pair").toArrow()  # at most `heads` rows
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "docs", "best")))
    schema = T.StructType.fromDDL("row long, n_best long, count_sum long, rest array<long>, rest_links array<long>")
    scored = settle(base.select("row", "pairs", "links").mapInArrow(_score(shared, 1), schema), "scored")
    rest = (scored.where(F.size("rest") > 0).select("row", F.inline(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_links").alias("links"))))
            .toDF("row", "pair", "links").join(counts, "pair")
            .groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum")))
    summed = (scored.select("row", "n_best", "count_sum").unionByName(rest)
              .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    columns = [c for c in aligned.columns if c != name]
    return (base.select("doc", "stats", "row").join(summed, "row")
            .select(*[F.col("doc")[c].alias(c) for c in columns],
                    F.struct(*[F.col("stats")[f].alias(f) for f in stats], "n_best", "count_sum").alias(name)))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned, name = align(docs)
    scored = link_scores(aligned, name)
    return scored.select("doc_id", *[F.col(name)[c].alias(c) for c in
                                     ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])
