"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared after folding: A-Z in lower case, and each run of ASCII characters that are no letter or
digit as one space. A stretch of text within ``budget`` edits of an item of length m shares at least
m + 1 - q - q * budget of its q-grams with it, on diagonals no further apart than the budget. Shared q-grams are counted
in diagonal bands that overlap by half, each wide enough for every such stretch; bands with enough are verified by a
banded alignment of the whole item against that region.

The budget is ``share`` of the item's length. Where the lemma says nothing for q-grams of ``Q`` bytes, an item is searched
by shorter ones, so that no budget is cut. An item shorter than q has no edits: it matches a text that folds to it or,
with ``inside``, each text that holds it as whole words. The index of items goes to every task, so it is built from parts
of the benchmark of at most ``PART`` bytes; a larger benchmark takes one pass over the documents for each part, and only
one part at a time is on the driver.

Odd rows: null and empty texts match nothing; null and empty items are not searched; equal items match alike, and rows
repeated in either table give repeated or equal results; an empty table gives no match. Other columns pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
Q, SHARE, PART = 12, 0.05, 8 << 20
#: Shared q-grams that are counted at once.
HITS = 1 << 21


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their offsets, and each one's place in ``data``."""
    x = C.lower(data)
    space = (x < 128) & ~(((x >= 97) & (x <= 122)) | ((x >= 48) & (x <= 57)))
    x = np.where(space, np.uint8(32), x)
    first = np.zeros(len(x) + 1, bool)
    first[offsets] = True
    keep = ~space | ~np.concatenate([[True], space[:-1]])[: len(x)] & ~first[:-1] if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    return x[at], np.concatenate([[0], np.cumsum(keep)])[offsets], at


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams (8 to 16 bytes) at each place of ``x``."""
    if len(x) < q:
        return np.zeros(0, U)
    eight = C.words8(x)
    return C.mix(eight[: len(x) - q + 1] * U(0x9E3779B97F4A7C15) + eight[q - 8 :][: len(x) - q + 1])


def fold_item(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    x = folded(raw, np.array([0, len(raw)]))[0]
    x = x[1:] if len(x) and x[0] == 32 else x
    return x[:-1] if len(x) and x[-1] == 32 else x


class Index:
    """Items by q-gram; small enough for a task by ``PART``."""

    def __init__(self, items: list[tuple[int, np.ndarray]], share: float, q: int):
        self.q = q
        self.ids, self.text = [i for i, _ in items], [x for _, x in items]
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.budget = (share * self.size).astype(np.int64)
        self.need = self.size + 1 - q - q * self.budget
        of = [grams(x, q) for x in self.text]
        gram = np.concatenate(of) if of else np.zeros(0, U)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat(np.arange(len(of)), [len(g) for g in of])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in of])[order] if of else order
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.gram >> U(44)).astype(np.int64)] = True

    def bands(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, band) of the bands in which a text and an item share as many q-grams as the lemma asks."""
        g = grams(x, self.q)
        at = np.flatnonzero(self.filter[(g >> U(44)).astype(np.int64)])
        low, high = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        doc = np.searchsorted(offsets, at, "right") - 1
        ok = at + self.q <= offsets[doc + 1]
        at, low, n, doc = at[ok], low[ok], n[ok], doc[ok]
        wide, total = 2 * (self.budget + 1), np.cumsum(n)
        held: list[np.ndarray] = []
        count: list[np.ndarray] = []
        s = 0
        while s < len(at):  # as many at once as ``HITS`` allows; the counts of all are put together
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + HITS, "right")))
            m = n[s:e]
            k = np.repeat(low[s:e] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            item, d = self.item[k], np.repeat(doc[s:e], m)
            diagonal = np.repeat(at[s:e] - offsets[doc[s:e]], m) - self.place[k]
            w = wide[item]
            rows = np.concatenate([np.stack([d, item, ((diagonal + half * w // 2) // w) * 2 + half], 1) for half in (0, 1)])
            key, c = np.unique(rows, axis=0, return_counts=True)
            held.append(key)
            count.append(c)
            s = e
        if not held:
            return (np.zeros(0, np.int64),) * 3
        key, of = np.unique(np.concatenate(held), axis=0, return_inverse=True)
        full = np.bincount(of.ravel(), np.concatenate(count)) >= self.need[key[:, 1]]
        return key[full, 0], key[full, 1], key[full, 2]


class Search:
    """The items of a part of the benchmark: long ones by q-grams, short ones by what they fold to."""

    def __init__(self, items: list[tuple[int, str]], share: float, inside: bool):
        self.inside, self.short = inside, {}
        by: dict[int, list] = {}
        for i, text in items:
            x = fold_item(text)
            if 0 < len(x) < Q:
                self.short.setdefault(x.tobytes(), []).append(i)
            elif len(x):
                by.setdefault(min(Q, len(x) // (int(share * len(x)) + 1)), []).append((i, x))
        if by and min(by) < 8:
            raise ValueError("share is too large for q-grams of 8 bytes")
        self.indexes = [Index(v, share, q) for q, v in sorted(by.items())]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first byte, end byte, edits) of the best match of each item in each text."""
        x, cut, origin = folded(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for index in self.indexes:
            for d, i, b in zip(*(v.tolist() for v in index.bands(x, cut)), strict=True):
                budget = int(index.budget[i])
                w = 2 * (budget + 1)
                low = (b // 2) * w - (b % 2) * w // 2
                got = align(index.text[i], x[cut[d] : cut[d + 1]], low, low + w, budget)
                key = (d, int(index.ids[i]))
                if got and (key not in best or (got[2], got[0]) < (best[key][2], best[key][0])):
                    best[key] = got
        for d in range(len(cut) - 1) if self.short else []:
            self.short_matches(x[cut[d] : cut[d + 1]].tobytes(), d, best)
        return [(d, i, int(origin[cut[d] + a] - offsets[d]), int(origin[cut[d] + b - 1] + 1 - offsets[d]), e) for (d, i), (a, b, e) in sorted(best.items()) if b > a]

    def short_matches(self, text: bytes, d: int, best: dict) -> None:
        """Short items in a folded text: as the whole of it, or with ``inside`` as runs of whole words."""
        if not self.inside:
            a = 1 if text[:1] == b" " else 0
            for i in self.short.get(text.strip(b" "), ()):
                best[d, i] = (a, a + len(text.strip(b" ")), 0)
            return
        start = [0, *(m + 1 for m, c in enumerate(text) if c == 32)]
        end = [*(m for m, c in enumerate(text) if c == 32), len(text)]
        for k, a in enumerate(start):
            for j in range(k, len(end)):
                if end[j] - a >= Q:
                    break
                for i in self.short.get(text[a : end[j]], ()) if end[j] > a else ():
                    best.setdefault((d, i), (a, end[j], 0))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best match (start, end, edits) of the whole item in ``text`` on diagonals low - budget .. high + budget, if within the budget."""
    m, n = len(item), len(text)
    low, width = low - budget, high - low + 2 * budget + 1
    far = budget + m + 1
    column = np.arange(width)
    place = low + column  # text place of cell c in row 0
    cost = np.where((place >= 0) & (place <= n), 0, far)
    origin = place.copy()
    padded = np.concatenate([np.full(width + m + 1, 256, np.int16), text.astype(np.int16), np.full(width + m + 1, 256, np.int16)])
    for r in range(1, m + 1):
        place = low + r + column
        begin = low + r - 1 + width + m + 1
        begin = min(max(begin, 0), len(padded) - width)
        letter = padded[begin : begin + width]
        stay = cost + (letter != item[r - 1])
        up = np.append(cost[1:], far) + 1
        from_up = np.append(origin[1:], 0)
        take = up < stay
        cost, origin = np.where(take, up, stay), np.where(take, from_up, origin)
        cost = np.where((place >= 0) & (place <= n), cost, far)
        slant = (cost - column) * width + column
        best = np.minimum.accumulate(slant)
        source = best % width
        cost, origin = best // width + column, origin[source]
    c = int(np.argmin(cost))
    return (int(origin[c]), int(low + m + c), int(cost[c])) if cost[c] <= budget else None


class Part(list):
    """Items (item_id, text) of one part, and the number of parts."""

    of = 1


def parts(items: DataFrame) -> Iterator[Part]:
    """The benchmark in parts of about ``PART`` / 2 bytes (or one item), one after the other."""
    rows = items.where(F.col("item_id").isNotNull() & (F.octet_length("text") > 0)).select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / PART * 2))
    for k in range(n):
        part = Part(sorted((r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()))  # PART bytes
        part.of = n
        yield part


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, inside: bool = False) -> DataFrame:
    """(doc_id, item_id, first_byte, end_byte, edits): each document that holds an item within its edit budget."""
    steps = C.Steps(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, first_byte long, end_byte long, edits int"
    out = None
    for k, part in enumerate(parts(items)):
        found = docs.select("doc_id", "text").mapInArrow(_finder(part, share, inside), schema)
        if out is None and k + 1 == part.of:
            return found
        found = steps.keep(found, f"leaks{k}")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(part, share, inside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(part, share, inside)
        for b in C.slices(batches, "text"):
            got = search.matches(*C.utf8(b.column("text")))
            column = lambda k, kind: pa.array([x[k] for x in got], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(column(0, pa.int64())), *(column(k, pa.int64()) for k in (1, 2, 3)), column(4, pa.int32())], names=["doc_id", "item_id", "first_byte", "end_byte", "edits"])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, share: float = SHARE, inside: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    steps = C.Steps(docs.sparkSession)
    out = docs
    for k, part in enumerate(parts(items)):
        out = out.mapInArrow(_keeper(part, share, inside), docs.schema)
        if k + 1 < part.of:
            out = steps(out, "clean")
    return out


def _keeper(part, share, inside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(part, share, inside)
        for b in C.slices(batches, "text"):
            keep = np.ones(b.num_rows, bool)
            keep[[x[0] for x in search.matches(*C.utf8(b.column("text")))]] = False
            yield b.filter(pa.array(keep))

    return run
