"""Suffix-array dedup: bytes covered by a string of ``WINDOW`` bytes that also starts in an earlier document.

1. Documents become blocks; anchors that occur in one document only are set aside (``blocks.py``).
2. For each other anchor a block sends the bytes of the windows that the anchor owns, once for equal ones,
   with the least doc_id that has them. Anchors in ``blocks.HOT`` or more documents send each window by itself,
   dealt by the window's own hash, so that no anchor is a hot key.
3. Each bucket concatenates the distinct contexts it got and builds a suffix array by two-stage sorting: suffixes smaller
   than their successor are sorted directly, the others are induced by one scan over the first-byte buckets. Common
   prefixes of neighbours then give the classes of equal windows, and a bit per window goes back: does a smaller
   doc_id than the sender's least have it?
4. Each block marks what is covered.

Results for odd rows: a null or empty text has no bytes and keeps none; texts shorter than the window lose nothing;
rows with the same doc_id do not remove each other's bytes; a null doc_id counts as larger than every number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C

U = np.uint64
K = 16
#: Buckets of contexts for each block: a suffix array is built over a bucket, so its memory is that of one.
SPREAD = 12


def gram_hash(eight: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at each place; the last eight places have none."""
    return C.mix(eight[:-8] * U(0x9E3779B97F4A7C15) + eight[8:])


def anchor_hash(b: B.Block) -> np.ndarray:
    """The same hash at a block's anchors only, so that long texts need no more memory than their anchors."""
    out = np.zeros(len(b.anchor), U)
    padded = np.concatenate([b.text, np.zeros(K, np.uint8)])
    for s in range(0, len(out), 1 << 16):
        at = b.anchor[s : s + (1 << 16)]
        out[s : s + len(at)] = gram_hash_of(padded[at[:, None] + np.arange(K)])
    return B.spread(out)


def gram_hash_of(rows: np.ndarray) -> np.ndarray:
    two = rows.view(">u8").astype(U)
    return C.mix(two[:, 0] * U(0x9E3779B97F4A7C15) + two[:, 1])


def byte_anchors(window: int):
    def find(data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        if n < window:
            return (np.zeros(0, np.int64),) * 3
        whole, out = B.inside(offsets, window, n), []
        step = 1 << 19
        for s in range(0, n - window + 1, step):  # pieces keep memory low
            piece = data[s : s + step + window - 1]
            h = gram_hash(C.words8(piece))[: len(piece) - K + 1]
            out.append(B.minimizers(h, window - K + 1) + s)
        at = np.concatenate(out)
        p = np.flatnonzero(whole[: len(at)])
        if not len(p):
            return (np.zeros(0, np.int64),) * 3
        a = at[p]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        return p[start], a[start] - p[start], np.diff(np.append(start, len(p)))

    return find


# ---- two-stage suffix sorting -------------------------------------------------------------------


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one that starts a byte later; ``text`` ends with zeros."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1)).astype(np.int8)
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def sort_directly(p: np.ndarray, eight: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``p`` by their first ``depth`` bytes; ``whole`` is a hash of those, which ends the search among equal ones."""
    p = p[np.argsort(eight[p])]
    key = eight[p]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    done = 8
    where, group = np.arange(len(p)), np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    while done < depth and len(where):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        h = whole[p[where]]
        open_ = np.repeat((size > 1) & (np.minimum.reduceat(h, start) != np.maximum.reduceat(h, start)), size)
        where, group = where[open_], group[open_]
        if not len(where):
            break
        key = eight[np.minimum(p[where] + done, len(eight) - 1)]
        if depth - done < 8:
            key = key >> U(8 * (8 - (depth - done)))
        order = np.lexsort((key, group))
        p[where] = p[where][order]
        key = key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.maximum.accumulate(np.where(new, where, 0))
        done += 8
    return p


def suffix_array(text: np.ndarray, eight: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``wanted`` (a mask) in the order of their suffixes, compared over ``depth`` bytes at least.

    ``text`` must end with ``depth`` zeros; ``eight`` has its words of eight bytes. Two stages: suffixes that are smaller than their successor are sorted
    directly; any other suffix takes its place when the scan, bucket by bucket, reaches its successor.
    """
    up = smaller_than_next(text)
    need = wanted.copy()
    edge = need & ~up
    while edge.any():  # a suffix that is induced needs its successor, down to one that is sorted directly
        after = np.zeros_like(need)
        after[1:] = edge[:-1]
        after &= ~need
        need |= after
        edge = after & ~up
    direct = sort_directly(np.flatnonzero(need & up), eight, window_hash(eight, depth), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced = need & ~up
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = np.flatnonzero(induced & (np.arange(len(text)) == len(text) - 1))
    if len(last):
        pending[text[-1]].append(last)
    out = []
    for c in range(256):
        queue, scanned = pending[c], []
        while queue:  # grows while it is scanned: runs of the same byte
            part = np.concatenate(queue)
            scanned.append(part)
            before = part[part > 0] - 1
            before = before[induced[before] & (text[before] == c)]
            queue = [before] if len(before) else []
        scanned.append(direct[bounds[c] : bounds[c + 1]])
        here = np.concatenate(scanned)
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[induced[before]]
        byte = text[before]
        keep = byte > c
        before, byte = before[keep], byte[keep]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        if not len(byte):
            continue
        start = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        for i, j in zip(start, [*start[1:], len(byte)], strict=True):
            pending[byte[i]].append(before[i:j])
    got = np.concatenate(out) if out else np.zeros(0, np.int64)
    return got[wanted[got]]


def window_hash(eight: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` bytes from each place on."""
    h = eight.copy()
    for j in range(8, depth, 8):
        nxt = np.zeros_like(h)
        nxt[:-j] = eight[j:]
        if depth - j < 8:
            nxt >>= U(8 * (8 - (depth - j)))
        h = C.mix(h * U(0x9E3779B97F4A7C15) + nxt)
    return h


def common_prefixes(order: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``depth``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b, open_ = order[:-1], order[1:], np.arange(len(order) - 1)
    for j in range(0, depth, 8):
        x = eight[np.minimum(a[open_] + j, len(eight) - 1)] ^ eight[np.minimum(b[open_] + j, len(eight) - 1)]
        same = x == 0
        out[open_[same] + 1] += 8
        odd = open_[~same]
        high = np.frexp((x[~same] >> U(11)).astype(np.float64) + (x[~same] & U(0x7FF)).astype(np.float64) / 2048)[1] + 11
        out[odd + 1] += (64 - np.clip(high, 1, 64)) // 8
        open_ = open_[same]
    return np.minimum(out, depth)


# ---- exchange of windows ------------------------------------------------------------------------


class Records:
    """What a block sends: distinct contexts of repeated anchors, sorted by the key that deals them out."""

    def __init__(self, b: B.Block, codes: np.ndarray, window: int):
        h = anchor_hash(b)
        _, inv, _ = B.distinct(h)
        code = codes[inv] if len(inv) else np.zeros(0, np.uint8)
        one, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        start = np.concatenate([b.first[one], np.repeat(b.first[hot], b.own[hot]) + run(b.own[hot])])
        own = np.concatenate([b.own[one], np.ones(int(b.own[hot].sum()), np.int64)])
        doc = b.ids[np.searchsorted(b.offsets, start, "right") - 1]
        wide = window + int(own.max(initial=1)) - 1
        wide += -wide % 8
        padded = np.concatenate([b.text, np.zeros(wide, np.uint8)])
        content = np.zeros(len(start), U)
        for s in range(0, len(start), 1 << 14):
            part = slice(s, s + (1 << 14))
            m = padded[start[part, None] + np.arange(wide)]
            m[np.arange(wide) >= (own[part, None] + window - 1)] = 0
            w = m.view(U)
            x = C.mix(own[part].astype(U) + U(0x51ED270B))
            for j in range(w.shape[1]):
                x = C.mix(x * U(0x9E3779B97F4A7C15) + w[:, j])
            content[part] = x
        key = np.concatenate([h[one], content[len(one) :]])
        u, at, inv = np.unique(content, return_index=True, return_inverse=True)
        least = np.full(len(u), C.NULL_ID, np.int64)
        np.minimum.at(least, inv, doc)
        order = np.lexsort((u, key[at]))
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        self.key, self.content, self.start, self.own, self.least = key[at][order], u[order], start[at][order], own[at][order], least[order]
        self.all_start, self.all_own, self.all_doc, self.all_record = start, own, doc, place[inv]
        self.window, self.padded = window, padded

    def text(self, i: int, j: int) -> bytes:
        size = self.own[i:j] + self.window - 1
        return self.padded[np.repeat(self.start[i:j], size) + run(size)].tobytes()


def run(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, on end."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def earlier(t: pa.Table, window: int) -> pa.Table:
    """For one bucket: a bit for each window, set if a smaller doc_id than the sender's least has it.

    A context that several blocks sent stands once in the suffix array, with the least doc_id of all its senders.
    """
    get = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]
    own_of = get("own", np.uint8)
    own = np.concatenate(own_of).astype(np.int64)
    least, content = np.concatenate(get("least", np.int64)), np.concatenate(get("content", np.uint64))
    _, once, of = np.unique(content, return_index=True, return_inverse=True)
    lowest = np.full(len(once), C.NULL_ID, np.int64)
    np.minimum.at(lowest, of, least)
    size = own + window - 1
    at, own_once, size_once = np.cumsum(size) - size, own[once], size[once]
    text = np.concatenate(get("text", np.uint8))[np.repeat(at[once], size_once) + run(size_once)]
    text = np.concatenate([text, np.zeros(window + 8, np.uint8)])
    at = np.cumsum(size_once) - size_once
    mine = np.repeat(at, own_once) + run(own_once)
    wanted = np.zeros(len(text), bool)
    wanted[mine] = True
    eight = C.words8(text)
    order = suffix_array(text, eight, wanted, window)
    start = np.flatnonzero(common_prefixes(order, eight, window) < window)
    del eight, wanted
    doc = np.zeros(len(text), np.int64)
    doc[mine] = np.repeat(lowest, own_once)
    doc[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.append(start, len(order))))
    low, first = doc[mine], np.cumsum(own_once) - own_once
    out, seen = [], 0
    for x in own_of:
        mine, seen = slice(seen, seen + len(x)), seen + len(x)
        window_of = np.repeat(first[of[mine]], own[mine]) + run(own[mine])
        out.append((low[window_of] < np.repeat(least[mine], own[mine])).tobytes())
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "codes": pa.array(out, pa.binary()), "kind": pa.array([3] * t.num_rows, pa.int32())})


def covered(b: B.Block, left: pa.Table, window: int) -> np.ndarray:
    """Which bytes of a block go."""
    r = Records(b, B.codes_in(left, 1), window)
    bit = B.codes_in(left, 3)
    at = np.cumsum(r.own) - r.own
    gone = np.zeros(len(b.text), bool)  # where a window begins that goes
    for s in range(0, len(r.all_start), 1 << 14):
        part = slice(s, s + (1 << 14))
        own, record = r.all_own[part], r.all_record[part]
        step = run(own)
        lost = (bit[np.repeat(at[record], own) + step] > 0) | np.repeat(r.all_doc[part] > r.least[record], own)
        gone[(np.repeat(r.all_start[part], own) + step)[lost]] = True
    out = np.zeros(len(b.text), bool)
    for s in range(0, len(out), 1 << 20):  # a byte goes if a window that goes begins on it or up to window - 1 before
        before = min(s, window - 1)
        seen = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone[s - before : s + (1 << 20)], dtype=np.int32)])
        end = np.arange(before + 1, len(seen))
        out[s : s + len(end)] = seen[end] > seen[np.maximum(end - window, 0)]
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50, rest: list[str] | None = None, digests: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; without ``digests`` doc_id, text and ``rest``.

    Without digests the kept bytes are decoded; bytes of a character that was cut are dropped with it, and a
    null text stays null.
    """
    C.prepare(spark)
    rest = rest or []
    blocks, n, name = B.build(spark, docs, byte_anchors(window), rest)

    def keys(b: B.Block):
        return anchor_hash(b), np.searchsorted(b.offsets, b.first, "right") - 1

    record_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("own", "least", "content", "text"))])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = B.Block(row)
            r = Records(b, B.codes_in(right), window)
            cuts = B.cuts(r.key, n * SPREAD)
            out.append(pa.table([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([b.block] * len(cuts), pa.int32()), *(pa.array([f(i, j) for _, i, j in cuts], pa.binary()) for f in (lambda i, j: C.raw(r.own[i:j], "u1"), lambda i, j: C.raw(r.least[i:j], "<i8"), lambda i, j: C.raw(r.content[i:j], "<u8"), r.text))], schema=record_schema))
        return pa.concat_tables(out)

    kept = [docs.schema[c] for c in rest]
    types = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *rest)}

    def digest(b: B.Block, gone: np.ndarray) -> pa.Table:
        edge = np.zeros(len(gone) + 1, bool)
        edge[b.offsets] = True
        start = gone & (~np.concatenate([[False], gone[:-1]]) | edge[:-1])
        n_gone, n_span = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(start)])
        sha = [hashlib.sha256(b.text[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(b.offsets, b.offsets[1:], strict=False)]
        count = lambda x: pa.array(x[b.offsets[1:]] - x[b.offsets[:-1]], pa.int64())
        return pa.table({"doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == C.NULL_ID), "n_bytes": pa.array(np.diff(b.offsets), pa.int64()), "n_removed": count(n_gone), "n_spans": count(n_span), "kept_sha256": pa.array(sha, pa.string())})

    def texts(b: B.Block, gone: np.ndarray) -> pa.Table:
        out = [b.text[i:j][~gone[i:j]].tobytes().decode("utf-8", "ignore") for i, j in zip(b.offsets, b.offsets[1:], strict=False)]
        extra = pa.ipc.open_stream(b.rest).read_all()
        null = extra.column("text").to_pylist()
        columns = {"doc_id": extra.column("doc_id"), "text": pa.array([None if m else x for m, x in zip(null, out, strict=True)], pa.string())}
        return pa.table([*columns.values(), *(extra.column(2 + k) for k in range(len(kept)))], names=["doc_id", "text", *(f.name for f in kept)])

    wanted = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else ", ".join([f"doc_id {types['doc_id']}", "text string", *(f"`{f.name}` {types[f.name]}" for f in kept)]))
    make = digest if digests else texts

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = B.Block(row)
            out.append(make(b, covered(b, right, window)))
        return pa.concat_tables(out)

    try:
        with C.Steps(spark) as steps:
            known = steps(B.repeated_anchors(blocks, n, keys, within_text=False), "anchors")
            sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, "bucket int, block int, own binary, least binary, content binary, text binary")
            bits = steps(sent.groupBy("bucket").applyInArrow(lambda t: earlier(t, window), "block int, bucket int, codes binary, kind int"), "windows")
            answers = known.withColumn("kind", F.lit(1)).unionByName(bits)
            return steps.keep(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, wanted), "kept")
    finally:
        B.discard(spark, name)
