"""Documents in blocks, and the packed exchanges that find what occurs in more than one place.

A block is one row with the texts of the documents whose key falls into it (about ``BLOCK_BYTES``).
Blocks are written once as a bucketed table in the shared folder of spark.checkpoint.dir, so later joins on the
block number shuffle only what is exchanged, never the texts. Operators drop it when their result is written, or failed.

Anchors: in each window of W symbols (bytes, or words) the run of K symbols with the least hash is the
window's anchor. Equal windows have equal anchors at equal places, so a window can only repeat if its
anchor does. That thins the search to a few anchors in a hundred symbols and loses nothing.

Exchange: each block sends every distinct key once, packed by key range (``bucket``); the answer to a
block is a code for each key it sent, in the same order. A key that a third of all documents hold still
reaches its bucket once from a block at most.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
BLOCK_BYTES = 4 << 20
BLOCK = "block int, bucket_rows int, ids binary, sizes binary, text binary, first binary, ahead binary, own binary, rest binary"
#: Blocks of one file and task, as long as the table has no more files than ``FILES``.
PER_FILE, FILES = 4, 50_000
#: With so many occurrences an anchor is hot: what it stands for is then dealt out by a finer key.
HOT = 16_000


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of the least (the leftmost of equal ones)."""
    out, step = [], 1 << 19
    for s in range(0, len(h) - width + 1, step):
        x = h[s : s + step + width - 1]
        x = (x & ~U((1 << 20) - 1)) | np.arange(len(x), dtype=U)
        span, cur, n = 1, x, len(x)
        while span * 2 <= width:
            cur = np.minimum(cur[: n - 2 * span + 1], cur[span : n - span + 1])
            span *= 2
        m = n - width + 1
        low = np.minimum(cur[:m], cur[width - span : width - span + m]) & U((1 << 20) - 1)
        out.append(low.astype(np.int64) + s)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def owners(h: np.ndarray, inside: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as (first window, anchor minus that, windows owned); ``inside`` marks whole windows."""
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 3
    at = minimizers(h, width)
    p = np.flatnonzero(inside[: len(at)])
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    a = at[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    start = np.flatnonzero(new)
    return p[start], a[start] - p[start], np.diff(np.append(start, len(p)))


def spread(h: np.ndarray) -> np.ndarray:
    """Anchors are the least hashes of their windows, so all small; mixed anew they fall evenly into ranges."""
    return C.mix(h + U(0x9E3779B97F4A7C15))


def inside(offsets: np.ndarray, window: int, total: int) -> np.ndarray:
    """Which places begin a window that ends in the same text."""
    out = np.zeros(total, bool)
    size = np.diff(offsets)
    mark = np.zeros(total + 1, np.int32)
    ok = size >= window
    np.add.at(mark, offsets[:-1][ok], 1)
    np.add.at(mark, offsets[1:][ok] - window + 1, -1)
    out[:] = np.cumsum(mark[:total]) > 0
    return out


class Block:
    """A row of the block table, unpacked."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))]).astype(np.int64)
        self.text = np.frombuffer(row["text"], np.uint8)
        self.first = np.cumsum(np.frombuffer(row["first"], np.uint32).astype(np.int64))
        self.anchor = self.first + np.frombuffer(row["ahead"], np.uint8)
        self.own = np.frombuffer(row["own"], np.uint8).astype(np.int64)
        self.rest = row["rest"]


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def build(spark: SparkSession, docs: DataFrame, anchors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], rest: list[str]) -> tuple[DataFrame, int, str]:
    """The block table, the number of blocks and the table's name, for ``discard``; ``rest`` columns ride along unread."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    files = min(FILES, max(1, math.ceil(n / PER_FILE)))
    rest = {f"rest{k}": name for k, name in enumerate(rest)}  # under names of their own, so that none can clash
    picked = docs.select("doc_id", "text", *(F.col(f"`{name}`").alias(k) for k, name in rest.items())).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    schema = pa.schema([("block", pa.int32()), ("bucket_rows", pa.int32()), *((x, pa.binary()) for x in ("ids", "sizes", "text", "first", "ahead", "own", "rest"))])

    def pack(t: pa.Table) -> pa.Table:
        key = t.column("block")[0].as_py()
        t = t.drop_columns(["block"])
        order = np.argsort(C.ids(t.column("doc_id")), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        data, offsets = C.utf8(t.column("text"))
        first, ahead, own = anchors(data, offsets)
        tail = b""
        if rest:
            sink = pa.BufferOutputStream()
            extra = t.select(["doc_id", "text", *rest]).set_column(1, "text", pa.array([x is None for x in t.column("text").to_pylist()])) if "text" in t.column_names else t
            with pa.ipc.new_stream(sink, extra.schema) as w:
                w.write_table(extra)
            tail = sink.getvalue().to_pybytes()
        row = {
            "block": [key], "bucket_rows": [len(order)], "ids": [C.raw(C.ids(t.column("doc_id")), "<i8")], "sizes": [C.raw(np.diff(offsets), "<i8")], "text": [data.tobytes()],
            "first": [C.raw(np.diff(first, prepend=0), "<u4")], "ahead": [C.raw(ahead, "u1")], "own": [C.raw(own, "u1")], "rest": [tail],
        }
        return pa.table(row, schema=schema)

    name = f"blocks_{uuid.uuid4().hex[:16]}"
    packed = picked.repartition(files, "block").groupBy("block").applyInArrow(pack, BLOCK)
    try:
        with C.step(spark):
            packed.write.bucketBy(files, "block").option("compression", "zstd").option("path", C.shared(spark, name)).format("parquet").saveAsTable(name)
    except Exception:
        discard(spark, name)
        raise
    return spark.table(name), n, name


def discard(spark: SparkSession, name: str) -> None:
    """Drops a block table and its files, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    C.delete(spark, C.shared(spark, name))


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Ranges of equal width: sorted keys come in the order of their buckets."""
    return ((key >> U(32)) * U(n)) >> U(32)


def cuts(key: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    if not len(key):
        return []
    b = bucket_of(key, n)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(at, np.append(at[1:], len(b)), strict=True)]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index of each input among them, and how often each occurs."""
    return np.unique(h, return_inverse=True, return_counts=True)


def repeated_anchors(blocks: DataFrame, n: int, keys: Callable[[Block], tuple[np.ndarray, np.ndarray]], within_text: bool) -> DataFrame:
    """(block, bucket, codes): for each distinct anchor of a block 0 if it occurs nowhere else, 1 if it does, 2 if it is hot.

    ``keys`` gives each anchor's hash and text. An anchor twice in one text counts as repeated only if ``within_text``.
    """

    hot = HOT

    def ask(batches):
        for b in blocks_in(batches):
            h, doc = keys(b)
            u, inv, many = distinct(h)
            if not within_text:
                low, high = np.full(len(u), len(b.ids)), np.full(len(u), -1)
                np.minimum.at(low, inv, doc)
                np.maximum.at(high, inv, doc)
                many = np.where(low < high, many, 1)
            rows = cuts(u, n)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in rows], pa.int32()), "block": pa.array([b.block] * len(rows), pa.int32()), "keys": pa.array([C.raw(u[i:j], "<u8") for _, i, j in rows], pa.binary()), "many": pa.array([C.raw(np.minimum(many[i:j], 65535), "<u2") for _, i, j in rows], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        keys_of = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("keys")]
        h = np.concatenate(keys_of)
        many = np.frombuffer(b"".join(x.as_py() for x in t.column("many")), np.uint16)
        order = np.argsort(h, kind="stable")
        s = h[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(start, len(s)))
        total = np.add.reduceat(many[order].astype(np.int64), start)
        code = np.where(total >= hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        out = np.empty(len(h), np.uint8)
        out[order] = np.repeat(code, count)
        at = np.cumsum([0, *map(len, keys_of)])
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "codes": pa.array([out[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())})

    asked = blocks.mapInArrow(ask, "bucket int, block int, keys binary, many binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, codes binary")


def codes_in(t: pa.Table, kind: int | None = None) -> np.ndarray:
    """A block's answers on end, in the order in which it asked."""
    rows = t.select(["bucket", "codes"] if kind is None else ["bucket", "codes", "kind"]).to_pylist()
    rows = sorted((x for x in rows if kind is None or x["kind"] == kind), key=lambda x: x["bucket"])
    return np.frombuffer(b"".join(x["codes"] for x in rows), np.uint8)
