"""SimHash near-dedup by bit-sliced comparison.

A document's fingerprint has 64 bits: bit b is 1 if more than half of its shingles' XXH64 values have it. Equal
fingerprints are one class from the start. Two fingerprints that differ in at most two of 64 bits agree in at least two of
four runs of 16 bits, so each goes to six buckets, one for each pair of runs, and is compared within those only.

A task turns the fingerprints of many buckets into bit planes: plane b holds bit b of 64 fingerprints in one word. Lane i is
compared with lane i + s of its bucket for s = 1, 2, ..; a plane XOR itself, shifted by s, gives 64 differences in one
operation, and carry-save counters (ones, twos, and more) add them up. Blocks of ``BLOCK`` lanes, all of whose distances have
exceeded the radius, are abandoned before the next planes. Buckets lie by falling size, so the lanes still to be
compared are always the first ones.

Buckets of more than ``LIMIT`` fingerprints, which near copies of one text in great number may fill, are not compared: each
of their fingerprints meets its 64 neighbours at one bit's distance and itself, and all that share one of these 65 values are
linked to the least of them. Two fingerprints share such a value exactly if they differ in at most two bits, so the result is
the same, in 65 rows a fingerprint however many there are. A task hands on a spanning forest of the links that it finds.

Odd rows: null, empty and blank texts have the fingerprint zero and link like any other; a text with fewer words than a
shingle is one shingle; rows that share a doc_id or a text are judged each by its text; a null doc_id counts as larger
than every number (a component without any other has none); an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

U = np.uint64
#: The primes of XXH64 and the seed.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
#: Shingles of more bytes are hashed one by one; shingles hashed at once.
LONG, PIECE = 256, 1 << 16
RUN, RUNS, RADIUS = 16, 4, 2
#: Fingerprints of a bucket that are compared with each other; fingerprints in the planes at once; words of a block of lanes.
LIMIT, CHUNK, BLOCK = 4096, 1 << 16, 64


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 with ``SEED`` of each run of bytes."""
    size = (end - start).astype(np.int64)
    lanes = np.zeros(len(data) + 8, np.uint8)
    lanes[: len(data)] = data
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(lanes, (len(data) + 1, 8), (1, 1))).view("<u8").ravel()
    with np.errstate(over="ignore"):
        seed = U(SEED)
        acc = np.full(len(size), seed + P5, U)
        at = start.copy()
        long = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(long):
            v = [np.full(len(long), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(long))
            while len(live):
                p = at[long[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], eight[p + 8 * k])
                at[long[live]] += 32
                live = live[end[long[live]] - at[long[live]] >= 32]
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for k in range(4):
                x = (x ^ _round(U(0), v[k])) * P1 + P4
            acc[long] = x
        acc += size.astype(U)
        live = np.flatnonzero((end - at >= 8) & (size <= LONG))
        while len(live):
            acc[live] = _turn(acc[live] ^ _round(U(0), eight[at[live]]), 27) * P1 + P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero((end - at >= 4) & (size <= LONG))
        acc[live] = _turn(acc[live] ^ (eight[at[live]] & U(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero((end > at) & (size <= LONG))
        while len(live):
            acc[live] = _turn(acc[live] ^ (eight[at[live]] & U(0xFF)) * P5, 11) * P1
            at[live] += 1
            live = live[end[live] > at[live]]
        acc ^= acc >> U(33)
        acc *= P2
        acc ^= acc >> U(29)
        acc *= P3
        acc ^= acc >> U(32)
    for i in np.flatnonzero(size > LONG):
        acc[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), SEED)
    return acc


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """The fingerprint of each text's shingles of ``n`` words."""
    texts = len(offsets) - 1
    start, end, doc = C.word_spans(data, offsets)
    out = np.zeros(texts, U)
    if not len(start):
        return out
    # the words of all texts on end, each followed by one space
    size = end - start
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, np.uint8)
    solid = np.repeat(start - to[:-1], size + 1) + np.arange(to[-1])
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    joined[inside] = C.lower(data[solid[inside]])
    words = np.bincount(doc, minlength=texts)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    many = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    owner = np.repeat(np.arange(texts), many)
    lead = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    last = np.minimum(lead + n, first[owner] + words[owner]) - 1
    ones = np.zeros((texts, 64), np.int64)
    for i in range(0, len(owner), PIECE):
        a, z, who = lead[i : i + PIECE], last[i : i + PIECE], owner[i : i + PIECE]
        low = to[a[0]]
        h = xxh64(joined[low : to[z[-1] + 1]], to[a] - low, to[z + 1] - 1 - low)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    set_ = (2 * ones > many[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel().astype(U)


def with_fingerprint(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(*C.utf8(b.column("text")), n).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 of plane b; a spare word of zeros follows."""
    words = len(fps) // 64 + 2
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def shifted(planes: np.ndarray, by: int, words: int) -> np.ndarray:
    """Lane i becomes what lane i + by is, for the first ``words`` words."""
    whole, part = divmod(by, 64)
    take = lambda k: np.pad(planes[:, k : k + words], ((0, 0), (0, max(0, words - max(0, planes.shape[1] - k)))))
    low = take(whole)
    return low if not part else (low >> U(part)) | (take(whole + 1) << U(64 - part))


def near(planes: np.ndarray, by: int, lanes: int, radius: int = RADIUS) -> np.ndarray:
    """Of the first ``lanes`` lanes those that differ from the lane ``by`` further in at most two bits."""
    words = (lanes + 63) // 64
    found = []
    for at in range(0, words, BLOCK):
        wide = min(BLOCK, words - at)
        mine = planes[:, at : at + wide]
        other = shifted(planes[:, at:], by, wide)
        ones, twos = np.zeros(wide, U), np.zeros(wide, U)
        more = np.packbits(np.arange(at * 64, (at + wide) * 64) >= lanes, bitorder="little").view("<u8").copy()  # lanes that do not count
        for b in range(64):
            differ = mine[b] ^ other[b]
            carry = ones & differ
            ones ^= differ
            more |= twos & carry
            twos ^= carry
            if b % 8 == 7 and (more | (ones & twos)).min() == U(0xFFFFFFFFFFFFFFFF):
                break
        else:
            close = ~(more | (ones & twos))
            found.append(np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")) + at * 64)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: each end of ``x`` - ``y`` with the least value that it is linked to over any of them."""
    nodes, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = both[: len(x)], both[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def compared(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (sorted, so equal ones stand together)."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.diff(edge)
    keep = np.argsort(-size, kind="stable")
    keep = keep[size[keep] > 1]
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = size[keep]
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.arange(begin[-1]) - np.repeat(begin[:-1] - edge[keep], size)
    lined, mine = fps[order], np.repeat(np.arange(len(size)), size)
    planes = planes_of(lined.view(U))
    x, y = [], []
    for by in range(1, int(size[0])):
        lanes = int(begin[np.searchsorted(-size, -by, "left")]) - by  # buckets of more than ``by``
        hit = near(planes, by, lanes)
        hit = hit[mine[hit] == mine[hit + by]]
        x.append(lined[hit])
        y.append(lined[hit + by])
    return forest(np.concatenate(x), np.concatenate(y))


def buckets(fps: DataFrame) -> DataFrame:
    """fp and bucket: a name for each pair of runs of bits with what they hold."""
    names = []
    for k, runs in enumerate(combinations(range(RUNS), RUNS - RADIUS)):
        held = [F.shiftrightunsigned("fp", RUN * r).bitwiseAND(F.lit((1 << RUN) - 1)) for r in runs]
        value = held[0]
        for h in held[1:]:
            value = F.shiftleft(value, RUN).bitwiseOR(h)
        names.append(value.bitwiseOR(F.lit(k << (RUN * (RUNS - RADIUS)))))
    return fps.select("fp", F.explode(F.array(*names)).alias("bucket"))


def links(fps: DataFrame, steps: C.Steps, limit: int = LIMIT) -> DataFrame:
    """x and y: a forest of the pairs of distinct ``fps`` that differ in at most two bits."""
    dealt = buckets(fps).withColumn("deal", F.pmod(F.xxhash64("fp"), F.lit(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int"))
    full = dealt.groupBy("bucket").count().where(F.col("count") > limit).select("bucket", F.lit(True).alias("full"))
    places = dealt.select("bucket", "deal").distinct().join(full, "bucket")
    marked = steps(dealt.join(places, ["bucket", "deal"], "left").select("bucket", "fp", F.coalesce("full", F.lit(False)).alias("full")), "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = f = np.zeros(0, np.int64)
        for batch in batches:
            b, f = np.concatenate([b, batch.column("bucket").to_numpy()]), np.concatenate([f, batch.column("fp").to_numpy()])
            if len(b) >= CHUNK and b[0] != b[-1]:
                cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in compared(b[:cut], f[:cut])], names=["x", "y"])
                b, f = b[cut:], f[cut:]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in compared(b, f)], names=["x", "y"])

    near_ = marked.where("not full").select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "x long, y long")
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    hubs = marked.where("full").select("fp").distinct().select("fp", F.explode(around).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    hub_links = hubs.join(least, "hub").where("fp <> low").select(F.col("fp").alias("x"), F.col("low").alias("y"))
    return steps(near_.unionByName(hub_links), "links")


def groups(spark: SparkSession, docs: DataFrame, n: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links lead to."""
    with C.Steps(spark) as steps:
        known = steps(with_fingerprint(docs, n), "fingerprints")
        classes = steps(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        label = components(links(classes.select("fp"), steps, limit), steps)
        own = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        low = own.groupBy("component").agg(F.min("least").alias("component_id"))
        named = steps(C.dealt_join(own.select("fp", "component"), low, "component", "fp").select("fp", "component_id"), "named")
        got = C.dealt_join(known.withColumn("_row", F.monotonically_increasing_id()), named, "fp", "_row")
        return steps.keep(got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "simhash")
