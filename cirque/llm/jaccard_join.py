"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with its transpose.

Rows of the incidence are the distinct sets of word n-grams (equal sets are one class from the start). The n-grams of a
class are ordered from rare to frequent, by a count sketch over all documents, then by hash. With a similarity of at
least t two sets share an n-gram among the first ``n - ceil(t n) + 1`` of each, so the product runs over those columns:

1. Each column joins its members to its pivot only: the member whose prefix columns hold most members, so the one that
   most others were made from. The pairs are verified, and links give components. This settles groups of copies in as
   many pairs as members. A star pair needs a fifth of the smaller prefix in common, which only saves work.
2. Columns that still hold several components give the pairs between different components, block by block: the members
   outside the pivot's component are cut into blocks of about ``FEW``, and each block meets all members of its column.
   Overlap counts are accumulated over the columns; pairs whose sizes or remaining places bound the overlap below what
   the threshold asks are discarded. Pairs within a component are never made. No task has more than one block of a
   column, yet a group in which many sets stay unlinked is compared in its square.

Pairs pass a parity signature, in step 2 already where a column forms them: each n-gram flips one of 512 bits, so
the bits in which two signatures differ are a lower bound of the n-grams that only one set has. What is left is verified by
intersecting whole sets. A class is known by 64 bits made from two sums over its n-grams' hashes and its
size; n-grams are 64-bit hashes themselves. Odd rows: null, empty and blank texts have no n-grams and link with nothing; a text
with fewer words than n has its whole sequence as its one n-gram; a null doc_id counts as larger than every number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C
from .components import components

U = np.uint64
SKETCH = 1 << 16
#: Members of a column outside its pivot's component that meet the others in one task.
FEW = 512
SIGNATURE = [f"s{i}" for i in range(8)]


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, on end, and offsets."""
    start, end, of = C.word_spans(data, offsets)
    count = len(offsets) - 1
    h = C.word_hashes(C.lower(data), start, end)
    words = np.bincount(of, minlength=count)
    whole = C.joined(h, n)[: max(0, len(h) - n + 1)]
    same = of[: len(whole)] == of[n - 1 :] if len(whole) else np.zeros(0, bool)
    keys, who = [whole[same]], [of[: len(whole)][same]]
    first = np.concatenate([[0], np.cumsum(words)])
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        x = np.full(len(short), k, U)
        for j in range(k):
            x = C.mix(x * U(0xD1342543DE82EF95) + h[first[short] + j])
        keys.append(x)
        who.append(short)
    keys, who = np.concatenate(keys), np.concatenate(who)
    order = np.lexsort((keys, who))
    keys, who = keys[order], who[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, who = keys[new], who[new]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(who, minlength=count))])


def names(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each set, and its size."""
    a = np.concatenate([[U(0)], np.cumsum(C.mix(keys + U(0x9E3779B97F4A7C15)), dtype=U)])
    b = np.concatenate([[U(0)], np.cumsum(C.mix(keys ^ U(0x2545F4914F6CDD1D)), dtype=U)])
    size = np.diff(offsets)
    x, y = a[offsets[1:]] - a[offsets[:-1]], b[offsets[1:]] - b[offsets[:-1]]
    return C.mix(C.mix(x + size.astype(U)) * U(0x9E3779B97F4A7C15) + y).view(np.int64), size.astype(np.int64)


def signatures(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """512 parity bits of each set, as eight numbers."""
    count = len(offsets) - 1
    at = np.repeat(np.arange(count), np.diff(offsets)) * 512 + (C.mix(keys) & U(511)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=count * 512) & 1).astype(np.uint8)).view(np.int64).reshape(count, 8)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (doc, key of its text, node, n and the signature) and, with null doc, counts of n-grams by slot of the sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.int64)
        for batch in C.slices(batches, "text"):
            keys, offsets = sets(*C.utf8(batch.column("text")), n)
            seen += np.bincount((keys >> U(48)).astype(np.int64), minlength=SKETCH)
            node, size = names(keys, offsets)
            none = pa.nulls(len(node), pa.int64())
            bits = signatures(keys, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(C.ids(batch.column("doc_id"))), batch.column("key"), pa.array(node), pa.array(size), none, none, *(pa.array(bits[:, k]) for k in range(8))], names=COLUMNS)
        at = np.flatnonzero(seen)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array(seen[at]), *[none] * 8], names=COLUMNS)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(work, ", ".join(f"{c} long" for c in COLUMNS))


COLUMNS = ["doc", "key", "node", "n", "slot", "seen", *SIGNATURE]


def ceil_share(percent: int, n):
    return (percent * n + 99) // 100


def prefixes(docs: DataFrame, n: int, percent: int, order: np.ndarray) -> DataFrame:
    """(h, node, n, i): the i-th n-gram of a set's prefix, in order of frequency."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "text"):
            keys, offsets = sets(*C.utf8(batch.column("text")), n)
            node, size = names(keys, offsets)
            who = np.repeat(np.arange(len(size)), size)
            place = np.lexsort((keys, order[(keys >> U(48)).astype(np.int64)], who))
            i = np.arange(len(keys)) - offsets[who]
            keep = i < (size - ceil_share(percent, size) + 1)[who]
            h, w, i = keys[place][keep], who[keep], i[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[w]), pa.array(size[w].astype(np.int32)), pa.array(i.astype(np.int32))], names=["h", "node", "n", "i"])

    return docs.select("doc_id", "text").mapInArrow(work, "h long, node long, n int, i int")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``pairs`` (x, y) with ``linked``: whether 100 x common >= percent x union, by whole sets.

    Texts travel to the pairs, as they are smaller than their sets; each class is known by the id and text of one document: xdoc, xkey, ydoc and ykey.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text").where("text is not null").dropDuplicates(["doc", "key"])
    text = lambda s: texts.select(F.col("doc").alias(f"{s}doc"), F.col("key").alias(f"{s}key"), F.col("text").alias(f"t{s}"))
    both = pairs.join(text("x"), ["xdoc", "xkey"]).join(text("y"), ["ydoc", "ykey"]).select("x", "y", "tx", "ty")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "tx"):
            x, at_x = sets(*C.utf8(batch.column("tx")), n)
            _, once, of = np.unique(batch.column("y").to_numpy(), return_index=True, return_inverse=True)
            y, at_y = sets(*C.utf8(batch.column("ty").take(pa.array(once))), n)
            out = []
            for i, j in enumerate(of.tolist()):
                p, q = x[at_x[i] : at_x[i + 1]], y[at_y[j] : at_y[j + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(out, pa.bool_())], names=["x", "y", "linked"])

    return both.mapInArrow(work, "x long, y long, linked boolean")


def may_link(p: str, q: str, percent: int):
    """Whether the signatures of two sets, in columns that begin with ``p`` and ``q``, allow a link."""
    apart = sum(F.bit_count(F.col(p + c).bitwiseXOR(F.col(q + c))) for c in SIGNATURE)
    return apart * (100 + percent) <= (F.col(p + "n") + F.col(q + "n")) * (100 - percent)


def in_several(rows: DataFrame, percent: int, steps: C.Steps) -> DataFrame:
    """(h, node, n, i, pivot, pivot_n) of the columns with two members at least; the pivot's columns hold most members on average."""
    ends = rows.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top").select("h")
    got = steps(rows.join(ends, "h").groupBy("h", "node").agg(F.max("n").alias("n"), F.min("i").alias("i")), "members")
    size = got.groupBy("h").agg(F.count("*").alias("size"))
    score = got.join(size, "h").groupBy("node").agg((F.sum("size") / (F.max("n") - ceil_floor(F.max("n"), percent) + 1)).alias("score"))
    pivot = got.join(score, "node").groupBy("h").agg(F.max(F.struct("score", -F.col("node"), "node", "n")).alias("p")).select("h", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    return got.join(pivot, "h")


def ceil_floor(n, percent: int):
    """The least whole number of n-grams that is ``percent`` of n."""
    return F.floor((n * percent + 99) / 100)


def several_components(shared: DataFrame, group: DataFrame, sign: DataFrame) -> DataFrame:
    """(h, node, n, i, component, main, signature) of the columns that hold several components; main is the pivot's."""
    held = shared.select("h", "node", "n", "i", "pivot").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = held.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("component"))).alias("main")).where("low <> high").select("h", "main")
    return held.join(mixed, "h").join(sign, "node").select("h", "node", "n", "i", "component", "main", *SIGNATURE)


def pairs_of(held: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components, near enough in size and signature, of members outside a column's main component with all of it."""
    rest = [c for c in held.columns if c not in ("h", "main")]
    few = held.where("component <> main")
    slots = few.groupBy("h").agg(F.ceil(F.count("*") / FEW).alias("slots"))
    few = few.join(slots, "h").select("h", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot"), *(F.col(c).alias(f"u{c}") for c in rest))
    every = held.join(slots, "h").select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "main", *(F.col(c).alias(f"v{c}") for c in rest))
    once = (F.col("vcomponent") == F.col("main")) | (F.col("unode") < F.col("vnode"))
    size_ok = F.least("un", "vn") * 100 >= F.greatest("un", "vn") * percent
    return few.join(every, ["h", "slot"]).where((F.col("ucomponent") != F.col("vcomponent")) & once & size_ok & may_link("u", "v", percent))


def joined_groups(group: DataFrame, more: DataFrame, nodes: DataFrame, steps: C.Steps) -> DataFrame:
    """``nodes`` with component when ``more`` links (x, y) join those of ``group``; only the components that it names are looked at again.

    A node that neither has is a component by itself.
    """
    of = lambda s: group.select(F.col("node").alias(s), F.col("component").alias(f"{s}c"))
    ends = more.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("xc", "x").alias("x"), F.coalesce("yc", "y").alias("y"))
    merged = components(ends, steps, "groups").select(F.col("node").alias("component"), F.col("component").alias("low"))
    first = nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return C.dealt_join(first, merged, "component", "node", "left").withColumn("component", F.coalesce("low", "component")).drop("low")


def heads(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, node, n, least, head) of each document: least is the least doc of its component, head the least class with that doc; null without n-grams."""
    with C.Steps(spark) as steps:
        seen = steps(classes(docs, n), "classes")
        order = np.zeros(SKETCH, np.int64)
        for r in seen.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).collect():  # SKETCH rows at most
            order[r["slot"]] = r["seen"]
        docs_of = seen.where("slot is null").select("doc", "node", "n")
        class_of = seen.where("slot is null and n > 0").groupBy("node").agg(F.min(F.struct("doc", "key")).alias("first"), *(F.max(c).alias(c) for c in SIGNATURE)).select("node", "first.*", *SIGNATURE)
        class_of = steps(class_of, "named")  # read by each join that follows
        rows = steps(prefixes(docs, n, percent, order), "prefixes")
        shared = steps(in_several(rows, percent, steps), "columns")
        steps.drop("prefixes", "members")
        size_ok = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
        star = shared.where("node <> pivot").where(size_ok).groupBy(F.col("node").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("common"), F.max("n").alias("xn"), F.max("pivot_n").alias("yn"))
        small = F.least("xn", "yn")
        star = star.where(F.col("common") * 5 >= small - ceil_floor(small, percent) + 1)
        sign = class_of.select("node", *SIGNATURE)
        as_side = lambda s, *more: class_of.select(*(F.col(c).alias(s if c == "node" else s + c) for c in ("node", "doc", "key", *more)))
        star = star.join(as_side("x", *SIGNATURE), "x").join(as_side("y", *SIGNATURE), "y").where(may_link("x", "y", percent))
        tried = steps(verified(star, docs, n, percent), "star")
        links = tried.where("linked").select("x", "y")
        star_group = components(links, steps, "star_groups")
        held = steps(several_components(shared, star_group, sign), "mixed")
        steps.drop("columns")
        cross = pairs_of(held, percent)
        first = F.col("unode") < F.col("vnode")
        side = lambda c, low: F.when(first == F.lit(low), F.col(f"u{c}")).otherwise(F.col(f"v{c}"))
        cross = cross.groupBy(F.least("unode", "vnode").alias("x"), F.greatest("unode", "vnode").alias("y")).agg(F.count("*").alias("common"), F.max(side("n", True)).alias("xn"), F.max(side("n", False)).alias("yn"), F.max(side("i", True)).alias("xi"), F.max(side("i", False)).alias("yi"))
        bound = F.col("common") + F.least(F.col("xn") - 1 - F.col("xi"), F.col("yn") - 1 - F.col("yi"))
        cross = cross.where(bound * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent).join(tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
        cross = cross.join(as_side("x"), "x").join(as_side("y"), "y")
        more = steps(verified(cross, docs, n, percent), "cross").where("linked").select("x", "y")
        steps.drop("mixed")
        least = steps(joined_groups(star_group, more, class_of.select("node", "doc"), steps), "least")
        of = C.dealt_join(least, least.groupBy("component").agg(F.min(F.struct("doc", "node")).alias("first")), "component", "node").select("node", F.col("first.doc").alias("least"), F.col("first.node").alias("head"))
        some = C.dealt_join(docs_of.where("n > 0"), of, "node", "doc").select("doc", "node", "n", "least", "head")
        none = F.lit(None).cast("long")
        return steps.keep(some.unionByName(docs_of.where("n = 0").select("doc", "node", "n", none.alias("least"), none.alias("head"))), "heads")


def groups(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of each document."""
    null = lambda c: F.when(F.col(c) != C.NULL_ID, F.col(c))
    return heads(spark, docs, n, percent).select(null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(null("least"), null("doc")).alias("component_id"))


def named(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the class and size of each text as _node and _n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, "text"):
            node, size = names(*sets(*C.utf8(batch.column("text")), n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(size)], names=[*batch.schema.names, "_node", "_n"])

    return docs.mapInArrow(work, StructType([*docs.schema, StructField("_node", LongType()), StructField("_n", LongType())]))


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, of its least doc_id (null is largest), then least class; rows without n-grams all stay.

    A doc_id tells what becomes of its row where it occurs once; rows that share one, or null, are told apart by class.
    """
    group = heads(spark, docs, n, percent)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("doc"))
    drop = group.where("n > 0 and doc <> least").select("doc").distinct()
    twice = group.groupBy("doc").count().where("count > 1").select("doc")
    if not twice.limit(1).count():
        return keyed.join(drop, "doc", "left_anti").select("row.*")
    single = keyed.join(twice, "doc", "left_anti").join(drop, "doc", "left_anti")
    shared = named(keyed.join(twice, "doc", "left_semi").select("row", "doc", "row.text"), n)
    first = group.where("n > 0 and doc = least and node = head").select("doc", F.col("node").alias("_node")).distinct()
    kept = shared.where("_n > 0").join(first, ["doc", "_node"], "left_semi").dropDuplicates(["doc", "_node"])
    return single.select("row.*").unionByName(kept.select("row.*")).unionByName(shared.where("_n = 0").select("row.*"))
