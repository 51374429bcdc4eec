"""Conversation prefix trie by fixed-length block hashing.

A conversation's turns are cut into blocks of ``TURNS``; a block's name is a digest of all turns up to its end, so blocks with
one name begin with the same turns. Conversations are grouped by successive block names first, which counts thousands of
equal conversations in as many map-side sums. Only blocks that have siblings, other blocks behind the same turns, are then
refined to turns: their prefixes are grouped once more. A block without siblings gives its nodes as they are.

Nothing goes level by level. Of each childless node the least member is its representative; a node has as many childless
nodes below it as representatives. A representative owns the nodes whose least representative it is, which are the end of its path.
Over the subtree of a node, the texts of all members are a sum over members, the texts of distinct nodes are what the
representatives own less what the least of them owns above; the difference is what sharing saves. All of these are sums and
minima over the same two groupings.

Within a conversation, digests follow each other in one sorted stream of 32-byte digests; a block at a time is in memory. The digest of
the ids that end at a node is such a stream, too. A conversation or an end that holds a third of all rows is one task's
stream, as one SHA-256 value or chain is one sequence; texts do not travel there.

Odd rows: null roles and texts are empty; null turns come first; rows of one turn are ordered by role, the text's first 64
characters and its MD5, repeated rows are turns of their own; rows without conv_id are left out; the remainder of a negative conv_id
is negative, as in SQL; a conversation may end up without turns and is a member of the root; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .conversations import ORDER, placed

TURNS = 4
#: The digest of no turns, conversations with a common head, turns of a head at most.
ROOT = hashlib.md5(b"").hexdigest()
FAMILY, HEAD = 100, 5
BLOCKS = "conv_id long, k long, start string, turns string, lens string, m int, ended boolean, before long, total long"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, first, head, t and len: a row with the head's turns for each conversation, and one for each of its own turns.

    The head are the first crc32(conv_id) mod 6 turns of the conversation conv_id - conv_id mod 100.
    """
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    own = x.select("conv_id", *placed("turn", "role", "text"), name.alias("t"), F.length("text").cast("long").alias("len"))
    first = own.where(F.col("conv_id") % FAMILY == 0).withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER))).where(F.col("rn") <= HEAD)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rn", "t", "len"))).alias("head"))
    lead = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    each = own.select("conv_id").distinct().withColumn("lead", lead).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    none = F.array().cast(heads.schema["head"].dataType)
    each = each.select("conv_id", F.lit(True).alias("first"), "lead", F.slice(F.coalesce("head", none), F.lit(1), F.col("lead")).alias("head"))
    blank = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in [*ORDER, "t", "len"]]
    mine = own.select("conv_id", F.lit(False).alias("first"), F.lit(None).cast("int").alias("lead"), F.lit(None).cast(each.schema["head"].dataType).alias("head"), *ORDER, "t", "len")
    return each.select("*", *blank).unionByName(mine)


def blocks_of(conversations: DataFrame) -> DataFrame:
    """The blocks of every rebuilt conversation, in ``BLOCKS``: k-th block, digest of what comes before, digests and lengths of its
    ``m`` turns, whether the conversation ends with it, code points before it, and at the end, of all."""
    rows = rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("first").desc(), *ORDER).select("conv_id", "first", "lead", "head", "t", "len")
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, skip, k, start, before, turns, lens = None, 0, 0, ROOT, 0, [], []

        def close(ended: bool) -> None:
            nonlocal k, start, before, turns, lens
            size = sum(lens)
            out.append((conv, k, start, "".join(turns), ",".join(map(str, lens)), len(turns), ended, before, before + size if ended else None))
            start = hashlib.md5((start + "".join(turns)).encode()).hexdigest()
            k, before, turns, lens = k + 1, before + size, [], []

        def turn(t: str, size: int) -> None:
            if len(turns) == TURNS:
                close(False)
            turns.append(t)
            lens.append(size)

        for b in batches:
            for c, first, lead, head, t, size in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if first:
                    if conv is not None:
                        close(True)
                    conv, skip, k, start, before = c, lead, 0, ROOT, 0
                    for x in head:
                        turn(x["t"], x["len"])
                elif skip:
                    skip -= 1
                else:
                    turn(t, size)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                out.clear()
        if conv is not None:
            close(True)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    return rows.mapInArrow(run, BLOCKS)


def node_of(j: Column) -> Column:
    """The name of the prefix that ends with the block's j-th turn."""
    return F.when(j == 0, F.col("start")).otherwise(F.md5(F.concat("start", F.substring(F.col("turns"), F.lit(1), j * 32)).cast("binary")))


def per_node(blocks: DataFrame, steps: C.Steps, name: str, sums: list[str], least: str, at_end: str | None = None) -> DataFrame:
    """node, parent, depth, len and before of every prefix of ``blocks``, with the sums and the least value of those that begin with it.

    ``at_end`` is summed over those that end there only. Blocks are grouped first; blocks with siblings are refined to turns.
    """
    values = [*sums, *([at_end] if at_end else [])]
    grouped = steps(blocks.groupBy("k", "start", "turns", "lens", "m", "before").agg(*(F.sum(c).alias(c) for c in values), F.min(least).alias(least)), f"{name}_blocks")
    siblings = grouped.groupBy("start").agg(F.count("*").alias("siblings"))
    known = C.dealt_join(grouped, siblings, "start", "turns")
    lens = F.transform(F.split("lens", ","), lambda s: s.cast("long"))
    length = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    one = lambda j: F.struct(
        node_of(j).alias("node"), F.when(j > 0, node_of(F.greatest(j - 1, F.lit(0)))).alias("parent"), (F.col("k") * TURNS + j).alias("depth"),
        F.when(j == 0, 0).otherwise(F.element_at("sizes", F.greatest(j, F.lit(1)))).cast("long").alias("len"), (F.col("before") + length(F.slice("sizes", F.lit(1), F.greatest(j - 1, F.lit(0))))).alias("before"), (j == F.col("m")).alias("last"),
    )
    wanted = F.filter(F.sequence(F.lit(0), F.col("m")), lambda j: (j > 0) | (F.col("k") == 0))
    known = known.withColumn("sizes", F.when(F.col("m") > 0, lens).otherwise(F.array(F.lit(0).cast("long"))))
    end = [F.when(F.col("x.last"), F.col(at_end)).otherwise(0).alias(at_end)] if at_end else []
    nodes = known.select("siblings", *sums, at_end or F.lit(None).alias("_none"), least, F.explode(F.transform(wanted, one)).alias("x"))
    nodes = nodes.select("siblings", "x.node", "x.parent", "x.depth", "x.len", "x.before", *sums, *end, least)
    key = ["node", "parent", "depth", "len", "before"]
    alone = nodes.where("siblings = 1").select(*key, *values, least)
    refined = nodes.where("siblings > 1").groupBy(*key).agg(*(F.sum(c).alias(c) for c in values), F.min(least).alias(least))
    out = steps(alone.unionByName(refined.select(*key, *values, least)), name)
    steps.drop(f"{name}_blocks")
    return out


def ends(blocks: DataFrame) -> DataFrame:
    """node and ends_sha256 of the conversations that end there, by id."""
    rows = blocks.where("ended").select(node_of(F.col("m")).alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, nodes, digests = None, None, [], []
        for b in batches:
            for node, conv in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if node != at:
                    if at is not None:
                        nodes.append(at)
                        digests.append(digest.hexdigest())
                    at, digest = node, hashlib.sha256()
                    digest.update(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
            nodes, digests = [], []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return rows.mapInArrow(run, "node string, ends_sha256 string")


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with C.Steps(spark) as steps:
        blocks = steps(blocks_of(conversations), "blocks")
        total = blocks.where("ended").select("conv_id", F.col("total").alias("whole"))
        open_ = C.dealt_join(blocks.where("not ended").drop("total"), total, "conv_id", "k").withColumnRenamed("whole", "total")
        every = blocks.where("ended").unionByName(open_).withColumns({"n_convs": F.lit(1).cast("long"), "n_ended": F.col("ended").cast("long")})
        nodes = per_node(every, steps, "nodes", ["n_convs", "total"], "conv_id", "n_ended")
        children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        nodes = steps(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "with_children")
        chosen = nodes.where("n_children = 0").select("conv_id", (F.col("before") + F.col("len")).alias("whole"))
        paths = steps(C.dealt_join(blocks.drop("total"), chosen, "conv_id", "k").withColumns({"n_leaves": F.lit(1).cast("long"), "owner": F.col("conv_id")}), "paths")
        leaves = per_node(paths, steps, "leaves", ["n_leaves"], "owner")
        top = steps(leaves.groupBy("owner").agg(F.min("before").alias("top")), "tops")
        own = C.dealt_join(paths, top, "owner", "k").withColumn("own", F.col("whole") - F.col("top"))
        owned = per_node(own, steps, "owned", ["own"], "owner").select("node", "own")
        under = C.dealt_join(leaves.select("node", "n_leaves", "owner"), top, "owner", "node").select("node", "n_leaves", "top").join(owned, "node")
        up = C.dealt_join(nodes.where("parent is not null").select("parent", "node"), nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "node").select("node", "parent_conv_id")
        x = nodes.join(under, "node").join(up, "node", "left").join(ends(blocks), "node", "left")
        saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("own") + F.col("top") - F.col("before"))
        got = x.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        return steps.keep(got, "trie")
