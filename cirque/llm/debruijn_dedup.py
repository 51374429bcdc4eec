"""Substring dedup on words by de Bruijn compaction.

1. Every window of ``k`` words is an edge between the nodes of its first and its last k - 1 words. Blocks set aside edges
   that cannot repeat (``blocks.py``) and exchange the others once each, as 96-bit fingerprints. A repeated edge belongs to
   the least block that holds it and is named by its place there, (block, word). Which occurrence comes first is not asked
   yet.
2. Its block gives the edge to the graph: a trail of edges whose names run on, with hashes of the nodes that it passes.
   Spark counts edges into and out of each node; where one comes in and one goes out, the path does not branch. Trails are cut
   into runs at nodes that branch, runs that meet at any other node are joined to a unitig, and pointer doubling tells how
   many edges of the unitig precede each run (``unitigs``).
3. Repeated edges along a document become intervals (unitig, offset) with the coordinate (doc_id, word) where each starts
   (``placed``). In an interval word minus offset does not change, so intervals of a unitig have one order throughout, and
   its segments between the ends of intervals have one least coordinate each: their source (``sources``).
4. An interval keeps the segments whose source it is itself, and loses the others (``repeats``).

Removed are the words covered by a window whose words also start earlier: at a smaller doc_id, or earlier in the same
document. Odd rows: a null or empty text has no words; texts under ``k`` words lose nothing; a null doc_id counts as
larger than every number; of rows with the same doc_id none is earlier than the other at the same start. Two nodes with
one hash only make a unitig shorter. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C
from .components import components
from .suffix_array_dedup import run

U = np.uint64
ANCHOR = 6
#: Rows of the graph: walks (all but the nodes); with null block, trails (n, src_block, src_at, from_node, to_node); with null n too,
#: nodes inside trails (src_block, src_at of the edge that leaves it, from_node).
GRAPH = pa.schema([("block", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("word", pa.int64()), ("src_block", pa.int32()), ("src_at", pa.int64()), ("from_node", pa.int64()), ("to_node", pa.int64())])
#: Coordinates that are joined by one key.
BIN = 512


class Words:
    """The words of concatenated texts: spans, hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.of = C.word_spans(data, offsets)
        self.h = C.word_hashes(data, self.start, self.end)
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(self.of, minlength=len(offsets) - 1))])


def word_anchors(k: int):
    def find(data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        if len(w.h) < k:
            return (np.zeros(0, np.int64),) * 3
        return B.owners(C.joined(w.h, ANCHOR)[: len(w.h) - ANCHOR + 1], B.inside(w.offsets, k, len(w.h)), k - ANCHOR + 1)

    return find


def edge_hash(h: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    out = C.mix(h[at] ^ U(seed))
    for j in range(1, k):
        out = C.mix(out * U(0x9E3779B97F4A7C15) + h[at + j]) if j % 4 == 0 else out * U(0xD6E8FEB86659FD93) + h[at + j]
    return C.mix(out)


class Edges:
    """The distinct edges that a block sends, sorted by fingerprint, and where each of its windows stands among them."""

    def __init__(self, b: B.Block, codes: np.ndarray, k: int):
        self.words = w = Words(b.text, b.offsets)
        anchors = B.spread(C.joined(w.h, ANCHOR)[b.anchor] if len(b.anchor) else np.zeros(0, U))
        _, inv, _ = B.distinct(anchors)
        open_ = np.flatnonzero(codes[inv] > 0) if len(inv) else np.zeros(0, np.int64)
        self.window = np.repeat(b.first[open_], b.own[open_]) + run(b.own[open_])
        fp = edge_hash(w.h, self.window, k, 1)
        self.fp, first, self.inverse, count = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        self.many = count > 1
        self.word = self.window[first]
        self.second = (edge_hash(w.h, self.word, k, 0x5851F42D4C957F2D) >> U(32)).astype(np.uint32)


def name_edges(t: pa.Table) -> pa.Table:
    """For one bucket: 0 for an edge that occurs once, 1 if it is the sender's, 2 with its name if it is another block's."""
    t = t.sort_by("block")
    sizes = [len(x.as_py()) // 8 for x in t.column("fp")]
    get = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in t.column(c)), kind)
    fp, second, word, many = get("fp", np.uint64), get("second", np.uint32), get("word", np.uint32), get("many", np.uint8)
    block = np.repeat(t.column("block").to_numpy(), sizes)
    order = np.argsort(fp, kind="stable")
    f, s = fp[order], second[order]
    if ((f[1:] == f[:-1]) & (s[1:] != s[:-1])).any():
        order = np.lexsort((block, second, fp))
        f, s = fp[order], second[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(f)))
    repeated = np.repeat((size > 1) | (np.maximum.reduceat(many[order], start) > 0), size)
    src = np.repeat(order[start], size)
    code, from_block, from_word = np.zeros(len(fp), np.uint8), np.empty(len(fp), np.int32), np.empty(len(fp), np.uint32)
    code[order] = np.where(repeated, np.where(src == order, 1, 2), 0)
    from_block[order], from_word[order] = block[src], word[src]
    end = np.cumsum([0, *sizes])
    out: dict[str, list] = {"codes": [], "src_block": [], "src_at": []}
    for i, j in zip(end, end[1:], strict=False):
        far = code[i:j] == 2
        out["codes"].append(code[i:j].tobytes())
        out["src_block"].append(from_block[i:j][far].tobytes())
        out["src_at"].append(from_word[i:j][far].tobytes())
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket")} | {c: pa.array(v, pa.binary()) for c, v in out.items()} | {"kind": pa.array([3] * t.num_rows, pa.int32())})


def graph_of(b: B.Block, left: pa.Table, k: int) -> pa.Table:
    """What a block adds to the graph: its walks, runs of repeated windows whose edges' names run along, and its own edges as trails."""
    e = Edges(b, B.codes_in(left, 1), k)
    rows = sorted((x for x in left.to_pylist() if x["kind"] == 3), key=lambda x: x["bucket"])
    get = lambda c, kind: np.frombuffer(b"".join(x[c] for x in rows), kind)
    code = get("codes", np.uint8)
    block, at = np.full(len(e.fp), b.block, np.int32), e.word.astype(np.int64)
    far = code == 2
    if len(code):
        block[far], at[far] = get("src_block", np.int32), get("src_at", np.uint32)
    again = code[e.inverse] > 0 if len(code) else np.zeros(0, bool)
    p = e.window[again]
    t, block, at = np.searchsorted(e.words.offsets, p, "right") - 1, block[e.inverse][again], at[e.inverse][again]
    new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (t[1:] != t[:-1]) | (block[1:] != block[:-1]) | (at[1:] != at[:-1] + 1)]) if len(p) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    own = np.sort(e.word[code == 1]) if len(code) else np.zeros(0, np.int64)
    starts = np.concatenate([[True], own[1:] != own[:-1] + 1]) if len(own) else np.zeros(0, bool)
    head, inner = own[starts], own[~starts]
    n = np.diff(np.append(np.flatnonzero(starts), len(own)))
    node = lambda at: edge_hash(e.words.h, at, k - 1, 7).view(np.int64)

    def part(size: int, **columns) -> pa.Table:
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in GRAPH], schema=GRAPH)

    mine = np.full(len(own), b.block, np.int32)
    return pa.concat_tables([
        part(len(s), block=np.full(len(s), b.block, np.int32), at=p[s], n=np.diff(np.append(s, len(p))), doc=b.ids[t[s]], word=p[s] - e.words.offsets[t[s]], src_block=block[s], src_at=at[s]),
        part(len(head), n=n, src_block=mine[: len(head)], src_at=head, from_node=node(head), to_node=node(head + n)),
        part(len(inner), src_block=mine[: len(inner)], src_at=inner, from_node=node(inner)),
    ])


def unitigs(trails: DataFrame, inner: DataFrame, steps: C.Steps) -> DataFrame:
    """(src_block, src_at, n, unitig, offset): runs of edges with names that run on, the unitig of each and its place there.

    ``trails`` are (src_block, src_at, n, from_node, to_node); ``inner`` are the nodes that they pass, (src_block, src_at of
    the edge that leaves the node, from_node). A node with one edge in and one out does not branch. Trails are cut at all other
    nodes; runs that meet at a node that does not branch are joined, whatever blocks they lie in. The least of them names the
    unitig, and a ring begins at it.
    """
    count = lambda df, node, out, into: df.select(F.col(node).alias("from_node"), F.lit(out).alias("out"), F.lit(into).alias("into"))
    ends = count(trails, "from_node", 1, 0).unionByName(count(trails, "to_node", 0, 1)).unionByName(count(inner, "from_node", 1, 1))
    branching = steps(ends.groupBy("from_node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out <> 1 or into <> 1").select("from_node", F.lit(True).alias("branches")), "branching")
    cuts = inner.join(branching, "from_node").select("src_block", "src_at", "from_node", F.lit(None).cast("long").alias("stop"), F.lit(None).cast("long").alias("to_node"), "branches")
    starts = trails.join(branching, "from_node", "left").select("src_block", "src_at", "from_node", (F.col("src_at") + F.col("n")).alias("stop"), "to_node", F.coalesce("branches", F.lit(False)).alias("branches"))
    w = Window.partitionBy("src_block").orderBy("src_at")
    both = starts.unionByName(cuts).select("src_block", "src_at", "from_node", "branches", F.last("stop", True).over(w).alias("stop"), F.last("to_node", True).over(w).alias("end_node"), F.lead("src_at").over(w).alias("next"), F.lead("from_node").over(w).alias("next_node"))
    goes_on = F.coalesce(F.col("next") < F.col("stop"), F.lit(False))
    name = F.shiftleft(F.col("src_block").cast("long"), 32) + F.col("src_at")  # a place in a block is below 2 ** 32
    runs = both.select("src_block", "src_at", (F.when(goes_on, F.col("next")).otherwise(F.col("stop")) - F.col("src_at")).alias("n"), "from_node", F.when(goes_on, F.col("next_node")).otherwise(F.col("end_node")).alias("to_node"), "branches", name.alias("id"))
    runs = steps(runs, "runs")
    follows = runs.where("not branches").select(F.col("id").alias("y"), F.col("from_node").alias("node"))
    links = steps(runs.select(F.col("id").alias("x"), F.col("to_node").alias("node"), "n").join(follows, "node").select("x", "y", "n"), "links")
    group = components(links, steps, "unitigs").select(F.col("node").alias("id"), F.col("component").alias("unitig"))
    before = links.select(F.col("y").alias("id"), F.col("x").alias("prev"), F.col("n").alias("offset"))
    ring = group.join(before, "id", "left")
    open_ = ring.where("prev is null").select(F.col("unitig").alias("id"), F.lit(True).alias("open")).distinct()
    first = F.col("prev").isNull() | (F.col("id") == F.col("unitig")) & F.col("open").isNull()  # in a ring no run has none before it
    chain = ring.join(open_, "id", "left").select("id", "unitig", F.when(~first, F.col("prev")).alias("prev"), F.when(first, 0).otherwise(F.col("offset")).cast("long").alias("offset"))
    ranked = in_order(chain, steps)
    alone = runs.join(links.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "id", "left_anti").select("src_block", "src_at", "n", F.col("id").alias("unitig"), F.lit(0).cast("long").alias("offset"))
    return runs.select("id", "src_block", "src_at", "n").join(ranked, "id").select(*alone.columns).unionByName(alone)


def in_order(chain: DataFrame, steps: C.Steps) -> DataFrame:
    """(id, unitig, offset) from rows whose ``offset`` counts from ``prev`` on: each round a row takes on what its ``prev`` has."""
    chain = steps(chain, "chain")
    while chain.where("prev is not null").limit(1).count():
        far = chain.select(F.col("id").alias("prev"), F.col("prev").alias("far"), F.col("offset").alias("more"))
        chain = steps(chain.join(far, "prev", "left").select("id", "unitig", F.col("far").alias("prev"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "chain")
    return chain.select("id", "unitig", "offset")


def bins(at: str) -> Column:
    return F.sequence(F.floor(F.col(at) / BIN), F.floor((F.col(at) + F.col("n") - 1) / BIN))


def dealt(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Join on ``on``; rows that share a key are dealt, by (block, at), into parts that each get what is known of it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("block", "at"), F.lit(parts)).cast("int"))
    return rows.join(rows.select(*on, "deal").distinct().join(known, on), [*on, "deal"]).drop("deal")


def placed(walks: DataFrame, runs: DataFrame) -> DataFrame:
    """(block, at, n, doc, lead, unitig, offset, bin): walks as intervals of unitigs, cut at multiples of ``BIN`` edges.

    ``lead`` is the word of the document minus the offset, the same all along an interval. Walks and runs meet by the
    names of their edges, both cut at multiples of ``BIN`` there too.
    """
    r = runs.select("src_block", F.col("src_at").alias("r_at"), F.col("n").alias("r_n"), "unitig", "offset", F.explode(bins("src_at")).alias("bin"))
    met = dealt(walks.withColumn("bin", F.explode(bins("src_at"))), r, ["src_block", "bin"])
    start = F.greatest("src_at", "r_at", F.col("bin") * BIN)
    end = F.least(F.col("src_at") + F.col("n"), F.col("r_at") + F.col("r_n"), (F.col("bin") + 1) * BIN)
    ahead, place = start - F.col("src_at"), F.col("offset") + start - F.col("r_at")
    met = met.where(start < end).select("block", (F.col("at") + ahead).alias("at"), (end - start).alias("n"), "doc", (F.col("word") + ahead - place).alias("lead"), "unitig", place.alias("offset"))
    from_, to = F.greatest("offset", F.col("bin") * BIN), F.least(F.col("offset") + F.col("n"), (F.col("bin") + 1) * BIN)
    return met.withColumn("bin", F.explode(bins("offset"))).select("block", (F.col("at") + from_ - F.col("offset")).alias("at"), (to - from_).alias("n"), "doc", "lead", "unitig", from_.alias("offset"), "bin")


def sources(intervals: DataFrame) -> DataFrame:
    """(unitig, bin, start, stop, src_doc, src_lead): the least coordinate of each segment between the ends of intervals.

    Equal intervals are one row before anything is shuffled, so a bin has at most BIN * (BIN + 1) / 2, whatever number of
    documents shares it.
    """
    distinct = intervals.groupBy("unitig", "bin", "offset", "n").agg(F.min(F.struct("doc", "lead")).alias("least"))
    w = Window.partitionBy("unitig", "bin")
    ends = F.array_sort(F.array_union(F.collect_set("offset").over(w), F.collect_set(F.col("offset") + F.col("n")).over(w)))
    between = distinct.withColumn("ends", ends).withColumn("ends", F.filter("ends", lambda x: (x >= F.col("offset")) & (x <= F.col("offset") + F.col("n"))))
    cut = F.zip_with(F.slice("ends", F.lit(1), F.size("ends") - 1), F.slice("ends", F.lit(2), F.size("ends") - 1), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    segments = between.select("unitig", "bin", "least", F.explode(cut).alias("s")).groupBy("unitig", "bin", "s").agg(F.min("least").alias("least"))
    return segments.select("unitig", "bin", "s.start", "s.stop", F.col("least.doc").alias("src_doc"), F.col("least.lead").alias("src_lead"))


def repeats(intervals: DataFrame, known: DataFrame) -> DataFrame:
    """(block, at, n): the parts of intervals that start at another coordinate than their source does."""
    start, stop = F.greatest("offset", "start"), F.least(F.col("offset") + F.col("n"), "stop")
    met = dealt(intervals, known, ["unitig", "bin"]).where((start < stop) & ((F.col("doc") != F.col("src_doc")) | (F.col("lead") != F.col("src_lead"))))
    return met.select("block", (F.col("at") + start - F.col("offset")).alias("at"), (stop - start).alias("n"))


def find_walks(blocks: DataFrame, n: int, k: int, steps: C.Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The walks, the trails and the nodes inside trails (``GRAPH``); ``at`` counts words from the block's first."""

    def keys(b: B.Block):
        w = Words(b.text, b.offsets)
        return B.spread(C.joined(w.h, ANCHOR)[b.anchor] if len(b.anchor) else np.zeros(0, U)), np.searchsorted(w.offsets, b.first, "right") - 1

    known = steps(B.repeated_anchors(blocks, n, keys, within_text=True), "anchors")
    names = ["fp", "second", "word", "many"]

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = B.Block(row)
            e = Edges(b, B.codes_in(right), k)
            columns = [(e.fp, "<u8"), (e.second, "<u4"), (e.word, "<u4"), (e.many, "u1")]
            out += [{"bucket": x, "block": b.block} | {c: C.raw(v[i:j], kind) for c, (v, kind) in zip(names, columns, strict=True)} for x, i, j in B.cuts(e.fp, n * 2)]
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in names)]))

    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, "bucket int, block int, " + ", ".join(f"{c} binary" for c in names))
    named = steps(sent.groupBy("bucket").applyInArrow(name_edges, "block int, bucket int, codes binary, src_block binary, src_at binary, kind int"), "names")
    both = named.unionByName(known.select("block", "bucket", "codes", F.lit(None).cast("binary").alias("src_block"), F.lit(None).cast("binary").alias("src_at"), F.lit(1).alias("kind")))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([graph_of(B.Block(row), right, k) for row in left.to_pylist()])

    graph = steps(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(walk, "block int, at long, n long, doc long, word long, src_block int, src_at long, from_node long, to_node long"), "graph")
    steps.drop("anchors", "names")
    trails = graph.where("block is null and n is not null").select("src_block", "src_at", "n", "from_node", "to_node")
    inner = graph.where("block is null and n is null").select("src_block", "src_at", "from_node")
    return graph.where("block is not null").select("block", "at", "n", "doc", "word", "src_block", "src_at"), trails, inner


def remove_repeats(spark: SparkSession, docs: DataFrame, k: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    C.prepare(spark)
    blocks, n, name = B.build(spark, docs, word_anchors(k), [])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = B.Block(row)
            w = Words(b.text, b.offsets)
            mark = np.zeros(len(w.h) + 1, np.int64)
            at, n = right.column("at").to_numpy(), right.column("n").to_numpy()
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n + k - 1, -1)
            cover = np.cumsum(mark)[:-1] > 0
            kept = np.flatnonzero(~cover)
            size = w.end[kept] - w.start[kept] + 1
            spaced = np.concatenate([b.text, np.zeros(1, np.uint8)])[np.repeat(w.start[kept], size) + run(size)]
            ends = np.cumsum(size)
            spaced[ends - 1] = 32
            cut = np.concatenate([[0], ends])[np.searchsorted(kept, w.offsets)]
            removed = np.concatenate([[0], np.cumsum(cover)])[w.offsets]
            sha = [hashlib.sha256(spaced[i : max(i, j - 1)].tobytes()).hexdigest() for i, j in zip(cut, cut[1:], strict=False)]
            out.append(pa.table({"doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == C.NULL_ID), "n_words": pa.array(np.diff(w.offsets), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "kept_sha256": pa.array(sha, pa.string())}))
        return pa.concat_tables(out)

    try:
        with C.Steps(spark) as steps:
            walks, trails, inner = find_walks(blocks, n, k, steps)
            intervals = steps(placed(walks, unitigs(trails, inner, steps)), "intervals")
            gone = repeats(intervals, sources(intervals))
            return steps.keep(blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"), "kept")
    finally:
        B.discard(spark, name)
