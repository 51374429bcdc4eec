"""Training-order materialisation: fixed-stride shards of token sequences in a keyed global order.

Each document's tokens are cut into sequences of ``length``. Sequences are numbered globally by document; a keyed
Feistel permutation with cycle walking gives every sequence its slot in the training order. Range partitions over the
slots then write shards of ``per_shard`` records of equal size, each a header (doc_id, sequence, tokens; 16 bytes) and
the tokens, padded with zeros. Record k of shard s is slot s * per_shard + k at byte k * stride, so a reader that
stopped at slot t resumes at shard t // per_shard without reading what went before.

Texts are sorted by document once and numbered where they lie; only one count for each partition reaches the driver.
A slot's range partition follows from its number, since slots are a permutation of 0 to total - 1.

Shards are rows (shard, first_slot, n, data) of a Parquet table, so Spark's committer makes each appear once even if
executors are lost. Odd rows: null and empty texts have no sequences; a row repeated as a whole (same doc_id and
text) has slots of its own; a null doc_id is written as the largest number; an empty table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .feistel import permute

HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n", "<u4")])


def tokens_of_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): each UTF-8 byte as a token id of one byte."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("tokens"))


def materialise(tokens: DataFrame, length: int, width: int = 1, per_shard: int = 1024, key: int = 20240607) -> DataFrame:
    """The written shards of ``tokens`` (doc_id, tokens binary with ``width`` bytes a token)."""
    spark = tokens.sparkSession
    C.prepare(spark)
    size = width * length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with C.Steps(spark) as steps:
        placed = steps(numbered_sequences(tokens, size, parts), "numbered")
        # the first sequence of each partition, from one count for each
        base, total = {}, 0
        for r in sorted(placed.groupBy("part").agg(F.sum("seqs").alias("seqs")).collect(), key=lambda r: r["part"]):
            base[r["part"]], total = total, total + r["seqs"]
        n_shards = max(1, -(-total // per_shard))
        parts = min(parts, n_shards)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in C.slices(batches, "tokens"):
                slot, record = [], []
                for doc, part, first, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "first")), b.column("tokens"), strict=True):
                    data = data.as_py()
                    n = -(-len(data) // size)
                    slot.append(permute(base[part] + first + np.arange(n), total, key))
                    pieces = [data[k * size : (k + 1) * size] for k in range(n)]
                    head = np.array([(doc, k, len(x) // width) for k, x in enumerate(pieces)], HEAD)
                    record += [h.tobytes() + x for h, x in zip(head, pieces, strict=True)]
                slot = np.concatenate(slot) if slot else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard * parts // n_shards), pa.array(slot), pa.array(record, pa.binary())], names=["range", "slot", "record"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            shard = None

            def row():
                return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "first_slot": pa.array([shard * per_shard], pa.int64()), "n": pa.array([len(held)], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})

            for b in batches:
                for t, r in zip(b.column("slot").to_pylist(), b.column("record"), strict=True):
                    if t // per_shard != shard:
                        if held:
                            yield row()
                        held, shard = [], t // per_shard
                    held.append(r.as_py().ljust(HEAD.itemsize + size, b"\0"))
            if held:
                yield row()

        # a slot's range follows from its number, so nothing has to be sampled
        ranges = placed.mapInArrow(cut, "range long, slot long, record binary").repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("slot")
        return steps.keep(ranges.mapInArrow(gather, "shard long, first_slot long, n int, data binary"), "shards")


def numbered_sequences(tokens: DataFrame, size: int, parts: int) -> DataFrame:
    """(part, first, seqs, doc_id, tokens) by doc_id and content: a document's sequences begin with number ``first`` of its partition."""
    some = tokens.where(F.octet_length("tokens") > 0).select("doc_id", "tokens", F.xxhash64("tokens").alias("content"))
    ranged = some.repartitionByRange(parts, "doc_id", "content").sortWithinPartitions("doc_id", "content").select(F.spark_partition_id().alias("part"), "doc_id", "tokens")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            seqs = -(-pc.binary_length(b.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64) // size)
            first = seen + np.cumsum(seqs) - seqs
            seen += int(seqs.sum())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(first), pa.array(seqs), b.column("doc_id"), b.column("tokens")], names=["part", "first", "seqs", "doc_id", "tokens"])

    return ranged.mapInArrow(number, "part int, first long, seqs long, doc_id long, tokens binary")


def records(shards: DataFrame, length: int, width: int = 1, start: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq, n_tokens, tokens) in slots from ``start`` on, read from the shards' bytes."""
    stride = HEAD.itemsize + width * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, n, data in zip(b.column("shard").to_pylist(), b.column("first_slot").to_pylist(), b.column("n").to_pylist(), b.column("data"), strict=True):
                data = data.as_buffer()
                k = np.arange(max(0, start - first), n)
                head = np.array([np.frombuffer(data, HEAD, 1, int(x) * stride)[0] for x in k], HEAD)
                body = [bytes(memoryview(data)[int(x) * stride + HEAD.itemsize : int(x) * stride + HEAD.itemsize + int(h["n"]) * width]) for x, h in zip(k, head, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(first + k, pa.int64()), pa.array(np.full(len(k), shard), pa.int64()), pa.array(k * stride, pa.int64()), pa.array(head["doc_id"].copy()), pa.array(head["seq"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), pa.array(body, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "tokens"])

    per = shards.where((F.col("first_slot") + F.col("n")) > start)
    return per.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, seq long, n_tokens long, tokens binary")


def in_training_order(docs: DataFrame, length: int = 1024) -> DataFrame:
    """A row for each sequence as read back from its shard: doc_id, seq, slot, shard, byte_offset, n_tokens, tokens_sha256."""
    got = records(materialise(tokens_of_bytes(docs), length), length)
    return got.select(F.when(F.col("doc_id") != C.NULL_ID, F.col("doc_id")).alias("doc_id"), "seq", "slot", "shard", "byte_offset", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))
