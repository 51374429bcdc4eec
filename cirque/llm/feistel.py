"""Reproducible shuffles: a keyed Feistel permutation of global row numbers, with cycle walking.

Row numbers are global: rows are dealt by range, counted by partition, and numbered from the partition's offset. The
permutation needs no table: four or more rounds mix the two halves of the number; a result beyond the last row is
permuted again until it falls inside (fewer than four times on average, as the domain is less than four times the rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
ROUNDS = 6


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The image of each number of 0..n-1 (or with ``back`` its origin) under the permutation that ``key`` picks."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = C.mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (2**64 - 1)))
    x = np.asarray(x).astype(U)
    out, at = np.empty_like(x), np.arange(len(x))
    while len(x):
        a, b = x >> U(half), x & mask
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (C.mix(a + k) & mask), a) if back else (b, a ^ (C.mix(b + k) & mask))
        x = (a << U(half)) | b
        inside = x < U(n)
        out[at[inside]] = x[inside]
        x, at = x[~inside], at[~inside]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row", place: Callable[[np.ndarray, int], np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """``df`` with a global row number from 0 in the order of ``order``, and the number of rows; with ``place`` what that makes of numbers and total.

    Nothing but one count for each partition reaches the driver. Rows equal in all of ``order`` may come in either order.
    """
    spark = df.sparkSession
    C.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, offset = 0, {}
    for k in sorted(counts):
        offset[k], total = total, total + counts[k]
    kept = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            if b.num_rows:
                at = offset[b.column("_part")[0].as_py()] + seen
                seen += b.num_rows
                row = np.arange(at, at + b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(place(row, total) if place else row)], names=[*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} long"])
    return placed.mapInArrow(number, schema), total


def shuffled(df: DataFrame, order: list[str], key: int, name: str = "place") -> tuple[DataFrame, int]:
    """``df`` with each row's place in the shuffled order, and the number of rows."""
    return numbered(df, order, name, lambda row, total: permute(row, total, key))


def shards(docs: DataFrame, count: int = 16, key: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law ``rows``, shard sizes at most one row apart.

    Place p of the shuffled order is slot p // count of shard p % count. A null text has size 1 and checksum 0; equal
    doc_ids, null ones too, are told apart by size and checksum, and rows equal in all three are interchangeable: each has
    a place of its own. An empty table has no shards. Other columns are not read.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows, _ = shuffled(slim, ["doc_id", "size", "text_crc32"], key)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % count).cast("int").alias("shard"), F.floor(F.col("place") / count).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
