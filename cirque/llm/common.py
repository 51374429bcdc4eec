"""Shared helpers of the training-data operators: tables, checkpoints, Arrow slices and vectorised hashing.

Texts are handled as UTF-8 bytes in numpy arrays. ``words`` are maximal runs of bytes other than
space and 0x09-0x0D, so they never split a character. Every hash is 64 bits and built from the bytes alone.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
NULL_ID = np.iinfo(np.int64).max  # a null doc_id sorts after every number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Names a checkpoint folder where the cluster has not; only a single machine may use a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared(spark: SparkSession, name: str) -> str:
    """The path of ``name`` in the shared folder, which ``prepare`` has named."""
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: While a step is written: its shuffle files go when it is done, and Arrow batches stay small.
STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Settings of ``STEP`` for what is run inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join with ``right``, which has one row for each ``on``; rows of ``left`` with one value are dealt by ``by``. ``how`` is inner or left.

    A value goes to as many parts as hold any of its rows, at most the number of shuffle partitions, so that a value that
    a third of all rows have does not make one task of them.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    known = dealt.select(on, "_deal").distinct().join(right, on)
    return dealt.join(known, [on, "_deal"], how).drop("_deal")


def blank(df: DataFrame, *names: str) -> DataFrame:
    """The columns the operator needs, in order; others are dropped so that none can clash."""
    return df.select(*names)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one have about ``most`` bytes, or are a single long one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64)


def ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    n = len(data)
    x = np.zeros(n + 8, U)
    x[:n] = data
    x[:-1] = (x[:-1] << U(8)) | x[1:]
    x[:-2] = (x[:-2] << U(16)) | x[2:]
    x[:-4] = (x[:-4] << U(32)) | x[4:]
    return x[:n]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the index of its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length."""
    eight = words8(data)
    size = end - start
    out = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    at, done = np.arange(len(start)), 0
    while len(at):
        left = np.minimum(size[at] - done, 8)
        piece = eight[start[at] + done] >> ((8 - left) * 8).astype(U)
        out[at] = mix(out[at] * U(0x2545F4914F6CDD1D) + piece)
        done += 8
        at = at[size[at] > done]
    return out


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n values in a row; the last n - 1 places hold no whole run."""
    with np.errstate(over="ignore"):
        out = h.copy()
        for j in range(1, min(n, len(h))):
            out[: len(h) - j] = mix(out[: len(h) - j] * U(0x9E3779B97F4A7C15) + h[j:])
    return out


def rows_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def raw(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


class Steps:
    """Written steps of one run, each in the shared folder of spark.checkpoint.dir: ``steps(df, name)`` writes and rereads.

    Shuffle files of a step go when it is written, and ``drop`` or the end of the ``with`` block deletes steps that
    were not returned by ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        prepare(spark)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared(self.spark, f"{name}_{uuid.uuid4().hex[:16]}")
        with step(self.spark):
            df.write.option("compression", "zstd").parquet(folder)
        self.drop(name)
        self.paths[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Written like the others, and left to the caller."""
        out = self(df, name)
        del self.paths[name]
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if folder := self.paths.pop(name, None):
                delete(self.spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder of spark.checkpoint.dir, and read from there."""
    return Steps(df.sparkSession).keep(df, name)
