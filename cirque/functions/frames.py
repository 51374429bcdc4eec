"""Frames that are computed once and used several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only a single machine may use a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: While a frame is written: its shuffle files go when it is done.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of frames held on the way to one that is being ``settled``.
_inner: ContextVar[list[str] | None] = ContextVar("inner", default=None)


def held(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder of spark.checkpoint.dir, so that lost executors and later uses do not recompute it.

    A checkpoint would hold each row as it lies in memory, names of places spelled out, and be read whole whatever columns are asked for.
    The shuffle files of ``df`` go when it is written: they would stay until the driver collects its garbage, and a query's steps add up.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/held_{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(RELEASE, before)
        if (inner := _inner.get()) is not None:
            inner.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``held(make())``; what ``make`` has held on the way is deleted, so no other frame may read from that."""
    inner: list[str] = []
    try:
        token = _inner.set(inner)
        try:
            df = make()
        finally:
            _inner.reset(token)
        return held(df)
    finally:
        spark = SparkSession.getActiveSession()
        for folder in inner:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join with ``right``, which has one row for each ``on``; rows of ``left`` with one value are dealt by ``by`` into parts.

    ``right`` is copied once for each part that holds the value, so a value that a third of all rows have does not make
    one task of them. ``how`` is inner or left.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    known = dealt.select(on, "_deal").distinct().join(right, on)
    return dealt.join(known, [on, "_deal"], how).drop("_deal")
