"""Sinks: tab-separated summaries one by one or together, id lists, the catalog with its header, and merged FASTA."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_summary(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Tab-separated, no header, sorted by ``order`` if given; fails if the target exists."""
    (df.orderBy(*order) if order else df).write.mode("errorifexists").option("sep", "\t").csv(path)


def write_together(summaries: dict[str, tuple[DataFrame, tuple[str, ...]]], folder: str) -> None:
    """Each summary (rows, order) below ``folder`` under its name: all of them or none.

    Nothing is written if a target exists. Summaries are written to a folder beside the targets first, and renamed once all
    are there; if a step fails, what was renamed goes again.
    """
    if not summaries:
        return
    spark = next(iter(summaries.values()))[0].sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if there := [name for name in summaries if fs.exists(path(f"{folder}/{name}"))]:
        raise FileExistsError(f"{folder}: {', '.join(there)}")
    staging, moved = f"{folder}/_staging_{uuid.uuid4().hex[:16]}", []
    try:
        for name, (df, order) in summaries.items():
            write_summary(df, f"{staging}/{name}", order)
        for name in summaries:
            target = path(f"{folder}/{name}")
            if fs.exists(target) or not fs.rename(path(f"{staging}/{name}"), target):
                raise FileExistsError(str(target))
            moved.append(target)
    except BaseException:
        for target in moved:
            fs.delete(target, True)
        raise
    finally:
        fs.delete(path(staging), True)


def write_id_list(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.text(path)


def write_catalog_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def _records(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), "replicon", F.lit("\n"), "seq").alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    """A record for each (replicon, seq)."""
    _records(sequences).write.text(path)


def write_corpus(parts: list[DataFrame], path: str) -> tuple[int, int]:
    """The records (replicon, seq) of all ``parts`` as one corpus; its records and bytes, counted while it is written."""
    seen = Observation()
    union = parts[0].select("replicon", "seq")
    for part in parts[1:]:
        union = union.unionByName(part.select("replicon", "seq"))
    lines = _records(union)
    lines.observe(seen, F.count("value").alias("records"), F.sum(F.octet_length("value") + 1).alias("bytes")).write.text(path)
    got = seen.get
    return got["records"], got["bytes"] or 0
