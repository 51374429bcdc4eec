"""The corpus pipeline: each stage works on all that the one before kept and is written as Parquet in between.

Toxic documents go; of near-duplicate groups (five words, similarity 0.8) the document with the least id stays; byte
strings of 100 bytes or more that an earlier document has are cut out; documents that hold a benchmark item go; what is
left is encoded to token ids, decoded again, and returned with digests.

Odd rows: null and empty texts are neither toxic, nor copies, nor contaminated, and stay to the end; rows that share a
doc_id are judged each by its text; an empty table gives an empty result; other columns pass through unread. Only
n_chars follows the text where passages are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirque.llm import byte_bpe, common, decontaminate, jaccard_join, suffix_array_dedup, toxicity

#: Bytes of a repeated passage that is cut: short of what fifty words take, long enough that chance does not repeat it.
PASSAGE = 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(spark, docs, 5, 80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = suffix_array_dedup.remove_repeats(spark, docs, PASSAGE, rest, digests=False)
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's output is deleted once the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    with common.Steps(spark) as steps:
        for name, stage in STAGES[:-1]:
            docs = steps(stage(spark, docs, sf_dir), name)
            if before:
                steps.drop(before)
            before = name
        name, stage = STAGES[-1]
        return steps.keep(stage(spark, docs, sf_dir), name)
