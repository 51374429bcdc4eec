"""Columns of features, hits and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nucleotide codes, their complements, and hit types with their letters in reports.
CODES, COMPLEMENTS = "ACGTURY", "TGCAAYR"
UNCHANGED = "NKMSWBDHV-"
ASSOCIATIONS = (("CopA", "A"), ("CupA", "a"), ("CopY", "Y"), ("CopZ", "Z"))


def reverse_complement(seq: Column, strict: bool = True) -> Column:
    out = F.translate(F.reverse(seq), CODES, COMPLEMENTS)
    return F.when(seq.rlike(f"[^{CODES}{UNCHANGED}]"), F.raise_error(F.lit("not a nucleotide code"))).otherwise(out) if strict else out


def strand_of(sign: Column) -> Column:
    return F.when(sign == "+", "Forward").when(sign == "-", "Reverse").otherwise("Other")


def strand_of_frame(frame: Column) -> Column:
    return F.when(frame > 0, "Forward").when(frame < 0, "Reverse").otherwise("Other")


def normalize_feature_type(kind: Column) -> Column:
    x = F.lower(kind)
    return F.when(x == "region", "Region").when(x == "gene", "Gene").when(x == "cds", "CDS").when(x == "pseudogene", "Pseudogene").when(x == "trna", "tRNA").otherwise("Other")


def to_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    return start - 1, end


def orient_hits(hits: DataFrame) -> DataFrame:
    """sstart, send, sframe become start_bound, end_bound and strand."""
    forward = F.col("sframe") > 0
    start, end = F.when(forward, F.col("sstart")).otherwise(F.col("send")), F.when(forward, F.col("send")).otherwise(F.col("sstart"))
    return hits.withColumn("strand", strand_of_frame(F.col("sframe"))).withColumn("start_bound", start - 1).withColumn("end_bound", end)


def assoc_code(types: Column) -> Column:
    parts = [F.when(F.array_contains(types, name), letter).otherwise("") for name, letter in ASSOCIATIONS]
    return F.when(types.isNull() | (F.size(types) == 0), "").otherwise(F.concat(F.lit("["), *parts, F.lit("]")))


def class_label(kind: Column, distance: Column) -> Column:
    return F.when(kind == "A", F.concat(F.lit("A."), distance.cast("string"))).otherwise(kind)


def site_display_seq(seq: Column, strand: Column) -> Column:
    return F.when(strand == "Reverse", F.concat(F.lit("3'-"), F.reverse(seq), F.lit("-5'"))).otherwise(F.concat(F.lit("5'-"), seq, F.lit("-3'")))


def feature_name(attributes: Column) -> Column:
    return F.coalesce(attributes["Name"], attributes["ID"], F.lit("NO NAME"))


def feature_product(attributes: Column) -> Column:
    return F.coalesce(attributes["product"], attributes["ID"], F.lit("UNKNOWN PRODUCT"))


def keep_coding_features(features: DataFrame, drop: tuple[str, ...] = ("Region", "Gene")) -> DataFrame:
    return features.where(~F.col("feature_type").isin(*drop))


def dedupe_features(features: DataFrame) -> DataFrame:
    """One row for each place: the last in file order."""
    w = Window.partitionBy("assembly", "replicon", "start_bound", "end_bound").orderBy(F.col("ord").desc())
    return features.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
