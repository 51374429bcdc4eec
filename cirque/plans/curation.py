"""From catalogs and folders to the reports of a collection: what is listed, present, annotated, intact, and unique."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirque.functions.frames import held
from cirque.operators import catalog as A
from cirque.sources import readers, sinks


class Collection(NamedTuple):
    catalog: DataFrame
    counts: DataFrame
    annotated: DataFrame
    sources: DataFrame
    differences: DataFrame
    unique: DataFrame
    checked: DataFrame
    checks: DataFrame
    unmatched: DataFrame


def curate(spark: SparkSession, refseq_catalog: str, genbank_catalog: str, root: str) -> Collection:
    """Reports of the assemblies that two catalogs list, of which some lie below ``root`` as a folder each.

    Folders are listed once, without contents; contents are read once, to hash them. A folder without files is not seen.
    """
    both = [readers.read_assembly_catalog(spark, x) for x in (refseq_catalog, genbank_catalog)]
    listed = A.complete_assemblies(A.union_catalogs(*both, "subdir_name", "assembly_accession")).withColumn("dir_name", A.ftp_dir_name(F.col("ftp_location")))
    files = held(readers.inventory(spark, root))
    present = files.select(F.col("assembly").alias("dir_name")).distinct()
    listed = held(A.with_annotation(listed, files).join(present.withColumn("here", F.lit(True)), "dir_name", "left").withColumn("present", F.coalesce("here", F.lit(False))).drop("here"))
    annotated = A.annotated_assemblies(files)
    named = annotated.select(F.col("assembly").alias("dir_name"), "annotated")
    manifest = readers.read_md5_manifest(spark, f"{root.rstrip('/')}/*/md5checksums.txt")
    checked = held(A.verify_md5(manifest, readers.checksums(spark, root), files.select("assembly")))
    return Collection(listed, A.catalog_counts(listed), annotated, A.source_comparison(named), A.source_differences(named), A.unique_assemblies(named), checked, A.md5_report(checked), A.unmatched_assemblies(present, listed))


def write_collection(found: Collection, folder: str) -> None:
    """The catalog with its header, and the names of annotated, other and unique assemblies, one a line."""
    sinks.write_catalog_csv(found.catalog.drop("present"), f"{folder}/catalog")
    for name, rows in (("annotated", found.annotated.where("annotated").select("assembly")), ("unannotated", found.annotated.where("not annotated").select("assembly")), ("unique", found.unique)):
        sinks.write_id_list(rows.orderBy(rows.columns[0]), f"{folder}/{name}")
