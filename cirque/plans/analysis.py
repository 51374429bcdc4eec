"""From files to reports: catalog, sequences, annotation and hits of many genomes to the four tables of an analysis."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirque.functions.features import normalize_feature_type, orient_hits
from cirque.functions.frames import held
from cirque.operators import intervals, motifs, operons, summary
from cirque.sources import readers, sinks


class Reports(NamedTuple):
    genomes: DataFrame
    sites: DataFrame
    operons: DataFrame
    orphans: DataFrame


def analyse(spark: SparkSession, catalog: str, sequences: str, annotation: str, hits: str, motif: str = motifs.MOTIF) -> Reports:
    """The reports of all annotated genomes below the given paths; ``hits`` holds one file for each hit type."""
    place = ["assembly", "replicon"]
    replicons = readers.read_fasta(spark, sequences)
    sizes = held(replicons.select(*place, "len"))
    features = readers.read_gff(spark, annotation).withColumn("feature_type", normalize_feature_type(F.col("feature_type")))
    features = held(features.join(sizes, place).select(*place, "len", "strand", "start_bound", "end_bound", "feature_type", "attributes", "ord"))
    oriented = intervals.hits_for_replicons(orient_hits(readers.read_hits(spark, hits)), sizes)
    linked = held(intervals.link_hits(features, oriented))
    found = motifs.dedupe_sites(motifs.mark_palindromes(motifs.scan_motif(replicons.select(*place, "seq"), motif)))
    found = found.withColumn("site_id", F.concat_ws(":", "assembly", "replicon", "strand", "start_bound"))
    sites = held(found)
    genes = held(operons.predict_operons(sites, features))
    distinct = held(operons.distinct_operons(operons.build_operons(genes)))
    classified = held(operons.classify_sites(sites.select("site_id", *place, "len", "strand", "start_bound", "end_bound"), genes))
    orphan = held(operons.orphans(linked, distinct, sites))
    types = summary.replicon_types(sizes)
    table = summary.genome_summary(sizes, classified, distinct, orphan, summary.genome_associations(linked), summary.intergenic_space(features), motifs.motif_expectation(motif))
    entries = readers.read_assembly_catalog(spark, catalog)
    return Reports(
        summary.genome_report(table, entries), summary.site_table(sites, classified, types, operons.site_associations(genes, linked)),
        summary.operon_table(distinct, operons.valid_regulators(distinct, sites), types), summary.orphan_table(orphan),
    )


def write_reports(reports: Reports, folder: str) -> None:
    """The four reports tab-separated and in the order of their places below ``folder``, all or none."""
    place = ("replicon", "start_ordinal")
    sinks.write_together({"genomes": (reports.genomes, ("assembly",)), "sites": (reports.sites.drop("site_id"), place), "operons": (reports.operons, place), "orphans": (reports.orphans, place)}, folder)
