"""Per-genome summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirque.functions.features import assoc_code, class_label, feature_name, feature_product, keep_coding_features
from cirque.functions.geometry import feature_length, with_relation
from cirque.functions.scans import SEGMENT, SPAN, carried, cut, inside

from .catalog import attach_metadata


def replicon_types(replicons: DataFrame) -> DataFrame:
    longest = F.max("len").over(Window.partitionBy("assembly"))
    return replicons.withColumn("replicon_type", F.when(F.col("len") == longest, "Chromosome").otherwise("Plasmid"))


def genome_associations(linked: DataFrame) -> DataFrame:
    return linked.select("assembly", F.explode("assoc").alias("t")).groupBy("assembly").agg(F.array_sort(F.collect_set("t")).alias("assoc"))


def intergenic_space(features: DataFrame, span: int = SPAN) -> DataFrame:
    """assembly, gap_total, gene_total and len_total; gap_total is null where there is no gap. The gap from last to first is not counted.

    The feature before another is looked up within a segment of ``span`` bases, and for the first of a segment it is
    the last of the earlier ones, so no task sorts a whole replicon.
    """
    place, at = ["assembly", "replicon"], F.struct("start_bound", "end_bound")
    # of features at one place any will do, as only places count; they are told apart in the exchange that the scan needs
    genes = cut(keep_coding_features(features, ("Region", "Gene", "Pseudogene")), F.col("start_bound"), span).select(*place, SEGMENT, "len", "start_bound", "end_bound")
    genes = genes.repartition(*place, SEGMENT).distinct()
    genes = carried(genes, place, {"p": (F.max, at)})
    genes = genes.withColumn("p", F.coalesce(F.max(at).over(inside(place, "start_bound", "end_bound", strict=True)), F.col("p_before")))
    genes = genes.withColumns({"ps": F.col("p.start_bound"), "pe": F.col("p.end_bound")})
    genes = with_relation(genes, (F.col("ps"), F.col("pe"), F.lit("Forward")), (F.col("start_bound"), F.col("end_bound")), F.col("len"), "link", "gap")
    per = genes.groupBy(*place).agg(F.sum(F.coalesce("gap", F.lit(0))).alias("gaps"), F.sum(feature_length(F.col("start_bound"), F.col("end_bound"), F.col("len"))).alias("genes"), F.max("len").alias("len"))
    total = per.groupBy("assembly").agg(F.sum("gaps").alias("gaps"), F.sum("genes").alias("gene_total"), F.sum("len").alias("len_total"))
    return total.select("assembly", F.when(F.col("gaps") > 0, F.col("gaps")).alias("gap_total"), "gene_total", "len_total")


def site_counts(classified: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("site_type") == k).alias(k.lower())
    return classified.groupBy("assembly").agg(F.count("*").alias("n_sites"), n("Exterior"), n("Interior"), n("Boundary"))


def operon_counts(distinct: DataFrame) -> DataFrame:
    return distinct.groupBy("assembly").agg(F.count("*").alias("n_operons"), F.sum("n_genes").alias("n_genes"))


def genome_summary(replicons: DataFrame, classified: DataFrame, distinct: DataFrame, orphan: DataFrame, assoc: DataFrame, space: DataFrame, expectation: float) -> DataFrame:
    """One row for each assembly; every side is aggregated before it is joined. ``assoc`` has the hit types of assemblies."""
    base = replicons.groupBy("assembly").agg(F.count("*").alias("n_replicons"), F.sum("len").alias("total_len"))
    x = base.join(site_counts(classified), "assembly", "left").join(operon_counts(distinct), "assembly", "left").join(orphan.groupBy("assembly").agg(F.count("*").alias("n_orphans")), "assembly", "left").join(assoc, "assembly", "left").join(space, "assembly", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    expected = F.lit(expectation) * F.col("total_len")
    per = lambda c: F.try_divide(c * 1_000_000, F.col("total_len"))
    return x.select(
        "assembly", "n_replicons", "total_len", F.try_divide("gap_total", "len_total").alias("gap_frac"), F.try_divide("gene_total", "len_total").alias("gene_frac"), expected.alias("expected_sites"), zero("n_sites"),
        per(expected).alias("expected_per_mbp"), per(F.coalesce("n_sites", F.lit(0))).alias("actual_per_mbp"), zero("exterior"), zero("interior"), zero("boundary"), zero("n_operons"), zero("n_genes"), zero("n_orphans"), assoc_code(F.col("assoc")).alias("code"),
    )


def genome_densities(replicons: DataFrame, sites: DataFrame, assoc: DataFrame) -> DataFrame:
    """assembly, total_len, actual_per_mbp and code of ``genome_summary``, for reports that ask for no more; ``assoc`` has the hit types of assemblies.

    Every site is classified, so that their number needs no classes: operons, orphans and gaps are not made for these columns.
    """
    base = replicons.groupBy("assembly").agg(F.sum("len").alias("total_len"))
    x = base.join(sites.groupBy("assembly").agg(F.count("*").alias("n_sites")), "assembly", "left").join(assoc, "assembly", "left")
    return x.select("assembly", "total_len", F.try_divide(F.coalesce("n_sites", F.lit(0)) * 1_000_000, F.col("total_len")).alias("actual_per_mbp"), assoc_code(F.col("assoc")).alias("code"))


def density_by_association(report: DataFrame, letter: str = "Y") -> DataFrame:
    """has_type, mean_density, n_genomes and n_species of genomes with and without a hit type; empty genomes do not count."""
    by = report.where("total_len > 0").groupBy(F.contains("code", F.lit(letter)).alias("has_type"))
    return by.agg(F.avg("actual_per_mbp").alias("mean_density"), F.count_distinct("assembly").alias("n_genomes"), F.count_distinct("species_tax_id").alias("n_species"))


#: Columns of the catalog that a genome's report begins with.
METADATA = ["assembly_accession", "species_tax_id", "tax_id", "organism_name", "infraspecific_name"]


def genome_report(summary: DataFrame, assemblies: DataFrame) -> DataFrame:
    """The genome summary with its catalog entry: twenty columns beside the assembly's name."""
    full = attach_metadata(summary, assemblies, METADATA)
    return full.select("assembly", *METADATA, *(c for c in summary.columns if c != "assembly"))


def species_with_type(report: DataFrame, letter: str = "Y") -> DataFrame:
    """(species_tax_id): the different species of genomes that have the hit type and are not empty."""
    return report.where((F.col("total_len") > 0) & F.contains("code", F.lit(letter))).select("species_tax_id").distinct()


def site_table(sites: DataFrame, classified: DataFrame, types: DataFrame, assoc: DataFrame) -> DataFrame:
    """The report of sites (site_id, seq, dimension and place): ten columns and site_id."""
    c = classified.select("site_id", "site_type", class_label(F.col("site_class"), F.col("class_distance")).alias("class_label"), "n_genes")
    x = sites.join(c, "site_id").join(types.select("assembly", "replicon", "replicon_type"), ["assembly", "replicon"], "left").join(assoc.select("site_id", "assoc"), "site_id", "left")
    return x.select("seq", "replicon", "replicon_type", (F.col("start_bound") + 1).alias("start_ordinal"), "strand", "n_genes", "site_type", "class_label", "dimension", assoc_code(F.col("assoc")).alias("code"), "site_id")


def operon_table(distinct: DataFrame, regulators: DataFrame, types: DataFrame) -> DataFrame:
    """The report of distinct operons: replicon, replicon_type, start_ordinal, strand, n_operators, n_genes; ``regulators`` are pairs of operon and site."""
    key = ["assembly", "replicon", "strand", "start_bound", "end_bound"]
    x = distinct.select("assembly", "replicon", F.col("o_strand").alias("strand"), F.col("o_start_bound").alias("start_bound"), F.col("o_end_bound").alias("end_bound"), "n_genes")
    x = x.join(regulators.groupBy(*key).agg(F.count("*").alias("n_operators")), key, "left").join(types.select("assembly", "replicon", "replicon_type"), ["assembly", "replicon"], "left")
    return x.select("replicon", "replicon_type", (F.col("start_bound") + 1).alias("start_ordinal"), "strand", F.coalesce("n_operators", F.lit(0)).alias("n_operators"), "n_genes")


def orphan_table(orphan: DataFrame) -> DataFrame:
    """The report of orphans (attributes and place): name, product, replicon, start_ordinal, end_ordinal."""
    a = F.col("attributes")
    return orphan.select(feature_name(a).alias("name"), feature_product(a).alias("product"), "replicon", (F.col("start_bound") + 1).alias("start_ordinal"), F.col("end_bound").alias("end_ordinal"))
