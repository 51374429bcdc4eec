"""Operons around motif sites: prediction, location, classification, regulators and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirque.functions.features import dedupe_features, keep_coding_features
from cirque.functions.frames import held
from cirque.functions.geometry import arc_length, orientation, with_relation, with_sized_relation, with_sizes
from cirque.functions.scans import SEGMENT, SPAN, carried, cut, inside

from .intervals import nearest_sides, relate


def islands(genes: DataFrame, gap: int, span: int = SPAN) -> DataFrame:
    """``genes`` with island, the number of the run on their circle of genes that follow each other within ``gap``, and their place in it, _s and _l.

    Segments of ``span`` bases are scanned apart: how far earlier genes reach, and how many runs they end, is carried in.
    """
    n, place = F.col("len"), ["assembly", "replicon"]
    x = genes.withColumn("_l", arc_length(F.col("start_bound"), F.col("end_bound"), n)).withColumn("_s", F.pmod(F.col("start_bound"), n))
    x = carried(cut(x, F.col("_s"), span), place, {"r": (F.max, F.col("_s") + F.col("_l"))})
    # what reaches over the origin comes before the first gene
    over = F.col("r_whole") - n
    x = x.withColumn("_reach", F.greatest(over, F.col("r_before"), F.max(F.col("_s") + F.col("_l")).over(inside(place, "_s", "_l", strict=True))))
    x = x.withColumn("_break", F.when(F.col("_s") - F.col("_reach") > gap, 1).otherwise(0))
    x = x.select(*genes.columns, "_l", "_s", SEGMENT, "_break")  # in one exchange by place and segment with what follows
    x = carried(x, place, {"k": (F.sum, F.col("_break"))})
    x = x.withColumn("_k", F.coalesce("k_before", F.lit(0)) + F.sum("_break").over(inside(place, "_s", "_l"))).withColumn("_last", F.col("k_whole"))
    wraps = (F.col("_k") == 0) & (F.col("_last") > 0)  # the first run continues the last one
    x = x.withColumn("island", F.when(wraps, F.col("_last")).otherwise(F.col("_k"))).withColumn("_s", F.when(wraps, F.col("_s") + n).otherwise(F.col("_s")))
    return x.select(*genes.columns, "island", "_s", "_l")


def apart(al, ac, bl, bc, n):
    """Twice the distance of two arcs from their lengths and doubled centres; negative where they overlap."""
    m = F.pmod(bc - ac, n * 2)
    return F.least(m, n * 2 - m) - al - bl


def chain_candidates(sites: DataFrame, genes: DataFrame, reach: int, lead: int, gap: int, span: int = SPAN) -> DataFrame:
    """Pairs of a site and each gene of the islands within ``lead`` of it, with rel, distance and the gene's _bl and _bc: no chain goes beyond those."""
    place, n = ["assembly", "replicon"], F.col("len")
    runs = held(islands(genes, gap, span))
    spans = runs.groupBy(*place, "len", "island").agg(F.min("_s").alias("start_bound"), F.max(F.col("_s") + F.col("_l")).alias("_end"))
    spans = spans.select(*place, "len", "island", "start_bound", F.least("_end", F.col("start_bound") + n).alias("end_bound"), F.lit("Other").alias("strand"))
    near = relate(sites, spans, lead, ["island"]).drop("rel", "distance", "r_start_bound", "r_end_bound")
    members = runs.select(*place, F.col("island").alias("r_island"), F.col("start_bound").alias("r_start_bound"), F.col("end_bound").alias("r_end_bound"), F.col("strand").alias("r_strand"))
    pairs = near.join(members, [*place, "r_island"])  # sizes are not sent, as bounds give them
    pairs = with_sizes(with_sizes(pairs, "_a", F.col("start_bound"), F.col("end_bound"), n), "_b", F.col("r_start_bound"), F.col("r_end_bound"), n)
    pairs = pairs.where(apart(F.col("_al"), F.col("_ac"), F.col("_bl"), F.col("_bc"), n) <= 2 * reach)
    return with_sized_relation(pairs, "_a", "_b", F.col("strand"), n).drop("r_island")


def predict_operons(sites: DataFrame, features: DataFrame, reach: int = 40_000, lead: int = 100, gap: int = 40, span: int = SPAN) -> DataFrame:
    """A row for each site and gene of its operon: site columns, r_strand, r_start_bound, r_end_bound.

    Genes beside a site chain outward on each side while they keep the first one's strand and follow within ``gap``;
    the first must lie within ``lead``. Overlapping genes lead the side whose nearest neighbour has their strand, or
    form a chain of their own. A chain goes if the site lies behind its first gene and nothing bridges the two.

    Chains cannot leave the runs of genes near a site, so those and the nearest neighbours are all that is joined. Runs and
    neighbours are found in segments of ``span`` bases.
    """
    place = ["assembly", "replicon", "len", "start_bound", "end_bound", "strand"]
    return operons_of(sites, held(dedupe_features(keep_coding_features(features)).select(*place)), reach, lead, gap, span)


def operons_of(sites: DataFrame, genes: DataFrame, reach: int = 40_000, lead: int = 100, gap: int = 40, span: int = SPAN) -> DataFrame:
    """``predict_operons`` from coding features that are one for each place already; they are read several times."""
    n, mine = F.col("len"), F.col("r_strand")
    site = ["site_id", "assembly", "replicon", "len", "strand", "start_bound", "end_bound"]
    genes, sites = genes.select("assembly", "replicon", "len", "start_bound", "end_bound", "strand"), held(sites.select(*site))
    pairs = chain_candidates(sites, genes, reach, lead, gap, span)
    # whether the site lies on a gene's 3' side, judged from the gene
    pairs = with_sized_relation(pairs, "_b", "_a", mine, n, "seen", "_seen").withColumn("behind", F.col("seen").isin("3O", "3N")).drop("seen", "_seen", "_al", "_ac")
    strands = held(neighbour_strands(sites, genes, reach, span))  # so that the exchange of neighbours is gone before that of chains
    # all that follows is by site: lists are windows within one exchange
    pairs = pairs.repartition("site_id").join(strands, "site_id", "left").withColumns({"s5": F.coalesce("s5", F.lit("Other")), "s3": F.coalesce("s3", F.lit("Other"))})
    over = ~F.col("rel").isin("5N", "3N")
    # each pair is put to all three lists and taken by those it belongs to: a function on arrays would leave generated code
    first, s5, s3 = F.col("list"), F.col("s5"), F.col("s3")
    taken = (
        ((first == "5") & ((F.col("rel") == "5N") | (over & (mine == s5)))) | ((first == "3") & ((F.col("rel") == "3N") | (over & (mine == s3))))
        | ((first == "E") & over & (mine != s5) & (mine != s3))
    )
    long = pairs.withColumn("list", F.explode(F.array(F.lit("5"), F.lit("3"), F.lit("E")))).where(taken).withColumn("over", over).drop("s5", "s3", "rel")
    sign = F.when(F.col("list") == "E", -1).otherwise(1)  # overlapping genes stand before the neighbours; by themselves, last first
    w = Window.partitionBy("site_id", "list").orderBy(F.when(F.col("over"), 0).otherwise(1), "distance", F.col("r_start_bound") * sign, F.col("r_end_bound") * sign)
    long = long.withColumns({"_pl": F.lag("_bl").over(w), "_pc": F.lag("_bc").over(w), "pos": F.row_number().over(w), "lead_strand": F.first("r_strand").over(w), "lead_distance": F.first("distance").over(w)})
    link = apart(F.col("_pl"), F.col("_pc"), F.col("_bl"), F.col("_bc"), n) > 2 * gap
    broken = F.when((F.col("lead_distance") > lead) | (mine != F.col("lead_strand")) | (F.col("_pl").isNotNull() & link), 1).otherwise(0)
    chains = long.withColumn("breaks", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("breaks = 0")
    by = Window.partitionBy("site_id")
    head = lambda s: F.max(F.when((F.col("list") == s) & (F.col("pos") == 1), F.struct(F.col("_bl").alias("l"), F.col("_bc").alias("c"), F.col("behind").alias("end")))).over(by)
    chains = chains.withColumns({"h5": head("5"), "h3": head("3")})
    end5, end3 = F.coalesce("h5.end", F.lit(False)), F.coalesce("h3.end", F.lit(False))
    gap_big = F.coalesce(apart(F.col("h5.l"), F.col("h5.c"), F.col("h3.l"), F.col("h3.c"), n) > 2 * gap, F.lit(True))
    drop5 = end5 & (F.col("h3").isNull() | gap_big | end3)
    drop3 = end3 & (F.col("h5").isNull() | gap_big | end5)
    kept = chains.where(((F.col("list") == "5") & ~drop5) | ((F.col("list") == "3") & ~drop3) | (F.col("list") == "E"))
    return kept.select(*site, "r_strand", "r_start_bound", "r_end_bound").dropDuplicates(["site_id", "r_start_bound", "r_end_bound"])


def neighbour_strands(sites: DataFrame, genes: DataFrame, reach: int, span: int = SPAN) -> DataFrame:
    """(site_id, s5, s3): strands of the nearest gene on each side of a site."""
    near = nearest_sides(sites, genes, reach, span)
    strand = lambda side: F.max(F.when(F.col("side") == side, F.col("r_strand")))  # noqa: E731  one row for a side
    return near.groupBy("site_id").agg(strand("5N").alias("s5"), strand("3N").alias("s3"))


def _operon_of() -> list:
    """Aggregates of a site's genes that make its operon."""
    return [
        F.min("r_start_bound").alias("o_start_bound"), F.max(F.struct("r_start_bound", "r_end_bound"))["r_end_bound"].alias("o_end_bound"),
        F.when(F.min("r_strand") == F.max("r_strand"), F.min("r_strand")).otherwise("Other").alias("o_strand"), F.count("*").alias("n_genes"),
    ]


def build_operons(site_genes: DataFrame) -> DataFrame:
    """The operon of each site: from the least gene start to the end of the gene that starts last."""
    return site_genes.groupBy("site_id", "assembly", "replicon", "len").agg(*_operon_of())


def distinct_operons(operons: DataFrame) -> DataFrame:
    key = ["assembly", "replicon", "len", "o_strand", "o_start_bound", "o_end_bound"]
    return operons.groupBy(*key).agg(F.max("n_genes").alias("n_genes"))


def classify_sites(sites: DataFrame, site_genes: DataFrame) -> DataFrame:
    """site_id, site_type, site_class, class_distance and n_genes of every site."""
    n, site = F.col("len"), (F.col("start_bound"), F.col("end_bound"))
    near = with_relation(site_genes, (*site, F.col("strand")), (F.col("r_start_bound"), F.col("r_end_bound")), n)
    near = near.groupBy("site_id").agg(F.min(F.struct("distance", "r_start_bound", "r_end_bound", "r_strand")).alias("g"), *_operon_of())
    near = near.select("site_id", "g.r_start_bound", "g.r_end_bound", "g.r_strand", "o_start_bound", "o_end_bound", "o_strand", "n_genes")
    x = sites.join(near, "site_id", "left")
    x = with_relation(x, (F.col("r_start_bound"), F.col("r_end_bound"), F.col("r_strand")), site, n, "g_rel", "g_distance")
    x = with_relation(x, (F.col("o_start_bound"), F.col("o_end_bound"), F.col("o_strand")), site, n, "o_rel", "o_distance")
    arc = lambda p: F.col(f"{p}start_bound") * 2 + F.pmod(F.col(f"{p}end_bound") - F.col(f"{p}start_bound"), F.col("len"))
    side = orientation(arc("o_"), arc(""), F.col("len"), F.col("o_strand"))
    many = F.when(F.col("n_genes") > 1, "m").otherwise("")
    none = F.col("n_genes").isNull()
    kind = F.when(none, "Exterior").when(F.col("g_rel").isin("5O", "3O"), "Boundary").when(F.col("g_rel").isin("5N", "3N"), "Exterior").otherwise("Interior")
    stranded = F.col("o_strand").isin("Forward", "Reverse")
    a = F.col("o_rel").isin("5O", "5N") | (~stranded & F.col("g_rel").isin("5O", "5N"))
    label = F.when(none, "D").when(a, "A").when(stranded & (side > 0), F.concat(F.lit("C"), many)).when(stranded, F.concat(F.lit("B"), many)).otherwise("-")
    distance = F.when(none | ~a, None).when(F.col("o_rel").isin("5O", "5N"), F.col("o_distance")).otherwise(F.col("g_distance"))
    return x.select("site_id", "assembly", "replicon", kind.alias("site_type"), label.alias("site_class"), distance.alias("class_distance"), F.coalesce("n_genes", F.lit(0)).cast("long").alias("n_genes"))


def genes_of(site_genes: DataFrame) -> DataFrame:
    """The different genes of operons as features, for ``hit_types``; type and order are the same for all, as ``site_associations`` asks for places only."""
    own = site_genes.select("assembly", "replicon", "len", F.col("r_start_bound").alias("start_bound"), F.col("r_end_bound").alias("end_bound"), F.col("r_strand").alias("strand")).distinct()
    return own.withColumns({"feature_type": F.lit("CDS"), "ord": F.lit(0).cast("long")})


def site_associations(site_genes: DataFrame, linked: DataFrame) -> DataFrame:
    """site_id and assoc: the hit types of the operon's genes; ``linked`` are features with assoc."""
    f = linked.select("assembly", "replicon", F.col("start_bound").alias("r_start_bound"), F.col("end_bound").alias("r_end_bound"), F.explode("assoc").alias("type")).distinct()
    return site_genes.join(f, ["assembly", "replicon", "r_start_bound", "r_end_bound"]).groupBy("site_id").agg(F.array_sort(F.collect_set("type")).alias("assoc"))


def _as_place(operons: DataFrame) -> DataFrame:
    return operons.select("assembly", "replicon", "len", F.col("o_strand").alias("strand"), F.col("o_start_bound").alias("start_bound"), F.col("o_end_bound").alias("end_bound"), "n_genes")


def valid_regulators(operons: DataFrame, sites: DataFrame, radius: int = 200) -> DataFrame:
    """Pairs of distinct operon and site that may regulate it."""
    got = relate(_as_place(operons), sites, radius, ["site_id"])
    return got.where(~F.col("strand").isin("Forward", "Reverse") | ~F.col("rel").isin("3N", "3O"))


def orphans(features: DataFrame, operons: DataFrame, sites: DataFrame, kind: str = "CopY", radius: int = 100) -> DataFrame:
    """Coding features with hit type ``kind`` that touch no operon and have no site that could regulate them."""
    key = ["assembly", "replicon", "start_bound", "end_bound"]
    wanted = dedupe_features(keep_coding_features(features)).where(F.array_contains("assoc", kind))
    touching = relate(wanted, _as_place(operons), 0, []).select(*key).distinct()
    governed = relate(wanted, sites, radius, []).where(~F.col("rel").isin("3N", "3O")).select(*key).distinct()
    return wanted.join(touching, key, "left_anti").join(governed, key, "left_anti")
