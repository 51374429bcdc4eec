"""Joins of intervals on circles: equi-joins on (replicon, bin) with the exact test, and nearest neighbours from one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirque.functions.frames import held
from cirque.functions.geometry import arc_length, search_bubble, with_sized_relation, with_sizes
from cirque.functions.scans import SEGMENT, SPAN

BIN = 20_000
PLACE = ["assembly", "replicon"]


def binned(df: DataFrame, start: str, span: str, size: Column) -> DataFrame:
    """``df`` with bin, a row for each bin of ``size`` bases that the arc of length ``span`` from ``start`` (0..n-1) touches.

    Bins are counted on past the origin, so that they are one run of numbers, and brought back afterwards. Each step is a column of its
    own: as one term the method made for it is too long for the JVM to compile.
    """
    at, n, last = F.col(start), F.col("len"), F.col("_end")
    x = df.withColumn("_size", size).withColumn("_end", at + F.col(span))
    x = x.withColumn("_whole", F.col(span) >= n).withColumn("_top", F.floor(n / F.col("_size")))
    x = x.withColumn("_from", F.when(F.col("_whole"), 0).otherwise(F.floor(at / F.col("_size"))))
    x = x.withColumn("_beyond", F.floor(F.when(last >= n, last - n).otherwise(last) / F.col("_size")))
    x = x.withColumn("_to", F.when(F.col("_whole"), F.col("_top")).when(last >= n, F.col("_top") + 1 + F.least(F.col("_beyond"), F.col("_from") - 1)).otherwise(F.col("_beyond")))
    x = x.withColumn("bin", F.explode(F.sequence("_from", "_to")))
    return x.withColumn("bin", F.when(F.col("bin") > F.col("_top"), F.col("bin") - F.col("_top") - 1).otherwise(F.col("bin"))).drop("_size", "_end", "_whole", "_top", "_from", "_beyond", "_to")


#: Bins of a level are 2^STEP times as wide as those of the level below; levels at most.
STEP, LEVELS = 3, 12


def width(level: Column, size: int) -> Column:
    """Bases of a bin of ``level``."""
    return F.lit(size).cast("long") * F.pow(F.lit(2), level * STEP).cast("long")


def level_of(span: Column, size: int) -> Column:
    """The first level on which a bin is as wide as ``span``; counted without functions on arrays, which would leave generated code."""
    out = F.lit(0)
    for level in range(LEVELS):
        out = out + (F.lit(size << (STEP * level)) < span).cast("int")
    return out


def placed(arcs: DataFrame, start: str, span: str, size: int, own: bool) -> DataFrame:
    """``arcs`` with level and bin, a row for each bin that an arc touches.

    With ``own`` these are the bins of its own level, the first on which a bin is as wide as the arc, so they are two at most, or three
    over the origin, whatever its length. Otherwise they are those of every level that its circle has.
    """
    n = F.col("len")
    top = level_of(n, size)
    # the own level is never null, so that a join on it asks no filter of it: that would be worked out from the plain columns again, term by term
    level = F.coalesce(F.least(level_of(F.col(span), size), top), F.lit(0)) if own else F.explode(F.sequence(F.lit(0), top))
    x = arcs.withColumn("level", level)
    return binned(x, start, span, width(F.col("level"), size))


def relate(left: DataFrame, right: DataFrame, radius: int, keep: list[str], size: int = BIN, overlap: bool = False, long_left: bool = False) -> DataFrame:
    """Pairs on one replicon that overlap or lie at most ``radius`` apart: columns of left, ``keep`` of right as r_*, rel and distance.

    With ``overlap`` only those that overlap; asking here is cheaper than a filter on rel.

    Both sides have assembly, replicon, len, strand, start_bound and end_bound. Of two arcs that meet, one holds the
    start of the other: a pair comes out of the bin of that start only, so no pair has to be deduplicated afterwards.

    ``long_left`` is for a left side some arcs of which span a replicon: a left arc then goes to the bins of its own level, three at most
    instead of one for each ``size`` bases, and the right side, which should be the smaller one, to bins of every level.
    """
    start, end, n = F.col("start_bound"), F.col("end_bound"), F.col("len")
    r = right.select(*PLACE, n, start, end, *(F.col(c).alias(f"r_{c}") for c in dict.fromkeys(keep) if c not in ("start_bound", "end_bound")))
    r = with_sizes(r, "_b", start, end, n).withColumn("_bs", F.pmod(start, n))
    x = with_sizes(left, "_a", start, end, n).withColumn("_as", F.pmod(start - radius, n)).withColumn("_wide", F.col("_al") + 2 * radius)
    if long_left:
        key, r, x = ["level", "bin"], placed(r, "_bs", "_bl", size, False), placed(x, "_as", "_wide", size, True)
    else:
        key, r, x = ["bin"], binned(r, "_bs", "_bl", F.lit(size)), binned(x, "_as", "_wide", F.lit(size))
    r = r.withColumnRenamed("start_bound", "r_start_bound").withColumnRenamed("end_bound", "r_end_bound").drop("len")
    m = F.pmod(F.col("_bc") - F.col("_ac"), n * 2)
    apart = F.least(m, n * 2 - m) - F.col("_al") - F.col("_bl")
    near = apart < 0 if overlap else apart <= 2 * radius
    at = F.when(F.pmod(F.col("_bs") - F.col("_as"), n) <= F.col("_wide"), F.col("_bs")).otherwise(F.col("_as"))
    wide = width(F.col("level"), size) if long_left else F.lit(size)
    both = x.join(r, [*PLACE, *key]).where(near & (F.floor(at / wide) == F.col("bin"))).drop(*key, "_as", "_bs", "_wide")
    return with_sized_relation(both, "_a", "_b", F.col("strand"), n).drop("_al", "_ac", "_bl", "_bc")


def within_radius(query: DataFrame, target: DataFrame, radius: int, keep: list[str]) -> DataFrame:
    """Pairs of ``query`` and those of ``target`` that overlap its bubble of ``radius``; rel is that of the target to the bubble."""
    bubble = search_bubble(F.col("start_bound"), F.col("end_bound"), F.col("len"), radius)
    wide = query.withColumn("_b", bubble).withColumns({"start_bound": F.col("_b.start_bound"), "end_bound": F.col("_b.end_bound")}).drop("_b")
    return relate(wide, target, 0, keep, overlap=True)


def hits_for_replicons(hits: DataFrame, replicons: DataFrame) -> DataFrame:
    """Hits with the assembly and length of the replicon that they lie on; hits on other sequences go."""
    return hits.join(replicons.select(*PLACE, "len"), "replicon")


#: What tells a feature from others.
FEATURE = [*PLACE, "start_bound", "end_bound", "feature_type", "ord"]


def hit_types(features: DataFrame, hits: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """FEATURE and ``more`` of the features that hits overlap, with assoc, the sorted set of their types; others have no row."""
    slim = features.select(*FEATURE, "len", "strand")
    return relate(slim, hits, 0, ["assoc_type"], overlap=True, long_left=True).groupBy(*FEATURE, *more).agg(F.array_sort(F.collect_set("r_assoc_type")).alias("assoc"))


def hit_genomes(features: DataFrame, hits: DataFrame) -> DataFrame:
    """(assembly, assoc): the sorted set of types of the hits that overlap a feature of each genome; without such a hit it has no row.

    A hit that has bases overlaps every feature that is its whole circle, as annotations hold one for each replicon, and needs no join with the
    others. Only for the rest of the hits are the features of their replicons joined.
    """
    n, start, end = F.col("len"), F.col("start_bound"), F.col("end_bound")
    slim = features.select(*PLACE, "len", "strand", "start_bound", "end_bound")
    whole = slim.where(arc_length(start, end, n) >= n).select(*PLACE).distinct().withColumn("_whole", F.lit(True))
    judged = hits.withColumn("_bases", arc_length(start, end, n)).join(whole, PLACE, "left")
    sure = F.coalesce(F.col("_whole") & (F.col("_bases") > 0), F.lit(False))
    rest = judged.where(~sure).drop("_whole", "_bases")
    near = relate(slim.join(rest.select(*PLACE).distinct(), PLACE, "left_semi"), rest, 0, ["assoc_type"], overlap=True, long_left=True)
    found = judged.where(sure).select("assembly", "assoc_type").unionByName(near.select("assembly", F.col("r_assoc_type").alias("assoc_type")))
    return found.where("assoc_type is not null").groupBy("assembly").agg(F.array_sort(F.collect_set("assoc_type")).alias("assoc"))


def link_hits(features: DataFrame, hits: DataFrame) -> DataFrame:
    """``features`` with assoc, the sorted set of hit types that overlap each; null where none does."""
    return features.join(hit_types(features, hits), FEATURE, "left")


def nearest_sides(sites: DataFrame, features: DataFrame, radius: int, span: int = SPAN) -> DataFrame:
    """(site_id, side, r_start_bound, r_end_bound, r_strand, distance): the nearest feature not overlapping on the 5' and on the 3' side of each site.

    Looking back, features stand at their end and sites at their start; looking ahead it is the other way round, and places count
    backwards. Both ways are two lanes of one order, in which the feature before a site is the nearest. Circles are cut into segments of
    ``span`` bases, the same for both lanes; a feature goes once to each segment within the radius, so segments need nothing of each other.
    Where a circle is so short that a feature within the radius may reach round to the other side, all features within the
    radius are ranked instead.
    """
    n, start, end, reach = F.col("len"), F.col("start_bound"), F.col("end_bound"), F.lit(radius).cast("long")
    longest = lambda df: df.groupBy(*PLACE).agg(F.max(arc_length(start, end, n)).alias("_longest"), F.max(n).alias("_n"))
    widest = longest(sites).unionByName(longest(features)).groupBy(*PLACE).agg((F.max("_n") <= F.sum("_longest") + 2 * radius).alias("_short"))
    widest = held(widest)
    judged = sites.select("site_id", *PLACE, n, "strand", start, end).join(widest, PLACE)
    short = judged.where("_short").drop("_short")
    back, ahead, none = F.pmod(start, n), F.pmod(-end, n), F.lit(None)
    lanes = F.explode(F.array(F.struct(F.lit(0).alias("lane"), back.alias("at"), F.floor(back / span).alias("part")), F.struct(F.lit(1).alias("lane"), ahead.alias("at"), F.floor((n - 1 - ahead) / span).alias("part")))).alias("x")
    site = judged.where("not _short").select("site_id", *PLACE, n, F.col("strand") == "Reverse", lanes).toDF("site_id", *PLACE, "len", "turned", "x")
    site = site.select(*PLACE, n, F.col("x.part").alias(SEGMENT), "x.lane", "x.at", "site_id", "turned", none.cast("long").alias("s"), none.cast("long").alias("e"), none.cast("string").alias("t"))
    # a gene goes once to each segment within the radius on either side; its lanes are made behind the exchange
    gene = features.select(*PLACE, n, start.alias("s"), end.alias("e"), F.col("strand").alias("t")).withColumn("_at", F.pmod(F.col("s") - 1 - reach, n))
    gene = binned(gene.withColumn("_wide", arc_length(F.col("s"), F.col("e"), n) + 2 * reach + 2), "_at", "_wide", F.lit(span))
    gene = gene.select(*PLACE, n, F.col("bin").alias(SEGMENT), none.cast("int").alias("lane"), none.cast("long").alias("at"), none.cast(sites.schema["site_id"].dataType).alias("site_id"), none.cast("boolean").alias("turned"), "s", "e", "t")
    x = site.unionByName(gene).repartition(*PLACE, SEGMENT).withColumn("is_site", F.col("lane").isNotNull())
    # behind the origin a feature stands that much before it
    back, ahead = F.pmod(F.col("e"), n), F.pmod(-F.col("s"), n)
    stand = lambda lane, at, when: F.when(when, F.struct(F.lit(lane).alias("lane"), at.alias("at")))
    own = F.when(F.col("is_site"), F.struct("lane", "at")).otherwise(F.struct(F.lit(0).alias("lane"), back.alias("at")))
    over = ~F.col("is_site")
    x = x.withColumn("x", F.explode(F.array(own, stand(1, ahead, over), stand(0, back - n, over & (back + reach >= n)), stand(1, ahead - n, over & (ahead + reach >= n))))).where("x is not null")
    x = x.select(*PLACE, n, SEGMENT, F.col("x.lane").alias("lane"), F.col("x.at").alias("at"), "site_id", "turned", "s", "e", "t", "is_site")
    first, last = F.greatest("at", F.lit(0)), F.least(F.col("at") + reach, n - 1)
    part = lambda at: F.floor(at / span)
    reached = F.when(F.col("lane") == 0, F.col(SEGMENT).between(part(first), part(last))).otherwise(F.col(SEGMENT).between(part(n - 1 - last), part(n - 1 - first)))
    # of features at one place the one of least start and end comes last
    w = Window.partitionBy(*PLACE, "lane", SEGMENT).orderBy("at", "is_site", F.col("s").desc(), F.col("e").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.where(F.col("is_site") | reached).withColumn("g", F.last(F.when(~F.col("is_site"), F.struct("at", "s", "e", "t")), True).over(w)).where("is_site")
    side = F.when((F.col("lane") == 0) == F.coalesce("turned", F.lit(False)), "3N").otherwise("5N")
    plain = x.select("site_id", side.alias("side"), F.col("g.s").alias("r_start_bound"), F.col("g.e").alias("r_end_bound"), F.col("g.t").alias("r_strand"), (F.col("at") - F.col("g.at")).alias("distance")).where(F.col("distance") <= radius)
    close = features.join(widest.where("_short").select(*PLACE), PLACE, "left_semi")
    ranked = relate(short, close, radius, ["strand"]).where(F.col("rel").isin("5N", "3N"))
    w = Window.partitionBy("site_id", "rel").orderBy("distance", "r_start_bound", "r_end_bound")
    ranked = ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("site_id", F.col("rel").alias("side"), "r_start_bound", "r_end_bound", "r_strand", "distance")
    return plain.unionByName(ranked)


def nearest_neighbors(sites: DataFrame, features: DataFrame, radius: int = 40_000, span: int = SPAN) -> DataFrame:
    """Overlapping features of each site and the nearest on its 5' and 3' sides: side, feature bounds, strand and distance."""
    over = relate(sites, features, 0, ["strand"], overlap=True)
    columns = ["r_start_bound", "r_end_bound", "r_strand", "distance"]
    return over.select("site_id", F.lit("overlap").alias("side"), *columns).unionByName(nearest_sides(sites, features, radius, span))
