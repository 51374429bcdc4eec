import random

import pytest
from pyspark.sql import functions as F

from cirque.functions.geometry import with_sizes
from cirque.operators import intervals as J

ARC = "assembly string, replicon string, len long, strand string, start_bound long, end_bound long, id long"


def arcs(spark, seed, count, lengths):
    rng, rows = random.Random(seed), []
    for i in range(count):
        replicon, n = rng.choice([("a", 400_000), ("b", 160_000), ("c", 90), ("d", 20_000)])
        size, start = min(rng.choice(lengths), n), rng.randrange(n)
        end = start + size if rng.random() < 0.5 or start + size <= n else (start + size) % n
        rows.append(("g", replicon, n, rng.choice(["Forward", "Reverse"]), start, end, i))
    return spark.createDataFrame([*rows, *(("g", r, n, "Forward", 0, n, 10_000 + n) for r, n in (("a", 400_000), ("b", 160_000), ("c", 90), ("d", 20_000)))], ARC)


@pytest.mark.parametrize("radius", [0, 700])
def test_levels_give_the_pairs_of_plain_bins(spark, radius):
    left, right = arcs(spark, 1, 200, [0, 16, 900, 30_000, 200_000, 400_000]), arcs(spark, 2, 150, [1, 300, 2_000, 19_000, 150_000])
    found = lambda **how: sorted(map(tuple, J.relate(left, right, radius, ["id"], **how).select("id", "r_id", "rel", "distance").collect()))
    want = found(size=1 << 30)
    assert len(want) > 500 and len(set(want)) == len(want)
    for size in (100, 1_000, 20_000):
        assert found(size=size) == want and found(size=size, long_left=True) == want


def test_an_arc_takes_few_bins(spark):
    rows = with_sizes(arcs(spark, 3, 500, [0, 16, 900, 30_000, 200_000, 400_000]), "_a", F.col("start_bound"), F.col("end_bound"), F.col("len")).withColumn("_s", F.pmod("start_bound", "len"))
    own = J.placed(rows, "_s", "_al", 1_000, True).groupBy("id", (F.col("_s") + F.col("_al") >= F.col("len")).alias("over")).count()
    assert own.select("id").distinct().count() == 504
    assert own.agg(F.max("count")).first()[0] <= 3 and own.where("not over").agg(F.max("count")).first()[0] <= 2


def test_a_level_is_not_worked_out_again_in_a_filter(spark):
    both = J.relate(arcs(spark, 1, 5, [16]), arcs(spark, 2, 5, [300]), 0, ["id"], long_left=True)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "10240000 <" in line]


def test_hit_types_are_those_of_linked_features(spark):
    features = arcs(spark, 5, 60, [16, 900, 30_000]).withColumnsRenamed({"id": "ord"}).withColumn("feature_type", F.lit("CDS"))
    hits = arcs(spark, 6, 40, [300, 2_000]).withColumn("assoc_type", F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))).where("id < 40")
    key = ["replicon", "start_bound", "end_bound", "ord", "assoc"]
    want = J.link_hits(features, hits).where("assoc is not null").select(*key).collect()
    assert len(want) > 20 and sorted(J.hit_types(features, hits, ("len", "strand")).select(*key).collect()) == sorted(want)


@pytest.mark.parametrize("lengths", [[0, 300, 2_000], [0]])
def test_hit_genomes_are_those_of_hit_types(spark, lengths):
    features = arcs(spark, 7, 60, [16, 900, 30_000]).withColumnsRenamed({"id": "ord"}).withColumn("feature_type", F.lit("CDS")).where("replicon <> 'b' or ord < 10000")
    features = features.withColumn("assembly", F.concat(F.lit("g"), "replicon"))
    hits = arcs(spark, 8, 40, lengths).withColumn("assoc_type", F.when(F.col("id") % 5 > 0, F.concat("replicon", (F.col("id") % 3).cast("string")))).where("id < 40").withColumn("assembly", F.concat(F.lit("g"), "replicon"))
    want = J.hit_types(features, hits).select("assembly", F.explode("assoc").alias("t")).groupBy("assembly").agg(F.array_sort(F.collect_set("t")).alias("assoc"))
    assert sorted(map(tuple, J.hit_genomes(features, hits).collect())) == sorted(map(tuple, want.collect()))
