import math
import random

import pytest
from pyspark.sql import functions as F

from cirque.functions import features as P
from cirque.functions import geometry as G
from cirque.operators import motifs as M


def relation(spark, rows):
    df = spark.createDataFrame(rows, "i int, n long, s1 long, e1 long, t1 string, s2 long, e2 long")
    rel = G.spatial_relation((F.col("s1"), F.col("e1"), F.col("t1")), (F.col("s2"), F.col("e2")), F.col("n"))
    return [(r.r.rel, r.r.distance) for r in df.select("i", rel.alias("r")).orderBy("i").collect()]


def test_known_relations(spark):
    rows = [
        (0, 2160842, 1083880, 1089895, "Forward", 1078628, 1082279), (1, 2160842, 1083880, 1089895, "Forward", 1108257, 1110717), (2, 2160842, 1922124, 1922997, "Reverse", 2012332, 2010867),
        (3, 2160842, 2012332, 2010867, "Forward", 1922124, 1922997), (4, 100, 10, 20, "Forward", 20, 30), (5, 100, 10, 20, "Forward", 10, 20), (6, 100, 95, 5, "Forward", 2, 8), (7, 100, 95, 5, "Reverse", 2, 8),
        (8, 100, 0, 80, "Forward", 50, 20),
    ]
    assert relation(spark, rows) == [("5N", 1601), ("3N", 18362), ("CO", 0), ("EB", 0), ("3N", 0), ("PE", 0), ("3O", 0), ("5O", 0), ("CG", 0)]


def test_rotation_and_mirror(spark):
    rng = random.Random(1)
    base = []
    for _ in range(150):
        n = rng.randrange(60, 400)
        (s1, l1), (s2, l2) = ((rng.randrange(n), rng.randrange(1, 25)) for _ in "ab")
        base.append((n, s1, l1, s2, l2, rng.randrange(n)))
    row = lambda i, n, s1, l1, s2, l2, k, t: (i, n, (s1 + k) % n, (s1 + k + l1) % n, t, (s2 + k) % n, (s2 + k + l2) % n)
    plain = relation(spark, [row(i, n, s1, l1, s2, l2, 0, "Forward") for i, (n, s1, l1, s2, l2, k) in enumerate(base)])
    assert plain == relation(spark, [row(i, n, s1, l1, s2, l2, k, "Forward") for i, (n, s1, l1, s2, l2, k) in enumerate(base)])
    swap = {"5N": "3N", "3N": "5N", "5O": "3O", "3O": "5O"}
    mirror = relation(spark, [row(i, n, s1, l1, s2, l2, 0, "Reverse") for i, (n, s1, l1, s2, l2, k) in enumerate(base)])
    opposite = {i for i, (n, s1, l1, s2, l2, k) in enumerate(base) if (2 * s2 + l2 - 2 * s1 - l1) % n == 0}
    assert all(i in opposite or m == (swap.get(p[0], p[0]), p[1]) for i, (p, m) in enumerate(zip(plain, mirror, strict=True)))


def test_lengths_and_vectors(spark):
    row = spark.range(1).select(
        G.arc_length(F.lit(2159999), F.lit(2572), F.lit(2160842)).alias("a"), G.arc_length(F.lit(0), F.lit(50), F.lit(50)).alias("b"), G.feature_length(F.lit(90), F.lit(10), F.lit(100)).alias("c"),
        G.vec_angle(G.unit_vector(F.lit(0), F.lit(100)), G.unit_vector(F.lit(25), F.lit(100))).alias("d"), G.search_bubble(F.lit(5), F.lit(10), F.lit(1000), 20).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == (3415, 50, 20)
    assert abs(row.d - math.pi / 2) < 1e-12
    assert tuple(row.e) == (985, 30)


def test_sequences_and_motif(spark):
    seq = lambda x: spark.range(1).select(P.reverse_complement(F.lit(x)).alias("x")).first().x
    assert seq("ATGCACNNNNNATCG") == "CGATNNNNNGTGCAT"
    assert seq("NNNAAAYYYNNNGGGCCCAAATTTAAARRRUUUU") == "AAAAYYYTTTAAATTTGGGCCCNNNRRRTTTNNN"
    with pytest.raises(Exception, match="nucleotide"):
        seq("aacAdadcc129")
    words = [r.word for r in M.expand_motif(spark, "1X1XABCD", {"1": "ABC"}).orderBy("idx").collect()]
    assert len(words) == 9 and words[:2] == ["AXAXABCD", "AXBXABCD"]
    assert M.motif_words() == 32768 and abs(M.motif_expectation() - 7.62939453125e-06) < 1e-18


def test_scan_over_the_origin_and_tiles(spark):
    word = "ACTGACAAACGTCATT"[:16]
    text = "G" * 8
    word = "AATTACAAATGTAAAT"
    seq = word[10:] + text * 9 + word[:10]
    df = spark.createDataFrame([("a", seq), ("b", "ACGT"), ("c", None), ("d", "")], "replicon string, seq string")
    for tile in (7, 64, 1 << 18):
        got = M.scan_motif(df, tile=tile).where("strand = 'Forward'").collect()
        assert [(r.replicon, r.start_bound, r.end_bound, r.seq) for r in got] == [("a", len(seq) - 10, len(seq) + 6, word)]
