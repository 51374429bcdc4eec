import random
import re

from cirque.operators import intervals as J
from cirque.operators import operons as O
from cirque.operators import summary as S

FEATURE = "assembly string, replicon string, len long, strand string, start_bound long, end_bound long, feature_type string, ord long"


def crowded(spark):
    """Nine of ten features on one replicon, some over the origin and some nested, and sites between them."""
    rng = random.Random(6)
    rows, sites = [], []
    for replicon, n, count in (("big", 400_000, 900), ("small", 90_000, 60), ("tiny", 5_000, 20), ("bare", 300_000, 3)):
        at = 0
        for k in range(count):
            at += rng.choice([5, 30, 45, 60, 300, n // count])
            size = rng.choice([40, 300, 900, 3000])
            start = at % n
            end = start + size if start + size <= n or rng.random() < 0.5 else (start + size) % n
            rows.append(("g", replicon, n, rng.choice(["Forward", "Reverse"]), start, end, rng.choice(["CDS", "CDS", "tRNA", "Pseudogene"]), k))
            sites += [("g", replicon, n, rng.choice(["Forward", "Reverse"]), p := (start + rng.randrange(-200, size + 200)) % n, p + 16)] if k % 2 else []
            at += size
    sites = [(i, *s) for i, s in enumerate(sites)]
    return spark.createDataFrame(rows, FEATURE), spark.createDataFrame(sites, "site_id long, assembly string, replicon string, len long, strand string, start_bound long, end_bound long")


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_segments_give_what_whole_replicons_give(spark):
    features, sites = crowded(spark)
    features, sites = features.cache(), sites.cache()
    whole = 1 << 40
    for f in (lambda span: S.intergenic_space(features, span), lambda span: O.predict_operons(sites, features, span=span), lambda span: J.nearest_neighbors(sites, features, 2_000, span)):
        want = rows_of(f(whole))
        assert want and rows_of(f(1_000)) == want and rows_of(f(33_333)) == want


def test_gaps_by_plain_loop(spark):
    features, _ = crowded(spark)
    gaps = 0
    for replicon in ("big", "small", "tiny", "bare"):
        own = sorted({(r.start_bound, r.end_bound): r for r in features.where(f"replicon = '{replicon}' and feature_type <> 'Pseudogene'").collect()})
        n = {"big": 400_000, "small": 90_000, "tiny": 5_000, "bare": 300_000}[replicon]
        for (a, b), (c, d) in zip(own, own[1:], strict=False):
            la, lb = ((b - a) % n or n), ((d - c) % n or n)
            m = (2 * c + lb - 2 * a - la) % (2 * n)
            gaps += max(0, (min(m, 2 * n - m) - la - lb) // 2)
    assert S.intergenic_space(features, 5_000).first().gap_total == gaps


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_genes_cross_once_where_they_are_scanned(spark):
    """Both lanes of neighbours, gaps and the features at one place, and a site's lists are each read from one exchange."""
    features, sites = crowded(spark)
    for f, other in ((lambda: J.nearest_sides(sites, features, 2_000), r"lane#"), (lambda: S.intergenic_space(features), r"start_bound#"), (lambda: O.predict_operons(sites, features), r"list#")):
        assert not re.search(r"hashpartitioning\([^)]*" + other, plan_of(f()))


def test_features_of_long_circles_are_not_ranked(spark, monkeypatch):
    """All features in reach are listed on circles only so short that the two sides meet."""
    features, sites = crowded(spark)
    listed, whole = [], J.relate
    monkeypatch.setattr(J, "relate", lambda left, right, *more, **how: (listed.append({r.replicon for r in right.select("replicon").collect()}), whole(left, right, *more, **how))[1])
    J.nearest_sides(sites, features, 2_000)
    assert listed == [{"tiny"}]
