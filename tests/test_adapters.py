import re

import duckdb
import pytest

from cirque.plans import queries as Q
from cirque.plans.adapters import VIEWS, keyed, view, with_views


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["j4_bubble", "j5_relate_pairs", "j4_within_radius"])
def test_no_event_meets_every_replicon(spark, small, name):
    plan = plan_of(Q.queries()[name](spark, small))
    loops = re.findall(r"\(\d+\) (?:BroadcastNestedLoopJoin|CartesianProduct).*?Join condition: ([^\n]*)", plan, re.S)
    assert loops and not any(re.search("replicon#|len#", x) for x in loops)  # events take the count of suppliers, and nothing else


def test_only_the_spark_dialect_is_keyed():
    for name in ("ad_sites", "ad_hits"):
        assert keyed(VIEWS[name]) != VIEWS[name]
        assert VIEWS[name].strip() in with_views(name) and VIEWS[name].strip() not in with_views(name, dialect="spark")


def test_views_do_not_order_lineitem_again(spark, small):
    replicons = Q._replicons(spark, small)
    for name in ("ad_sites", "ad_hits"):
        got = view(spark, small, name, replicons)
        assert "lineitem" not in plan_of(got) and got.exceptAll(view(spark, small, name)).isEmpty()


def test_lineitem_is_ordered_once(spark, small):
    plan = plan_of(view(spark, small, "ad_placed"))
    assert plan.count("Scan parquet") <= 4 and len(re.findall(r"\(\d+\) Sort\n", plan)) <= 2  # of each listed twice: lineitem, and supplier if it is not broadcast
    genomes = Q._genomes(spark, small)
    for name in ("ad_features", "ad_replicons", "ad_sites", "ad_hits"):
        assert "lineitem" not in plan_of(view(spark, small, name, **genomes))


def test_tiles_give_the_features_of_the_sql(spark, small):
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name in ("ad_features", "ad_replicons"):
        got = view(spark, small, name, **Q._genomes(spark, small))
        want = con.execute(f"{with_views(name)} SELECT {', '.join(got.columns)} FROM {name}").fetchall()
        assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
