import pytest

from cirque.operators import catalog as A


def lines(spark, pairs):
    return spark.createDataFrame(pairs, "tax_id long, parent_id long")


def test_lineage_of_a_deep_chain(spark, monkeypatch):
    rounds = []
    keep = A.held
    monkeypatch.setattr(A, "held", lambda df: rounds.append(1) or keep(df))
    nodes = lines(spark, [(1, 1)] + [(i, i - 1) for i in range(2, 1001)])
    got = A.lineage(spark.createDataFrame([(1000,), (3,), (1000,), (5000,), (None,)], "tax_id long"), nodes).collect()
    assert sorted((r.node, r.up) for r in got if r.tax_id == 1000) == [(i, 1000 - i) for i in range(1, 1001)]
    assert sorted((r.node, r.up) for r in got if r.tax_id == 3) == [(1, 2), (2, 1), (3, 0)]
    assert [(r.node, r.up) for r in got if r.tax_id == 5000] == [(5000, 0)] and [r.node for r in got if r.tax_id is None] == [None]
    assert (len(rounds) - 1) / 2 <= 12


def test_lineage_of_a_wide_tree(spark):
    nodes = lines(spark, [(1, None), (2, 1), (3, 1)] + [(i, 2 + i % 2) for i in range(10, 400)])
    got = A.lineage(nodes.where("tax_id >= 10").select("tax_id"), nodes).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, u) for i in range(10, 400) for n, u in ((i, 0), (2 + i % 2, 1), (1, 2)))


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        A.lineage(spark.createDataFrame([(1,)], "tax_id long"), lines(spark, [(1, 2), (2, 3), (3, 1), (9, 9)]))


def test_no_nodes(spark):
    got = A.lineage(spark.createDataFrame([(1,)], "tax_id long"), lines(spark, []))
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0)]


def test_names(spark):
    nodes = spark.createDataFrame([(1, 1, "root"), (2, 1, "cells"), (3, 2, "a"), (4, 3, "b")], "tax_id long, parent_id long, name string")
    got = A.lineage_name(spark.createDataFrame([(4,), (3,), (2,), (1,)], "tax_id long"), nodes).collect()
    assert {r.tax_id: r.lineage for r in got} == {4: "a / b", 3: "a", 2: "", 1: ""}
