from pathlib import Path

import duckdb
import pytest

from cirque.functions.frames import shared_folder
from cirque.plans import queries as Q
from cirque.plans import round_trips  # noqa: F401

QUICK = ["j3_link_hits", "j4_within_radius", "o4_classify_sites", "a5_intergenic_space", "a10_source_comparison", "u1_union_catalogs", "u3_unique_assemblies", "j11_verify_md5", "j13_lineage_name", "p20_filter_hits", "t3_top_targets", "m3_scan_motif", "m3_scan_words",
         "j1_attach_metadata", "j6_nearest_neighbors", "j10_unmatched_assemblies", "j14_species_of", "a11_annotated_assemblies", "a12_md5_report", "u2_source_differences", "k3_catalog_annotation", "o6_operon_table", "p11_vectors",
         "s1_catalog_round_trip", "s2_fasta_round_trip", "s4_hits_round_trip", "s5_taxonomy_round_trip", "s7_listed_files", "a11_inventory_round_trip", "k4_merged_corpus", "a2_replicon_sketches"]


@pytest.fixture(scope="module")
def other(small):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, small, other, name):
    got = Q.queries()[name](spark, small)
    want = other.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["a13_density_by_association", "u4_species_with_type", "a3_genome_associations"])
def test_densities_ask_for_no_operons(spark, small, other, monkeypatch, name):
    def asked(*_, **__):
        raise AssertionError("operons are not part of the result")

    for f in ("predict_operons", "orphans"):
        monkeypatch.setattr(Q.O, f, asked)
    monkeypatch.setattr(Q.J, "hit_types", asked)
    test_same_as_sql(spark, small, other, name)


@pytest.mark.parametrize("name", ["a8_genome_report", "o6_orphan_table", "a8_genome_summary", "j8_orphans"])
def test_orphans_ask_for_their_hits_only(spark, small, other, monkeypatch, name):
    """Coding features, one for each place, meet hits of the orphans' type; not each feature meets every hit."""
    asked, whole = [], Q.J.hit_types
    monkeypatch.setattr(Q.J, "hit_types", lambda features, hits, *more: (asked.append((features, hits)), whole(features, hits, *more))[1])
    test_same_as_sql(spark, small, other, name)
    ((features, hits),) = asked
    assert {r.assoc_type for r in hits.select("assoc_type").distinct().collect()} == {"CopY"}
    assert {r.feature_type for r in features.select("feature_type").distinct().collect()} <= {"CDS", "tRNA", "Pseudogene"}
    assert features.count() == features.select("assembly", "replicon", "start_bound", "end_bound").distinct().count()


@pytest.mark.parametrize("name", ["o6_site_table", "a6_site_counts"])
def test_operons_leave_nothing_behind(spark, small, other, name):
    """When sites are classified the disk holds tiles, replicons, sites and genes of operons: no shuffle file, and not what these were made from."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")) | set(folder.glob("held_*"))
    before = files()
    Q.queries()[name](spark, small)
    left = files() - before
    assert len(left) <= 4 and not [x for x in left if x.name.startswith("shuffle_")]
    test_same_as_sql(spark, small, other, name)


def test_hits_meet_genes_of_operons_only(spark, small, other, monkeypatch):
    asked, whole = [], Q.J.hit_types
    monkeypatch.setattr(Q.J, "hit_types", lambda features, hits, *more: (asked.append(features), whole(features, hits, *more))[1])
    test_same_as_sql(spark, small, other, "o5_site_associations")
    place = ["replicon", "start_bound", "end_bound"]
    want = {(r.replicon, r.r_start_bound, r.r_end_bound) for r in Q._site_genes(spark, small).select("replicon", "r_start_bound", "r_end_bound").collect()}
    got = [tuple(r) for r in asked[0].select(*place).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_words_of_whole_sequences(spark, small):
    from cirque.operators import motifs as M
    from cirque.plans.adapters import view

    hit = next(r.word for r in M.expand_motif(spark).limit(1).collect())
    seqs = ["C" * 40 + hit + "C" * 9, "ACGT" * 3, "ACGT" * 4, None, ""]
    brute = {s[i : i + 16] for s in seqs if s for i in range(len(s) - 15)}
    for tile in (1, 7, 50, M.TILE):
        assert sorted(r.word for r in M.words_of(spark.createDataFrame([(s,) for s in seqs], "seq string"), 16, tile).collect()) == sorted(brute)
    assert hit in brute
    texts = [r.seq for r in view(spark, small, "ad_sequences").where("doc_id < 20").collect()]
    every = {s[i : i + 16] for s in texts if s for i in range(len(s) - 15)}
    got = Q.queries()["m1_expand_motif"](spark, small)
    mine = got.join(spark.createDataFrame([(w,) for w in every], "word string"), "word", "left_semi").collect()
    motif = {r.word for r in M.expand_motif(spark).collect()}
    assert {r.word for r in mine} == every and all(r.in_motif == (r.word in motif) for r in mine)


def test_words_are_not_shuffled_for_the_motif(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.queries()["m1_expand_motif"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_contents_are_hashed_apart(spark, small, monkeypatch):
    plans, lines = [], round_trips._lines
    monkeypatch.setattr(round_trips, "_lines", lambda df, *more: (plans.append(df._jdf.queryExecution().toString()), lines(df, *more))[1])
    assert round_trips.a11_inventory_round_trip(spark, small).count() == 24
    hashed = [p for p in plans if "md5" in p]
    assert hashed and not any("Coalesce 1" in p or "Repartition 1," in p for p in hashed)
