import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cirque.operators import catalog as A
from cirque.plans.curation import curate, write_collection
from cirque.sources import readers as R
from cirque.sources import sinks as K


def entry(accession, name, link, level="Complete Genome"):
    return "\t".join([accession, "", "bio", "", "cat", "7", "7", "org", "inf", "", "", level, "", "", "", name, "", "", "", link, "st"])


@pytest.fixture
def collection(tmp_path):
    (tmp_path / "refseq.txt").write_text("header\n" + entry("GCF_1", "a", "https://x/GCF_1_a") + "\n" + entry("GCF_2", "b", "https://x/GCF_2_b", "Chromosome") + "\n" + entry("GCF_9", "z", "na") + "\n")
    (tmp_path / "genbank.txt").write_text("header\n" + entry("GCA_1", "a", "https://x/GCA_1_a") + "\n" + entry("GCA_3", "c", "https://x/GCA_3_c") + "\n" + entry("GCA_4", "d", "https://x/GCA_4_d", "Contig") + "\n")
    root = tmp_path / "db"

    def put(folder, names, manifest=None):
        (root / folder).mkdir(parents=True)
        lines = []
        for name in names:
            data = gzip.compress(f"{folder} {name}".encode(), mtime=0)
            (root / folder / f"{folder}{name}").write_bytes(data)
            lines.append(f"{hashlib.md5(data).hexdigest()}  ./{folder}{name}")
        if manifest is not None:
            (root / folder / "md5checksums.txt").write_text("\n".join(manifest(lines)) + "\n")

    put("GCF_1_a", ["_genomic.fna.gz", "_genomic.gff.gz", "_feature_table.txt.gz"], lambda x: [*x, "0" * 32 + "  ./absent.gbff.gz"])
    put("GCA_1_a", ["_genomic.fna.gz"], lambda x: ["0" * 32 + x[0][32:]])
    put("GCA_3_c", ["_genomic.fna.gz", "_genomic.gff.gz"])
    put("GCA_5_e", ["_genomic.gff.gz"], lambda x: ["0" * 32 + "  ./absent.txt"])
    return tmp_path


def test_from_folders_to_reports(spark, collection):
    got = curate(spark, str(collection / "refseq.txt"), str(collection / "genbank.txt"), str(collection / "db"))
    assert {(r.dir_name, r.has_annotation, r.present) for r in got.catalog.collect()} == {("GCF_1_a", "yes", True), ("GCF_2_b", "no", False), ("GCA_1_a", "no", True), ("GCA_3_c", "no", True)}
    assert tuple(got.counts.first()) == (4, 4, 3, 1)
    assert {(r.assembly, r.annotated, r.feature_table) for r in got.annotated.collect()} == {("GCF_1_a", True, True), ("GCA_1_a", False, False), ("GCA_3_c", True, False), ("GCA_5_e", False, False)}
    assert {(r.assembly, r.n_files, r.good) for r in got.checked.collect()} == {("GCF_1_a", 3, True), ("GCA_1_a", 1, False), ("GCA_3_c", 0, False), ("GCA_5_e", 0, True)}
    assert sorted((r.good, r.assembly or "", r.n_assemblies) for r in got.checks.collect()) == [(False, "", 2), (False, "GCA_1_a", 1), (False, "GCA_3_c", 1), (True, "", 2)]
    assert {r.dir_name for r in got.unique.collect()} == {"GCF_1_a", "GCA_3_c", "GCA_5_e"}
    assert [r.dir_name for r in got.unmatched.collect()] == ["GCA_5_e"]
    assert {(r.kind, r.only_in, r.core) for r in got.differences.collect()} == {("all", "GenBank", "3_c"), ("all", "GenBank", "5_e"), ("annotated", "RefSeq", "1_a"), ("annotated", "GenBank", "3_c"), ("unannotated", "GenBank", "5_e")}
    write_collection(got, str(collection / "out"))
    assert [r.value for r in spark.read.text(str(collection / "out/annotated")).collect()] == ["GCA_3_c", "GCF_1_a"]
    assert spark.read.option("header", True).csv(str(collection / "out/catalog")).count() == 4


def test_inventory_keeps_every_name(spark, collection):
    got = R.inventory(spark, str(collection / "db"))
    assert {(r.file_name, r.kind, r.compressed) for r in got.where("assembly = 'GCF_1_a'").collect()} == {("GCF_1_a_genomic.fna.gz", "sequence", True), ("GCF_1_a_genomic.gff.gz", "annotation", True), ("GCF_1_a_feature_table.txt.gz", "feature_table", True), ("md5checksums.txt", "manifest", False)}
    assert "ReadSchema: struct<path:string,length:bigint>" in got._jdf.queryExecution().executedPlan().toString()
    assert R.list_assembly_files(spark, str(collection / "db")).count() == 0
    total = A.corpus_bytes(R.inventory(spark, str(collection / "db"), "*.fna.gz")).first()
    assert (total.n, total.total_bytes) == (3, sum(p.stat().st_size for p in (collection / "db").glob("*/*.fna.gz")))


def test_corpus_counts_while_it_is_written(spark, tmp_path):
    one = spark.createDataFrame([("r1", "ACGT"), ("r2", "")], "replicon string, seq string")
    two = spark.createDataFrame([("r3", "GG" * 500, 1)], "replicon string, seq string, other int")
    records, size = K.write_corpus([one, two], str(tmp_path / "corpus"))
    assert records == 3 and size == sum(p.stat().st_size for p in (tmp_path / "corpus").glob("part-*"))
    assert {(r.replicon, r.len) for r in R.read_fasta(spark, str(tmp_path / "corpus")).collect()} == {("r1", 4), ("r2", 0), ("r3", 1000)}


def test_summaries_all_or_none(spark, tmp_path):
    good = spark.createDataFrame([(2, "b"), (1, "a")], "x int, y string")
    bad = good.select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        K.write_together({"one": (good, ("x",)), "two": (bad, ()), "three": (good, ())}, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*")) == []
    K.write_together({"one": (good, ("x",)), "three": (good, ())}, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["one", "three"]
    assert [r[0] for r in spark.read.csv(str(tmp_path / "out/one"), sep="\t").collect()] == ["1", "2"]
    with pytest.raises(FileExistsError):
        K.write_together({"new": (good, ()), "three": (good, ())}, str(tmp_path / "out"))
    assert not (tmp_path / "out/new").exists()


def test_last_line_wins_over_split_files(spark, tmp_path):
    for k, name in enumerate(("b.txt", "a.txt", "c.txt")):
        lines = [entry(f"GCA_{i}", "n", f"link {name} {j}") for j in range(20) for i in range(10 + k)]
        (tmp_path / name).write_text("header\n" + "\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = {r.subdir_name: r.ftp_location for r in R.read_assembly_catalog(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {f"GCA_{i}_n": "link c.txt 19" for i in range(12)}


@pytest.mark.parametrize("k", [1, 5, 400, 25_000])
def test_top_targets_in_parts(spark, k):
    rows = [("q1", f"r{i % 900}", (i * 7919 % 101) * 1e-13) for i in range(3000)] + [("q2", "r1", 0.5)] * 3
    hits = spark.createDataFrame(rows, "qseqid string, replicon string, evalue double")
    best = {}
    for q, r, e in rows:
        best[q, r] = min(e, best.get((q, r), 9))
    kept = {x for q in ("q1", "q2") for x in sorted((y for y in best if y[0] == q), key=lambda y: (best[y], y[1]))[:k]}
    for parts in (1, 9, 512):
        got = A.top_targets_per_query(hits, k, parts, 4)
        assert sorted(map(tuple, got.collect())) == sorted((q, r, e) for q, r, e in rows if (q, r) in kept)


def test_sketches_merge_without_hits(spark):
    hits = spark.range(200_000).selectExpr("concat('r', id % 50000) as replicon", "if(id % 3 = 0, 'CopA', 'CopY') as assoc_type")
    one = A.merged_sketches(A.replicon_sketches(hits))
    halves = A.replicon_sketches(hits.where("replicon < 'r3'")).unionByName(A.replicon_sketches(hits.where("replicon >= 'r3'")))
    two = {r.assoc_type: r.n_replicons for r in A.merged_sketches(halves).collect()}
    for r in one.collect():
        assert abs(r.n_replicons - 50_000) <= 0.03 * 50_000 and abs(two[r.assoc_type] - 50_000) <= 0.03 * 50_000
