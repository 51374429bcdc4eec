from cirque.sources import readers as R
from cirque.sources import sinks as K


def put(tmp_path, name, text, folder="asm1"):
    (tmp_path / folder).mkdir(exist_ok=True)
    (tmp_path / folder / name).write_text(text)
    return str(tmp_path / folder / name)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "x.fna", ">r1 some text\nacgt\nAC\n>r2\nGG\n")
    got = [(r.assembly, r.replicon, r.len, r.seq) for r in R.read_fasta(spark, p).orderBy("replicon").collect()]
    assert got == [("asm1", "r1", 6, "ACGTAC"), ("asm1", "r2", 2, "GG")]
    out = str(tmp_path / "merged")
    K.write_fasta(R.read_fasta(spark, p), out)
    assert R.read_fasta(spark, out).count() == 2


def test_gff(spark, tmp_path):
    p = put(tmp_path, "x.gff", "##gff\nr1\tsrc\tCDS\t11\t20\t.\t-\t0\tID=a;Name=b=c;ID=z\n")
    r = R.read_gff(spark, p).first()
    assert (r.replicon, r.start_bound, r.end_bound, r.strand, r.attributes) == ("r1", 10, 20, "Reverse", {"ID": "z", "Name": "b"})


def test_hits_taxonomy_manifest(spark, tmp_path):
    p = put(tmp_path, "CopA", "r1\t10\t2\t9\t-1\t30.5\t1e-20\tq\t1\t3\n")
    r = R.read_hits(spark, p).first()
    assert (r.assoc_type, r.replicon, r.send, r.sframe) == ("CopA", "r1", 2, -1)
    n = put(tmp_path, "names", "7\t|\tX y\t|\t\t|\tscientific name\t|\n7\t|\tz\t|\t\t|\tsynonym\t|\n")
    assert [tuple(r) for r in R.read_tax_names(spark, n).collect()] == [(7, "X y")]
    m = put(tmp_path, "md5checksums.txt", "abc  ./f.gff\n")
    assert [tuple(r) for r in R.read_md5_manifest(spark, m).collect()] == [("asm1", "f.gff", "abc")]
    assert R.list_assembly_files(spark, str(tmp_path)).count() == 0


def test_catalog(spark, tmp_path):
    row = ["GCA_1", "x", "bio", "x", "cat", "9", "8", "org", "inf", "x", "x", "Complete Genome", "x", "x", "x", "A  b#c/d", "x", "x", "x", "na", "st"]
    p = put(tmp_path, "c.txt", "# one\n#two\n" + "\t".join(row) + "\n")
    r = R.read_assembly_catalog(spark, p).first()
    assert (r.subdir_name, r.assembly_level, r.tax_id) == ("GCA_1_A_b_c_d", "complete genome", "9")


def test_a_gff_line_is_split_once(spark, tmp_path):
    from cirque.sources import readers as R

    (tmp_path / "g").mkdir()
    line = "\t".join(["r", "s", "CDS", "3", "9", ".", "-", "0", "ID=x;;Name=b=c;flag;ID=f;=e"])
    (tmp_path / "g" / "a.gff").write_text(f"#c\n\n{line}\n{line[:-26]}\n")
    got = R.read_gff(spark, str(tmp_path / "g"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1
    a, b = (r.attributes for r in got.orderBy("ord.line").collect())
    assert a == {"ID": "f", "Name": "b", "flag": "", "": "e"} and len(b) <= 1
