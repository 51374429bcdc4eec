import random

from cirque.plans.analysis import analyse, write_reports


def test_from_files_to_reports(spark, tmp_path):
    rng = random.Random(4)
    word = "AATTACAAATGTAAAT"
    filler = lambda n: "".join(rng.choice("G") for _ in range(n))
    seq = filler(1000) + word + filler(2984)
    site = seq.index(word)
    for asm in ("GCA_1_one", "GCA_2_two"):
        (tmp_path / "genomes" / asm).mkdir(parents=True)
        name = f"r{asm[4]}"
        (tmp_path / "genomes" / asm / f"{asm}_genomic.fna").write_text(f">{name} text\n" + seq[:2000].lower() + "\n" + seq[2000:] + f"\n>{name}p small\nGGGGGGGGGGGGGGGGGGGGGG\n")
        rows = [("region", 1, 4000, "+", "ID=all"), ("gene", 1051, 1350, "+", "ID=g1"), ("CDS", 1051, 1350, "+", "ID=c1;Name=copY;product=repressor"), ("CDS", 1371, 1900, "+", "ID=c2"), ("CDS", 3001, 3300, "-", "ID=c3;product=thing")]
        (tmp_path / "genomes" / asm / f"{asm}_genomic.gff").write_text("##gff-version 3\n" + "".join(f"{name}\tsrc\t{k}\t{s}\t{e}\t.\t{t}\t0\t{a}\n" for k, s, e, t, a in rows))
    (tmp_path / "hits").mkdir()
    (tmp_path / "hits" / "CopY").write_text("r1\t1100\t1200\t90\t1\t40\t1e-20\tq\t1\t90\nr1\t3100\t3200\t90\t-1\t40\t1e-20\tq\t1\t90\nother\t1\t9\t3\t1\t40\t1e-20\tq\t1\t9\n")
    (tmp_path / "hits" / "CopA").write_text("r1\t1400\t1500\t90\t2\t40\t1e-20\tq\t1\t90\n")
    entry = lambda a, n, tax: "\t".join([a, "", "bio", "", "cat", str(tax), str(tax // 10), f"org {tax}", "strain", "", "", "Complete Genome", "", "", "", n, "", "", "", "ftp", "st"])
    (tmp_path / "catalog.txt").write_text("assembly_accession\tof the header\n#two\n" + entry("GCA_1", "one", 71) + "\n" + entry("GCA_2", "two", 82) + "\n")
    got = analyse(spark, str(tmp_path / "catalog.txt"), str(tmp_path / "genomes/*/*.fna"), str(tmp_path / "genomes/*/*.gff"), str(tmp_path / "hits"))
    sites = sorted(tuple(r)[:10] for r in got.sites.collect())
    assert sites == [(word, "r1", "Chromosome", site + 1, "Forward", 2, "Exterior", "A.34", "Double", "[AY]"), (word, "r2", "Chromosome", site + 1, "Forward", 2, "Exterior", "A.34", "Double", "")]
    assert sorted(map(tuple, got.operons.collect())) == [("r1", "Chromosome", 1051, "Forward", 1, 2), ("r2", "Chromosome", 1051, "Forward", 1, 2)]
    assert [tuple(r) for r in got.orphans.collect()] == [("c3", "thing", "r1", 3001, 3300)]
    genomes = {r.assembly: r for r in got.genomes.collect()}
    one = genomes["GCA_1_one"]
    assert (one.assembly_accession, one.tax_id, one.organism_name, one.n_replicons, one.total_len, one.n_sites, one.exterior, one.n_operons, one.n_genes, one.n_orphans, one.code) == ("GCA_1", "71", "org 71", 2, 4022, 1, 1, 1, 2, 1, "[AY]")
    assert (genomes["GCA_2_two"].n_orphans, genomes["GCA_2_two"].code) == (0, "")
    write_reports(got, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "out/genomes")).count() == 2
