import random

import pytest

from cirque.operators import motifs as M
from cirque.sources import readers as R

FLIP = str.maketrans("ACGT", "TGCA")

#: Known sites of one genome, as word, whether both strands match, and whether the word stands on the forward strand.
KNOWN = [
    ("GTTTACAATTGTAAAC", 1, 1), ("ATTTACACTTGTAAAT", 1, 1), ("GTTTACATGTGTAAAT", 1, 1), ("GGCGACAGGTGTAGGC", 1, 1), ("AATGACAATTGTAGGT", 1, 1), ("GCTGACAGCCGTCGTC", 0, 1),
    ("ATTGACAATTGTCAGT", 1, 1), ("GCTTACAAGCGTCAAT", 0, 1), ("GTTTACACGTGTAAAC", 1, 1), ("ATTTACAACCGTAAAC", 0, 0), ("GTTTACAATTGTAAAC", 1, 1), ("ATTTACAATTGTCAGC", 1, 1),
    ("ACCTACAAACGTAGTT", 0, 0), ("GTTTACATCTGTAGAT", 1, 1), ("GCTGACAATCGTCATC", 0, 1), ("GTTTACAAACGTAAAC", 0, 0), ("AGTTACATCTGTCACT", 1, 1), ("ACCGACAGCCGTCATC", 0, 1),
    ("ACTGACAATCGTCGTT", 0, 0), ("GTTTACATGCGTCAAT", 0, 0), ("ACCGACACCTGTCAAT", 1, 1), ("GTTTACATATGTAATC", 1, 1), ("ATTTACACTTGTAAAC", 1, 1), ("GCTTACATCCGTAGCC", 0, 0), ("AATTACAACTGTAATT", 1, 1), ("ACCTACATGCGTCAAT", 0, 0),
]


def brute(seq, words):
    n, out = len(seq), []
    for k in {len(w) for w in words}:
        if n >= k:
            for i in range(n):
                w = (seq + seq)[i : i + k]
                out += [("Forward", i, i + k, w)] * (w in words)
                r = w.translate(FLIP)[::-1]
                out += [("Reverse", i, i + k, r)] * (set(w) <= set("ACGT") and r in words)
    return sorted(out)


@pytest.mark.parametrize("count", [1, 1000, 32_768])
def test_lists_of_words(spark, count):
    rng = random.Random(count)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    size = {1: 5, 1000: 8, 32_768: 10}[count]
    words = {letters(size) for _ in range(count)} | ({letters(3), letters(31)} if count > 1 else set())
    seqs = {f"r{i}": letters(rng.choice([0, 2, 3, 9, 10, 40, 700])) for i in range(30)}
    seqs["n"] = letters(50) + "N" * 3 + letters(50) + "é" + letters(9)
    seqs["w"] = max(words, key=len) * 3
    frame = spark.createDataFrame([*seqs.items(), ("null", None)], "replicon string, seq string")
    for tile in (64, M.TILE):
        got = {}
        for r in M.scan_words(frame, [*words, *list(words)[:2], "ACN"], tile).collect():
            got.setdefault(r.replicon, []).append((r.strand, r.start_bound, r.end_bound, r.seq))
        assert {k: sorted(v) for k, v in got.items()} == {k: brute(v, words) for k, v in seqs.items() if brute(v, words)}
    with pytest.raises(ValueError, match="letters"):
        M.scan_words(frame, ["A" * 32])
    assert M.scan_words(frame, []).count() == 0


@pytest.mark.parametrize("k", [1, 4, 7, 16, 31])
def test_numbers_are_spelled(spark, k):
    rng = random.Random(k)
    words = ["A" * k, "T" * k, *("".join(rng.choices("ACGT", k=k)) for _ in range(50))]
    codes = [(sum("ACGT".index(c) << 2 * (k - 1 - i) for i, c in enumerate(w)),) for w in words] + [(None,)]
    assert [r.w for r in spark.createDataFrame(codes, "code long").select(M.spelled("code", k).alias("w")).collect()] == [*words, None]


def test_known_sites(spark, tmp_path):
    rng = random.Random(1)
    seq, want = "", []
    for word, both, forward in KNOWN:
        seq += "".join(rng.choices("AG", k=rng.randrange(30, 400)))  # no motif without a C or T
        want.append((len(seq), word, "Double" if both else "Single", "Forward" if forward else "Reverse"))
        seq += word if forward else word.translate(FLIP)[::-1]
    seq += "G" * 40
    for assembly in ("GCF_1_x", "GCF_2_y"):
        (tmp_path / assembly).mkdir()
        (tmp_path / assembly / "NC_1.1").write_text(seq.lower() + "\n")
    (tmp_path / "GCF_2_y" / "NC_2.1").write_text("")
    replicons = R.read_replicons(spark, f"{tmp_path}/*/*")
    assert {(r.assembly, r.replicon, r.len) for r in replicons.collect()} == {("GCF_1_x", "NC_1.1", len(seq)), ("GCF_2_y", "NC_1.1", len(seq))}
    for scan in (M.scan_motif(replicons), M.scan_words(replicons, [r.word for r in M.expand_motif(spark).collect()])):
        sites = M.dedupe_sites(M.mark_palindromes(scan)).collect()
        for assembly in ("GCF_1_x", "GCF_2_y"):
            assert sorted((r.start_bound, r.seq, r.dimension, r.strand) for r in sites if r.assembly == assembly) == want


def test_assemblies_that_share_a_name(spark):
    word = "GACTACACTCGTAAGT"
    one, two = "G" * 50 + word + "G" * 30, "G" * 50 + word.translate(FLIP)[::-1] + "G" * 31
    rows = [("a", "r", one), ("b", "r", two), ("c", "r", "G" * 50 + "GTTTACAATTGTAAAC" + "G" * 9)]
    find = lambda x: sorted((r.assembly, r.len, r.strand, r.start_bound, r.dimension) for r in M.dedupe_sites(M.mark_palindromes(M.scan_motif(spark.createDataFrame(x, "assembly string, replicon string, seq string")))).collect())
    assert find(rows) == sorted(y for x in rows for y in find([x])) == [("a", 96, "Forward", 50, "Single"), ("b", 97, "Reverse", 50, "Single"), ("c", 75, "Forward", 50, "Double")]
