"""Rows that share a doc_id, exact repeats, very long texts and columns of clashing names, for the per-text and the dedup operators."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from cirque.llm import blocks, byte_bpe, debruijn_dedup, decontaminate, feistel, jaccard_join, media, quality, suffix_array_dedup, toxicity

P = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree near our house and nobody ever hears it again "
ROWS = [(1, "alpha " + P), (1, "beta " + P), (1, "alpha " + P), (2, P + P), (2, "short"), (2, None), (None, P), (None, "x " + P), (0, "zero"), (3, "gamma " + P), (3, "gamma " + P), (4, ""), (4, "")]
CLASHING = "doc_id long, text string, label int, score double, item_id long, at string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, n, 0.5, n, "z") for n, (i, t) in enumerate(ROWS)], CLASHING).repartition(3).cache()


def order(i):
    return 2**63 - 1 if i is None else i


def values(df, *names):
    return Counter((r.doc_id, *(r[n] for n in names)) for r in df.collect())


def test_each_row_by_its_text(spark, docs):
    import public_tokenizers

    got = values(media.payload_features(docs), "n_bytes", "payload_sha256")
    pad = lambda b: b + bytes(-len(b) % 64 or (0 if b else 64))
    assert got == Counter((i, len((t or "").encode()), hashlib.sha256(pad((t or "").encode())).hexdigest()) for i, t in ROWS)
    got = values(byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "decoded_sha256")
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)] * 2, "doc_id long, quality int, toxic int")
    for f in (quality.score, toxicity.score):
        rows = f(docs, labels).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert Counter(Counter((r.doc_id, r.score) for r in rows).values())[2] >= 3  # rows 1, 3 and 4 have texts twice


def test_shards_of_repeated_rows(docs):
    got = feistel.shards(docs, 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_dedup_of_rows_that_share_an_id(spark, docs, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    first, word = {}, {}
    for i, t in ROWS:
        b, w = (t or "").encode(), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 2**63), order(i))
        for p in range(len(w) - 19):
            word[tuple(w[p : p + 20])] = min(word.get(tuple(w[p : p + 20]), (2**63, 0)), (order(i), p))
    bytes_, words = Counter(), Counter()
    for i, t in ROWS:
        b, w = (t or "").encode(), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone, out = np.zeros(len(b), bool), np.zeros(len(w), bool)
        for p in range(len(b) - 49):
            gone[p : p + 50] |= first[b[p : p + 50]] < order(i)
        for p in range(len(w) - 19):
            out[p : p + 20] |= word[tuple(w[p : p + 20])] != (order(i), p)
        bytes_[i, len(b), int(gone.sum())] += 1
        words[i, len(w), int(out.sum())] += 1
    assert values(suffix_array_dedup.remove_repeats(spark, docs, 50), "n_bytes", "n_removed") == bytes_
    assert values(debruijn_dedup.remove_repeats(spark, docs, 20), "n_words", "n_removed") == words


def test_components_of_rows_that_share_an_id(spark, docs):
    got = values(jaccard_join.groups(spark, docs, 4, 85), "component_id")
    assert set(got) and sum(got.values()) == len(ROWS)
    assert {c for i, c in got if i == 0} == {0} and {c for i, c in got if i == 3} <= {1, 3}


def test_leaks_with_clashing_columns_and_ties(spark, docs):
    items = [(7, P), (8, P), (9, "nothing like it at all, and rather long")]
    got = values(decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), inside=True), "item_id", "edits")
    assert got == Counter((i, k, 0) for i, t in ROWS if t and P.strip() in t for k in (7, 8))


def test_texts_of_megabytes(spark):
    import public_tokenizers

    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, "a b c " + long[-400_000:]), (3, "x")]
    assert len(long) > 2_000_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert values(media.payload_features(docs), "n_bytes") == Counter((i, len(t)) for i, t in rows)
    assert values(byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "decoded_sha256") == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    cut = {r.doc_id: r for r in suffix_array_dedup.remove_repeats(spark, docs, 50).collect()}
    assert (cut[1].n_removed, cut[2].n_removed) == (0, 400_000 + (long[-400_001] == " "))
    words = {r.doc_id: r for r in debruijn_dedup.remove_repeats(spark, docs, 20).collect()}
    assert words[1].n_removed == 0 and words[2].n_words - words[2].n_removed <= 4
    assert {r.doc_id: r.component_id for r in jaccard_join.groups(spark, docs, 4, 85).collect()} == {1: 1, 2: 2, 3: 3}
