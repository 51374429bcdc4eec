"""SimHash against the hash library and pairwise distances."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cirque.llm import common as C
from cirque.llm import simhash as H


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    values = np.array(distinct, np.uint64)
    for f in distinct:
        for g in values[np.bitwise_count(values ^ np.uint64(f)) <= 2].tolist():
            up[top(f)] = top(g)
    low = defaultdict(list)
    for d, f in fps:
        low[top(f)] += [d] if d is not None else []
    return sorted((str(d), f"{f:016x}", str(min(low[top(f)], default=None))) for d, f in fps)


def check(spark, rows, limit=H.LIMIT):
    got = H.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain_groups(rows)


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.concatenate([np.arange(0, 300), [1000, 2500]])
    start = rng.integers(0, 5000 - size)
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size, strict=True)]
    assert H.xxh64(data, start, start + size).tolist() == want


def test_given_documents(spark, small):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "PIECE", 7)
    rng = random.Random(2)
    words = ["Ab", "é", "c" * 40, "d", "E.", "İx", "f" * 300]
    rows = [(i, " \t\n".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for i in range(80)]
    rows += [(5, "one"), (5, "one"), (None, "two words"), (None, None), (90, None), (91, ""), (92, " \x0b "), (93, "w " * 20000)]
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    for i in range(60):
        rows.append((1000 + i, " ".join(base[:i] + ["zz"] + base[i + 1 :])))
    check(spark, rows, limit)
    assert H.groups(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string")
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in H.groups(spark, wide).collect()) == plain_groups(rows)


def test_planes_find_what_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = rng.integers(0, 64, (40, 30, 2)).astype(np.uint64)
    fps = np.unique(base[:, None] ^ (np.uint64(1) << flips[:, :, 0]) ^ (np.uint64(1) << flips[:, :, 1]))
    planes = H.planes_of(fps)
    for by in (1, 5, 63, 64, 65, 200):
        lanes = len(fps) - by
        want = np.flatnonzero(np.bitwise_count(fps[:lanes] ^ fps[by:]) <= 2)
        assert H.near(planes, by, lanes).tolist() == want.tolist()
    bucket = np.sort(rng.integers(0, 30, len(fps)))
    x, y = H.compared(bucket, fps.view(np.int64))
    up = {int(f): int(f) for f in fps.view(np.int64)}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        up[top(a)] = top(b)
    for i in range(len(fps)):
        for j in np.flatnonzero((bucket == bucket[i]) & (np.bitwise_count(fps ^ fps[i]) <= 2)):
            assert top(int(fps.view(np.int64)[i])) == top(int(fps.view(np.int64)[j]))
    assert C.U is np.uint64
