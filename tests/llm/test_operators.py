import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirque.llm import blocks, byte_bpe, common, components, debruijn_dedup, decontaminate, feistel, jaccard_join, media, quality, suffix_array_dedup, toxicity, training_order

WORD = rb"[^\x20\x09-\x0D]+"
P = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree near our house and nobody ever hears it again "
Z = "zzzz " * 40


def odd_rows():
    """Nulls, empty and long texts, ties, repeats inside and across texts, split characters."""
    return [
        (1, "alpha " + P + "omega"), (2, "beta " + P + "gamma"), (3, None), (4, ""), (5, "   \n\t"), (6, P + P), (7, Z), (8, Z + "é" * 80), (9, "é" * 90), (10, "alpha " + P + "omega"), (11, "short"), (12, "Short"),
        (13, "x" * 3000 + P), (14, " ".join(f"w{i % 700}" for i in range(3000))), (15, (P + "one two three four five six seven eight nine ten ") + "tail"), (None, P), (16, P.upper() + "omega"), (17, "a\x00b " + P),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", n) for n, (i, t) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, ids int").repartition(3)


@pytest.fixture(autouse=True)
def tiny(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)


def order(i):
    return 2**63 - 1 if i is None else i


@pytest.mark.parametrize("hot", [2, 16_000])
def test_suffix_array_against_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(blocks, "HOT", hot)
    rows, first = odd_rows(), {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 2**63), order(i))
    got = {r.doc_id: r for r in suffix_array_dedup.remove_repeats(spark, docs, 50).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, kept), i


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = np.concatenate([rng.integers(97, 97 + rng.integers(1, 4), 400).astype(np.uint8), np.zeros(30, np.uint8)])
        wanted = np.zeros(len(text), bool)
        wanted[:400] = rng.random(400) < 0.7
        from cirque.llm.common import words8

        got = suffix_array_dedup.suffix_array(text, words8(text), wanted, 24)
        raw = text.tobytes()
        assert sorted(got) == list(np.flatnonzero(wanted))
        assert [raw[i : i + 24] for i in got] == sorted(raw[i : i + 24] for i in got)
        lcp = suffix_array_dedup.common_prefixes(got, words8(text), 24)
        for k in range(1, len(got)):
            a, b = raw[got[k - 1] : got[k - 1] + 24], raw[got[k] : got[k] + 24]
            assert lcp[k] == next((j for j in range(24) if a[j : j + 1] != b[j : j + 1]), 24)


def test_debruijn_against_brute_force(spark, docs):
    rows, first = sorted(odd_rows(), key=lambda r: order(r[0])), {}
    words = {i: re.findall(WORD, (t or "").encode()) for i, t in rows}
    for i, w in words.items():
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    got = {r.doc_id: r for r in debruijn_dedup.remove_repeats(spark, docs, 20).collect()}
    assert set(got) == set(words)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                gone[p : p + 20] = [True] * 20
        kept = hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), kept), i


def graph(spark, edges):
    """Trails and inner nodes of edges (src_block, src_at, from_node, to_node)."""
    trails, inner = [], []
    for block, at, a, b in sorted(edges):
        if trails and trails[-1][0] == block and sum(trails[-1][1:3]) == at:
            trails[-1][2:] = [trails[-1][2] + 1, trails[-1][3], b]
            inner.append((block, at, a))
        else:
            trails.append([block, at, 1, a, b])
    return spark.createDataFrame(trails, "src_block int, src_at long, n long, from_node long, to_node long"), spark.createDataFrame(inner, "src_block int, src_at long, from_node long")


def test_unitigs_join_runs_that_do_not_branch(spark):
    # nodes a-b-c-d in block 0, d-e-f in block 1 (nothing branches), then f-g and f-h (f branches), and a ring x-y-x
    rows = [(0, 0, 1, 2), (0, 1, 2, 3), (0, 2, 3, 4), (1, 7, 4, 5), (1, 8, 5, 6), (1, 9, 6, 7), (2, 3, 6, 8), (3, 0, 20, 21), (4, 5, 21, 20)]
    got = {(r.src_block, r.src_at, r.n): (r.unitig, r.offset) for r in debruijn_dedup.unitigs(*graph(spark, rows), common.Steps(spark)).collect()}
    assert {k: v[1] for k, v in got.items()} == {(0, 0, 3): 0, (1, 7, 2): 3, (1, 9, 1): 0, (2, 3, 1): 0, (3, 0, 1): 0, (4, 5, 1): 1}
    assert got[0, 0, 3][0] == got[1, 7, 2][0] and got[3, 0, 1][0] == got[4, 5, 1][0]
    assert len({got[x][0] for x in ((0, 0, 3), (1, 9, 1), (2, 3, 1), (3, 0, 1))}) == 4


def test_unitig_of_many_runs_is_put_in_order(spark):
    # one path of 300 edges, each the only one of its block, whose least name lies in its middle; and a ring of 70
    rng = np.random.default_rng(8)
    block = rng.permutation(370).tolist()
    path = [(block[i], 5, i, i + 1) for i in range(300)]
    ring = [(block[300 + i], 5, 1000 + i, 1000 + (i + 1) % 70) for i in range(70)]
    got = {r.src_block: (r.unitig, r.offset) for r in debruijn_dedup.unitigs(*graph(spark, path + ring), common.Steps(spark)).collect()}
    assert [got[block[i]][1] for i in range(300)] == list(range(300)) and len({got[b][0] for b in block[:300]}) == 1
    least = block.index(min(block[300:])) - 300
    assert [got[block[300 + (least + i) % 70]][1] for i in range(70)] == list(range(70)) and len({got[b][0] for b in block[300:]}) == 1


def test_what_is_in_no_unitig_stays(spark, docs, monkeypatch):
    whole = {r.doc_id: r.n_removed for r in debruijn_dedup.remove_repeats(spark, docs, 20).collect()}
    found = debruijn_dedup.components
    monkeypatch.setattr(debruijn_dedup, "components", lambda *a: found(*a).where("false"))
    less = {r.doc_id: r.n_removed for r in debruijn_dedup.remove_repeats(spark, docs, 20).collect()}
    assert set(less) == set(whole) and all(less[i] <= whole[i] for i in whole) and sum(less.values()) < sum(whole.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_debruijn_of_random_walks(spark, monkeypatch, seed):
    """Documents stitched from few passages, with repeated ids, against brute force; short bins so that intervals are cut."""
    monkeypatch.setattr(debruijn_dedup, "BIN", 8)
    rng = np.random.default_rng(seed)
    passages = [[f"p{i}w{j}" for j in range(rng.integers(4, 90))] for i in range(8)] + [["z"] * 40, ["a", "b"] * 20]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.integers(1, 6)):
            x = passages[rng.integers(0, 10)]
            a = rng.integers(0, len(x))
            w += x[a : a + rng.integers(1, 90)] + [f"u{i}"] * int(rng.integers(0, 3))
        rows.append((None if i == 50 else int(rng.permutation(100)[0]), " ".join(w)))
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 6):
            key = tuple(w[p : p + 7])
            first[key] = min(first.get(key, (2**64, 0)), (order(i), p))
    want = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 6):
            if first[tuple(w[p : p + 7])] != (order(i), p):
                gone[p : p + 7] = [True] * 7
        want.append((order(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = debruijn_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_jaccard_makes_its_classes_once(spark, docs, monkeypatch):
    """A plan is the driver's work and memory: what makes the classes stands in one step's plan, not in that of each join with them."""
    made, write = [], common.Steps.__call__

    def watched(self, df, name):
        if re.search(r"min\((named_)?struct\(doc, doc#\d+L, key", df._jdf.queryExecution().executedPlan().toString()):
            made.append(name)
        return write(self, df, name)

    monkeypatch.setattr(common.Steps, "__call__", watched)
    jaccard_join.groups(spark, docs, 4, 85).count()
    assert made == ["named"]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (3, 30)])
def test_jaccard_against_brute_force(spark, docs, n, percent):
    sets = {}
    for i, t in odd_rows():
        w = re.findall(WORD, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    near = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                near[a].add(b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark, docs, n, percent).collect()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert got[i] == (len(sets[i]), min(seen, key=order)), i


def test_byte_bpe_is_tiktoken(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in odd_rows():
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    c = byte_bpe.codec(path, public_tokenizers.PATTERN)
    text = "naïve 🙂🙃 <|endoftext|> ok"
    a, b = c.offsets(c.encode([text])[0])
    assert a[0] == 0 and b[-1] == len(text) and (a < b).all()
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, offsets=True)
    assert {r.doc_id: r.text for r in byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()} == {i: t or "" for i, t in odd_rows()}


def test_feistel_and_shards(spark, docs):
    for n in (1, 2, 3, 17, 1000):
        p = feistel.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (feistel.permute(p, n, 5, True) == np.arange(n)).all()
    rows = feistel.shards(docs, 4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want


def test_media(spark, docs, small):
    got = {r.doc_id: r for r in media.payload_features(docs).collect()}
    for i, t in odd_rows():
        b = (t or "").encode()
        p = b + bytes(64 if not b else -len(b) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_media(b)).hexdigest() and media.from_media(media.to_media(b)) == p
    html = '<p>one<script>var t="</p>";</script></p><figure><img src="sha256:ab" alt="x"><figcaption>cap <b>tion</b></figcaption></figure>two<img src="u">'
    items = media.sequence(html)
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "one", None, None), (1, "media", "sha256:ab", "ab", "cap tion"), (2, "text", "two", None, None), (3, "media", "u", None, None)]
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert media.parse(pages).where("size(items) > 3").count() == pages.count()


def test_media_payloads_by_digest(spark, docs):
    """References, repeated ones and unknown ones among them, get the stored bytes; texts, order and captions stay in place."""
    texts = ["a", "", "é" * 900]
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    figure = "<figure><img src='sha256:%s'><figcaption>of %s</figcaption></figure>"
    html = {i: f"<p>before {i}</p>" + figure % (digest[i % 3], i) + "<p>between</p>" + figure % (digest[0], "all") + "<img data-digest='none' alt='lost'>after" for i in range(7)}
    stored = media.store(spark.createDataFrame([(x,) for x in [*texts, texts[0]]], "text string")).dropDuplicates(["digest"])
    rows = media.resolve(media.parse(spark.createDataFrame(list(html.items()), "doc_id long, html string")), stored).collect()
    got = {i: [(r.kind, r.text if r.kind == "text" else None, r.caption, r.media and bytes(r.media)) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.position)] for i in html}
    known = {x: media.to_media(x.encode()) for x in texts}
    assert got == {i: [("text", f"before {i}", None, None), ("media", None, f"of {i}", known[texts[i % 3]]), ("text", "between", None, None), ("media", None, "of all", known["a"]), ("media", None, "lost", None), ("text", "after", None, None)] for i in html}


def test_classifiers_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    for f, name, least in ((quality.score, "quality", 0.97), (toxicity.score, "toxic", 0.95)):
        x = f(d, labels).join(labels, "doc_id").where("held_out").select("predicted", name).collect()
        assert sum(a == b for a, b in x) >= least * len(x) > 0


def test_classifiers_on_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.score, toxicity.score):
        assert {r.score for r in f(docs, none).collect()} == {0.5}
        assert f(docs.where("false"), none).count() == 0


def test_decontaminate(spark):
    items = [(1, "Ly was st the thonen of in. Erntor er en therha onbleble athethndan and it"), (2, "tiny"), (3, None), (4, "")]
    near = items[0][1].replace("thonen", "thomen").upper()
    rows = [(1, "before " + items[0][1] + " after"), (2, "x " * 50 + near + "."), (3, "nothing of the kind " * 9), (4, None), (5, ""), (6, "Tiny!"), (7, "tiny bits"), (8, items[0][1][:40])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2)}
    r = got[1, 1]
    assert rows[0][1].encode()[r.first_byte : r.end_byte].decode().rstrip() == items[0][1] and got[2, 1].edits == 1
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {3, 4, 5, 7, 8}


def test_training_order(spark, docs):
    got = training_order.in_training_order(docs, 64).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    for i, t in odd_rows():
        b = (t or "").encode()
        mine = sorted((r.seq, r.tokens_sha256) for r in got if r.doc_id == i)
        assert mine == [(k // 64, hashlib.sha256(b[k : k + 64]).hexdigest()) for k in range(0, len(b), 64)]
    shards = training_order.materialise(training_order.tokens_of_bytes(docs), 64, per_shard=10)
    assert sorted(r.slot for r in training_order.records(shards, 64, start=37).collect()) == list(range(37, len(got)))


def test_training_order_slots_are_the_permutation(spark):
    rows = [(i, f"{i} " * (i % 90)) for i in range(200)] + [(None, "abc" * 50), (3, "dup"), (3, "dup"), (8, None), (9, "")]
    got = training_order.in_training_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 64).collect()
    pieces = [(i, k // 64, hashlib.sha256((t or "").encode()[k : k + 64]).hexdigest()) for i, t in rows for k in range(0, len((t or "").encode()), 64)]
    assert collections.Counter(pieces) == collections.Counter((r.doc_id, r.seq, r.tokens_sha256) for r in got)
    numbers = [p for p in sorted(pieces, key=lambda p: (order(p[0]), p[1]))]
    want = dict(zip(((i, k) for i, k, _ in numbers), feistel.permute(np.arange(len(numbers)), len(numbers), 20240607).tolist(), strict=True))
    assert all(want[r.doc_id, r.seq] == r.slot for r in got if r.doc_id != 3)  # rows of document 3 share numbers with each other


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_array_dedup.remove_repeats(spark, none).count() == debruijn_dedup.remove_repeats(spark, none).count() == jaccard_join.groups(spark, none, 4, 85).count() == 0
    assert media.payload_features(none).count() == feistel.shards(none).count() == training_order.in_training_order(none).count() == decontaminate.find_leaks(none, bench).count() == 0


def linked_chain(count):
    """(doc_id, text) of documents that each link, with four words and 0.85, to the one before and the one after only."""
    return [(i, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 40))) for i in range(count)]


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(5)
    names = rng.permutation(1000).tolist()
    chains = [names[:600], names[600:900], names[900:]]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for chain in chains for a, b in zip(chain, chain[1:], strict=False)]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: find(x) for x in names}


def test_jaccard_of_a_long_chain(spark):
    docs = spark.createDataFrame(linked_chain(300), "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.groups(spark, docs, 4, 85).collect()} == {(i, 37, 0) for i in range(300)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_ngrams_of_short_slices(n):
    """A text alone in its slice, with fewer words than n or more, has the n-grams that it has among others."""
    texts = ["", *(" ".join(f"w{j}" for j in range(k)) for k in range(1, n + 3))]
    every = [t.encode() for t in texts]
    keys, at = jaccard_join.sets(np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)]), n)
    for k, t in enumerate(every):
        alone, ends = jaccard_join.sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), n)
        assert alone.tolist() == keys[at[k] : at[k + 1]].tolist() and ends.tolist() == [0, k - n + 1 if k >= n else min(k, 1)]


def test_keep_one_of_shared_and_null_ids(spark):
    p, q, r, s, t = (" ".join(f"{c}{i}" for i in range(30)) for c in "pqrst")
    rows = [(1, p), (2, p), (3, q), (3, q), (3, r), (4, p), (4, s), (4, ""), (4, None), (None, p), (None, t), (None, t), (None, ""), (None, " "), (5, r), (6, None), (7, "one two")]
    docs = spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string").repartition(3)
    got = jaccard_join.keep_one(spark, docs)
    assert got.columns == docs.columns
    want = [(1, p), (3, q), (3, r), (4, s), (4, ""), (4, None), (None, t), (None, ""), (None, " "), (6, None), (7, "one two")]
    assert sorted(map(str, ((x.doc_id, x.text) for x in got.collect()))) == sorted(map(str, want))


def fold_plain(text):
    return re.sub(rb"[\x00-/:-`{-\x7f]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def least_edits(item, text):
    """Edits of the best match of the whole item anywhere in the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("inside", [False, True])
def test_decontaminate_against_plain_edit_distance(spark, inside):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 1, 2, 3, 4, 5, 5, 6, 9, 14, 30])] + [(50, "x" * 20), (51, "A, b"), (52, "q" * 11)]
    texts = []
    for k, t in items * 3:
        t = list(t)
        for _ in range(rng.integers(0, 4)):
            p = int(rng.integers(0, len(t)))
            t[p : p + rng.integers(0, 2)] = rng.choice(["", "z", "a", " "])
        texts.append(" ".join(word() for _ in range(rng.integers(0, 6))) + " " + "".join(t) + " " + word())
    texts += [t for _, t in items] + ["", None, "a b", " A  b!", "xa b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), inside=inside).collect()}
    want = {}
    for d, t in enumerate(texts):
        x = fold_plain(t)
        for k, item in items:
            m = fold_plain(item).strip(b" ")
            if len(m) >= decontaminate.Q:
                e = least_edits(m, x)
                if e <= int(decontaminate.SHARE * len(m)):
                    want[d, k] = e
            elif x.strip(b" ") == m or inside and b" " + m + b" " in b" " + x + b" ":
                want[d, k] = 0
    assert got == want and any(want.values())
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"), inside=inside).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}


def plain_statistics(text):
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.NAMES)
    words = re.findall(WORD, b)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    n, size = len(words), len(b)
    symbol = lambda c: 32 < c < 127 and not chr(c).isalnum() and c not in b",."
    share = lambda a, k: a / max(k, 1)
    pairs, lines = list(zip(low, low[1:], strict=False)), b.count(b"\n") + 1
    stops = share(b.count(b".") + b.count(b","), n + 1) * (n + 1)
    return [
        np.log1p(n), np.log1p(share(size, n)), np.sqrt(share(sum(map(symbol, b)), size)), np.sqrt(sum(65 <= c <= 90 for c in b) / size), np.sqrt(sum(48 <= c <= 57 for c in b) / size),
        len(set(low)) / max(n, 1) ** 0.85, np.sqrt(share(sum(x == y for x, y in pairs), n)), share(len(set(pairs)), len(pairs)), np.sqrt(share(sum(any(map(symbol, w)) for w in words), n)),
        np.log1p(lines * 100 / size), np.log1p(n / lines), max((b.count(bytes([c])) for c in range(33, 256)), default=0) / size, np.log((stops + 0.5) / (n + 1 - stops + 0.5)) / 4,
    ]


def test_quality_against_plain_densities(spark, docs):
    raw = [(t or "").encode() for _, t in odd_rows()]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(x, [plain_statistics(t) for _, t in odd_rows()])
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in odd_rows() if i] + [(6, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    mine = {i: np.array(plain_statistics(t)) for i, t in odd_rows()}
    rows = {c: np.array([mine[i] for i, _ in odd_rows() if i and not held(i) and i % 2 == c]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in rows.items()}
    total = sum(map(len, rows.values()))
    pooled = sum(len(rows[c]) * cov[c] for c in rows) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    for i, _ in odd_rows():
        log = {}
        for c, v in rows.items():
            s = (0.9 * cov[c] + 0.1 * pooled) / np.outer(scale, scale)
            s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
            z = (mine[i] - v.mean(0)) / scale
            log[c] = np.log(len(v) / total) - 0.5 * z @ np.linalg.solve(s, z) - 0.5 * np.linalg.slogdet(s)[1]
        assert got[i].held_out == held(i) and abs(got[i].score - 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.3)


def plain_slots(text):
    code = [ord(c) for c in " " + re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "") + " "]
    out = set()
    for k in toxicity.SIZES:
        for i in range(len(code) - k + 1):
            h = 0
            for c in code[i : i + k]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            h = (h + k - 1) % 2**64
            out.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 47)
    return out


def test_toxicity_against_plain_log_ratios(spark):
    rng = np.random.default_rng(2)
    word = lambda c: rng.choice(["you vile", "awful scum", "rotten"] if c else ["good day", "warm rain", "Tea"])
    rows = [(i, " ".join(word(i % 3 == 0) for _ in range(rng.integers(1, 9))) + rng.choice(["", " é"]), i % 3 == 0) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, None, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    used = [(int(t), plain_slots(x)) for i, x, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    total = np.zeros((2, toxicity.SLOTS))
    for c, s in used:
        total[c][list(s)] += 1
    n = [sum(c == k for c, _ in used) for k in (0, 1)]
    ratio = np.log((total[1] + 1) / (total[1] + 1).sum() / ((total[0] + 1) / (total[0] + 1).sum()))
    kept = np.flatnonzero(model["place"] >= 0)
    seen = total.sum(0)
    strength = (total[1] - seen * n[1] / sum(n)) ** 2 / np.maximum(seen * n[1] / sum(n), 1e-9) * (seen >= 5)
    assert len(kept) == toxicity.KEPT and strength[kept].min() >= np.delete(strength, kept).max()
    at = [(c, np.array(sorted(model["place"][k] for k in s if model["place"][k] >= 0), np.uint16)) for c, s in used]
    weight, bias = toxicity.logistic(sorted(at, key=lambda r: (r[0], r[1].tobytes())), ratio[kept])
    assert np.allclose(weight, model["weight"], atol=1e-4) and abs(bias - model["bias"]) < 1e-3
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for i, x, t in rows:
        z = sum(weight[model["place"][k]] for k in plain_slots(x) if model["place"][k] >= 0) + bias
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-3 and got[i].predicted == int(t)


def test_toxicity_fit_holds_a_byte_a_slot():
    import tracemalloc

    rng = np.random.default_rng(4)
    rows = [(i % 2, np.flatnonzero(rng.random(4096) < 0.1).astype(np.uint16)) for i in range(2000)]
    tracemalloc.start()
    toxicity.logistic(rows, np.ones(4096), 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 2000 * 4096


def test_toxicity_takes_one_row_of_an_id(spark, monkeypatch):
    from cirque.llm import toxicity as X

    rows = [(1, f"text {i}") for i in range(50)] + [(i, f"other {i}") for i in range(2, 60)]
    sizes = []
    monkeypatch.setattr(X, "SAMPLE", 40)
    keep = X.logistic
    monkeypatch.setattr(X, "logistic", lambda rows, *a: sizes.append(len(rows)) or keep(rows, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    assert X.score(docs, labels).count() == len(rows)
    assert sizes and sizes[0] <= 40
