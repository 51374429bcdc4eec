import collections
import hashlib
import itertools
import random
import re

import corpus_pipeline


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).checkpoint()
        after = docs.count()
        assert docs.columns == columns and 0 < after <= before, name
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == before


def test_cut_passages_are_the_repeated_ones(spark, small):
    text = "a passage that several documents hold in common and that is long enough to be cut from all but the first of them, word by word"
    rows = [(1, "head one " + text + " tail one", "en", "s", 0), (2, "head two " + text + " tail two", "en", "s", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, small).collect()}
    assert got[1] == rows[0][1] and got[3] is None and text[2:-2] not in got[2] and got[2].startswith("head two") and got[2].endswith("two")


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_keep_one(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    number = lambda k: 2**63 if rows[k][0] is None else rows[k][0]
    best = {g: min((k for k in range(len(rows)) if group[k] == g), key=number) for g in set(group)}
    return [r for k, r in enumerate(rows) if not sets[k] or best[group[k]] == k]


def plain_cut(rows, window=corpus_pipeline.PASSAGE):
    first, out = {}, []
    raw = [((2**63 if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - window + 1):
            first[b[p : p + window]] = min(first.get(b[p : p + window], 2**63), i)
    for (i, b), (doc, t) in zip(raw, rows, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        out.append((doc, None if t is None else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_whole_pipeline_against_plain_steps(spark, tmp_path):
    """Rejected texts, copies, passages, contamination, nulls, odd columns: the end result is that of plain loops over the kept rows."""
    rng = random.Random(8)
    text = lambda n, s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    passage, item = text(60, "abcde"), text(14, "fghij")
    clean = [text(rng.randrange(20, 60), "klmnop") for _ in range(70)]
    bad = [" ".join(rng.choice(["vile", "scum", "rotten", "hateful"]) for _ in range(30)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100 + k, t) for k, t in enumerate(bad)]
    rows += [(201, clean[3]), (202, clean[4] + " extra"), (203, clean[5].upper()), (204, clean[0] + " " + passage), (205, passage + " " + clean[1]), (206, "é" + passage[:150] + "é" + clean[2])]
    rows += [(207, clean[6] + " " + item + " tail"), (208, "X " + item.replace("f", "g", 1).upper()), (209, None), (210, ""), (None, clean[7]), (None, "alone in the world " + text(9, "qrst")), (211, "two words"), (212, "long " + text(9000, "uvwxyz"))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, node int, block string, _part string"
    docs = spark.createDataFrame([(i, t, None, None, None, "a", k, None, "b") for k, (i, t) in enumerate(rows)], schema).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(map(str, left)) == sorted(str(r) for r in rows if not (r[0] and 100 <= r[0] < 200))
    once = plain_keep_one(rows=sorted(left, key=str))
    cut = plain_cut(once)
    pure = [(i, t) for i, t in cut if i not in (207, 208)]
    assert len(left) > len(once) > len(pure) and sum(len(t or "") for _, t in cut) < sum(len(t or "") for _, t in once)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pure)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(r.n_tokens for r in got) == sorted(len(own.encode_ordinary(t or "")) for _, t in pure)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
