"""Operators on conversations against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from cirque.llm import conversation_repair as R
from cirque.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text[:64], hashlib.md5(text.encode()).hexdigest())


def cheapest(rows):
    """Least cost and least audit by a search over prefixes: rows are (initial, must go, truncated)."""
    n, step = len(rows), {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    best = {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == n and q in ("", "a"):
            best.setdefault("end", []).append((cost, audit))
        forced = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        heapq.heappush(heap, (cost + 3, audit + "I", i, forced))
        if i < n:
            initial, go, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if not go:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, forced))
                if initial and initial in step[q]:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, initial))
    return min(best["end"])


def plain_repairs(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in convs.items():
        after = []
        for turn, role, text in rows:
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            after += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
        after.sort(key=key)
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, judged, n = set(), [], [0, 0, 0]
        for _, role, text in after:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            judged.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit = cheapest(judged)
        lines, at, turn = [], 0, "user"
        for letter in audit:
            if letter == "I":
                lines.append(f"{turn}:")
            else:
                if letter == "K":
                    lines.append(f"{after[at][1]}:{after[at][2]}")
                if letter == "R":
                    lines.append(f"{turn}:{after[at][2]}")
                at += 1
            if letter != "D":
                turn = "assistant" if lines[-1][:1] == "u" else "user"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check_repairs(spark, table):
    got = {r.conv_id: tuple(r)[1:] for r in R.repairs(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got == plain_repairs(table)


def test_repairs_of_given_tables(spark, small):
    table = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    check_repairs(spark, table)


def test_repairs_of_odd_rows(spark):
    rng = random.Random(3)
    text = ["Yes.", "no", "", " \t", "Why?!", "x" * 3000 + ".", "é.", None, "a. ", "b."]
    role = ["user", "assistant", "system", "tool", None, "", "User", "user", "assistant"]
    table = [(c, rng.choice([None, *range(6)]), rng.choice(role), rng.choice(text)) for c in (*range(-3, 40), None) for _ in range(rng.randrange(1, 9))]
    table += [(100, t, "user", "again.") for t in range(60)] + [(101, 5, "assistant", "same")] * 30 + [(102, None, "system", "a.")]
    check_repairs(spark, table)
    wide = spark.createDataFrame([(*r, "other", 1) for r in table], SCHEMA + ", audit string, copies int")
    assert {r.conv_id: tuple(r)[1:] for r in R.repairs(wide).collect()} == plain_repairs(table)
    assert R.repairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_edits_of_long_conversations():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 10, 50, 400):
        for _ in range(20 if n < 50 else 3):
            rows = [(rng.choice("suuuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            rows = [(i, go, cut and not go) for i, go, cut in rows]
            assert R.repair(bytes(R.code_of(*r) for r in rows)) == cheapest(rows)


def plain_trie(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    nodes, ended, length = defaultdict(list), defaultdict(list), {}
    for rows in convs.values():
        rows.sort(key=key)
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        turns = [(r, t) for _, r, t in convs.get(base, [])[:h] + convs[c][h:]]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ended[tuple(turns)].append(c)
    child = defaultdict(list)
    for x in nodes:
        length[x] = len(x[-1][1]) if x else 0
        if x:
            child[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(nodes, key=len, reverse=True):
        leaves[x] = sum(leaves[y] for y in child[x]) or 1
        saved[x] = (len(nodes[x]) - 1) * length[x] + sum(saved[y] for y in child[x])
    return sorted((min(m), len(x), min(nodes[x[:-1]]) if x else -1, len(m), len(child[x]), leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ended[x]))).encode()).hexdigest()) for x, m in nodes.items())


def check_trie(spark, frame, table):
    got = sorted(tuple(-1 if v is None else v for v in r) for r in T.trie(spark, frame).collect())
    assert got == plain_trie(table)


def test_trie_of_given_tables(spark, small):
    frame = spark.read.parquet(f"{small}/conversations.parquet")
    check_trie(spark, frame, [tuple(r) for r in frame.collect()])


@pytest.mark.parametrize("turns", [1, 2, 4])
def test_trie_of_odd_rows(spark, monkeypatch, turns):
    monkeypatch.setattr(T, "TURNS", turns)
    rng = random.Random(turns)
    table = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é\U0001f600", "", None, "long " * 500])) for c in (*range(30), *range(100, 130), *range(250, 260), -7) for t in (None, *range(rng.randrange(9)))]
    table += [(300 + c, t, "user", f"turn {t}") for c in range(40) for t in range(21)] + [(None, 1, "user", "x")] + [(3, 2, "user", "b")] * 3
    check_trie(spark, spark.createDataFrame(table, SCHEMA), table)
    wide = spark.createDataFrame([(*r, "other", 1) for r in table], SCHEMA + ", node string, depth int")
    check_trie(spark, wide, table)
    assert T.trie(spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_same_as_sql(spark, small, name):
    import duckdb

    from cirque.llm import queries as Q

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = Q.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, r, strict=True))})" for r in want.fetchall())
