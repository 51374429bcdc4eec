"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``, by a square-root checkpointed DP.

A row is one byte for the DP: its role's initial (s, u, a or another) and whether it must go or is truncated. Going
backward over a conversation's bytes, a vector holds for each of the four states (nothing yet, s, u, a) the cost of the
cheapest edits of what follows. Only the vectors at every sqrt(n)-th row are stored; walking forward, the vectors of one
block at a time are computed again and the least letter that keeps the cost is taken, so that the edits are the
ASCII-least of the cheapest. Vectors less their least value are few, so steps are looked up.

Two sorted streams give this to tasks, both dealt by conversation: the first has a row's key and byte and gathers one byte a
row, no more than the audit that comes out of it; the second has the texts, which pass one by one below their
conversation's audit into its digest. A digest and an audit of one conversation are each one value, so a conversation is
one task's stream; texts are never gathered.

Odd rows: null role, text, turn and conv_id read as one space where damage is drawn and in what is kept; null turns come
first and count in no gap; rows with one turn are ordered by role, the text's first 64 characters and its MD5; repeated
rows are later copies, so duplicates; a null conv_id is a conversation of its own; other roles than s, u and a initials
are never kept; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .conversations import ORDER, placed

#: The states after no role, s, u and a; the state an inserted or re-roled turn leads to; costs.
START, S, U, A = range(4)
FORCED = (U, U, A, U)
KEPT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"


def code_of(initial: str, must_go: bool, cut: bool) -> int:
    """0 to 3 for s, u, a and other initials, plus 4 where the row must go, else 8 where it is truncated."""
    return {"s": 0, "u": 1, "a": 2}.get(initial, 3) + (4 if must_go else 8 * cut)


def kept_to(code: int) -> dict[int, int]:
    """The state that keeping a row leads to from each state in which it may be kept."""
    return KEPT.get("sua?"[code & 3], {}) if not code & 4 else {}


def settled(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    """The least cost, and the costs above it once turns may be inserted."""
    for _ in range(3):
        costs = [min(c, costs[FORCED[q]] + INSERT) for q, c in enumerate(costs)]
    low = min(costs)
    return low, tuple(c - low for c in costs)


LAST = settled([0, 1 << 30, 1 << 30, 0])[1]


@lru_cache(None)
def back(after: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    """What a row adds to the least cost, and the vector before it."""
    extra = TRUNCATED * (code >= 8)
    costs = [DELETE + c for c in after]
    if not code & 4:
        keep = kept_to(code)
        for q in range(4):
            costs[q] = min(costs[q], after[FORCED[q]] + REROLE + extra, after[keep[q]] + extra if q in keep else 1 << 30)
    return settled(costs)


@lru_cache(None)
def walk(after: tuple[int, ...], code: int, q: int) -> tuple[str, int]:
    """The least letters up to and with a row's own, and the state behind it."""
    low, before = back(after, code)
    extra, left, out = TRUNCATED * (code >= 8), before[q] + low, ""
    keep = kept_to(code)
    while True:
        if after[q] + DELETE == left:
            return out + "D", q
        if before[FORCED[q]] + low + INSERT == left:
            out, q, left = out + "I", FORCED[q], left - INSERT
            continue
        if q in keep and after[keep[q]] + extra == left:
            return out + "K", keep[q]
        return out + "R", FORCED[q]


def repair(codes: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least edits of a conversation, with sqrt(n) vectors at a time."""
    n = len(codes)
    size = isqrt(n) + 1
    marks, v, cost = {n: LAST}, LAST, 0
    for i in range(n - 1, -1, -1):
        low, v = back(v, codes[i])
        cost += low
        if i % size == 0:
            marks[i] = v
    q, out = START, []
    total = cost + v[START]
    for begin in range(0, n, size):
        end = min(begin + size, n)
        vectors = [marks[end]]
        for i in range(end - 1, begin, -1):
            vectors.append(back(vectors[-1], codes[i])[1])
        for i in range(begin, end):
            letters, q = walk(vectors.pop(), codes[i], q)
            out.append(letters)
    return total, "".join(out) + ("", "II", "I", "")[q]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, draw and copies after damage, with the columns of ``placed``; dropped rows have no copies.

    ``draw`` is the CRC-32 of conv_id:turn mod 20: 0 drops a row, 1 empties its text, 2 takes out its full stops, question
    and exclamation marks, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.cast("int").alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.withColumn("text", text).withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1)
    return x.select("conv_id", "turn", "role", "text", copies.alias("copies"), *placed("turn", "role", "text"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows of ``damaged`` without their texts, equal ones as one, with initial, blank, cut and whether role and text come earlier."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = rows.select("conv_id", "turn", *ORDER, "copies", F.substring("role", 1, 1).alias("initial"), (F.length(end) == 0).alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    keys = slim.groupBy("conv_id", "turn", *ORDER).agg(F.sum("copies").alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # of rows with one role and text the one with the least turn is the first
    kept = keys.where("copies > 0")
    place = F.struct("o1", "o2")
    firsts = kept.groupBy("conv_id", "o3", "o5").agg(F.min(place).alias("p"))
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("o3").alias("f_role"), F.col("o5").alias("f_text"), F.col("p.o1").alias("f1"), F.col("p.o2").alias("f2"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("o3") == F.col("f_role")) & (F.col("o5") == F.col("f_text")) & (F.col("o1") == F.col("f1")) & (F.col("o2") == F.col("f2"))
    return keys.join(firsts, same, "left").withColumn("earlier", F.col("f_role").isNull()).drop("f_conv", "f_role", "f_text", "f1", "f2")


def _by_conversation(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``damaged`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    slim = _by_conversation(judged(rows).select("conv_id", "turn", *ORDER, "copies", "initial", "blank", "cut", "earlier"), *ORDER)
    slim = slim.select("conv_id", "turn", "copies", "initial", "blank", "cut", "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, known = None, [], lru_cache(1 << 14)(repair)

        def over() -> None:
            codes = bytes(at["codes"])
            cost, audit = known(codes) if len(codes) <= 64 else repair(codes)
            gaps = at["last"] - at["first"] + 1 - at["turns"] if at["turns"] else 0
            out.append((at["id"], gaps, *at["n"], at["illegal"], cost, audit))

        for b in batches:
            for conv, turn, copies, initial, blank, cut, earlier in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is None or conv != at["id"]:
                    if at is not None:
                        over()
                    at = {"id": conv, "first": None, "last": None, "turns": 0, "n": [0, 0, 0], "illegal": 0, "prior": None, "codes": bytearray()}
                if not copies:
                    continue
                if turn is not None and turn != at["last"]:
                    at["first"] = turn if at["first"] is None else at["first"]
                    at["last"], at["turns"] = turn, at["turns"] + 1
                if at["prior"] is not None and at["prior"] + initial not in ("su", "ua", "au"):
                    at["illegal"] += 1
                at["prior"] = initial
                at["illegal"] += copies - 1
                if blank:
                    at["n"][0] += copies
                    at["codes"] += bytes([code_of(initial, True, False)]) * copies
                    continue
                later = copies - (not earlier)
                at["n"][1] += later
                if not earlier:
                    at["n"][2] += cut
                    at["codes"].append(code_of(initial, False, cut))
                at["codes"] += bytes([code_of(initial, True, False)]) * later
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                out.clear()
        if at is not None:
            over()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    target = f"conv_id {kind}, {', '.join(f'{n} long' for n in names[1:-1])}, audit string"
    schema = to_arrow_schema(StructType.fromDDL(target))
    return slim.mapInArrow(run, target)


class Digest:
    """The SHA-256 of a repaired conversation whose rows come one by one in order."""

    def __init__(self, audit: str):
        self.hash, self.audit, self.at, self.next, self.empty = hashlib.sha256(), audit, 0, "user", True

    def _line(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())
        self.next = "assistant" if role[:1] == "u" else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self.next, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._line(role if letter == "K" else self.next, text)

    def hexdigest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation after damage."""
    rows = damaged(conversations)
    found = audits(rows)
    none = lambda kind: F.lit(None).cast(kind)
    result = F.struct(*found.columns[1:])
    heads = found.select("conv_id", F.lit(True).alias("head"), result.alias("found"), none("string").alias("role"), none("string").alias("text"), F.lit(1).alias("copies"), *(none(rows.schema[c].dataType).alias(c) for c in ORDER))
    body = rows.where("copies > 0").select("conv_id", F.lit(False).alias("head"), none(heads.schema["found"].dataType).alias("found"), "role", "text", "copies", *ORDER)
    both = _by_conversation(heads.unionByName(body), F.col("head").desc(), *ORDER).select("conv_id", "head", "found", "role", "text", "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for b in batches:
            for conv, head, one, role, text, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if head:
                    if at is not None:
                        out.append(at | {"repaired_sha256": digest.hexdigest()})
                    at, digest = {"conv_id": conv} | one, Digest(one["audit"])
                else:
                    for _ in range(copies):
                        digest.row(role, text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if at is not None:
            out.append(at | {"repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    target = f"conv_id {kind}, {', '.join(f'{n} long' for n in found.columns[1:-1])}, audit string, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(target))
    return both.mapInArrow(run, target)
