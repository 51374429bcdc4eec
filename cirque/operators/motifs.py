"""Degenerate motifs: words, expectation, and the scan of circular sequences on both strands."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The default motif, its substitution table, and the letters that each nucleotide code stands for.
MOTIF = "RNYKACANNYGTMRNY"
TABLE = {"R": "AG", "N": "ACGT", "Y": "CT", "K": "GT", "M": "AC"}
LETTERS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
TILE = 256 << 10


def motif_words(consensus: str = MOTIF, table: dict[str, str] = TABLE) -> int:
    return int(np.prod([len(table.get(c, c)) for c in consensus], dtype=object)) if consensus else 0


def motif_expectation(consensus: str = MOTIF, table: dict[str, str] = TABLE) -> float:
    return motif_words(consensus, table) / 4 ** len(consensus)


def expand_motif(spark: SparkSession, consensus: str = MOTIF, table: dict[str, str] = TABLE) -> DataFrame:
    """(idx, word): all words; the leftmost place varies slowest."""
    total = rest = motif_words(consensus, table)
    parts = []
    for c in consensus:
        letters = table.get(c, c)
        rest //= len(letters)
        parts.append(F.element_at(F.array(*map(F.lit, letters)), (F.floor(F.col("idx") / rest) % len(letters) + 1).cast("int")) if len(letters) > 1 else F.lit(letters))
    return spark.range(total).withColumnRenamed("id", "idx").select("idx", F.concat(*parts).alias("word"))


def _masks(motif: str) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each letter a place allows; the same of the reverse complement."""
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    fwd = np.array([sum(bit[x] for x in LETTERS[c]) for c in motif], np.uint8)
    swap = lambda v: (v & 1) << 3 | (v & 2) << 1 | (v & 4) >> 1 | (v & 8) >> 3
    return fwd, np.array([swap(int(v)) for v in fwd[::-1]], np.uint8)


def _place(df: DataFrame) -> list[str]:
    """What tells sequences apart: two assemblies may have a replicon of one name."""
    return [c for c in ("assembly", "replicon") if c in df.columns]


def _scan(sequences: DataFrame, shortest: int, longest: int, tile: int, find: Callable[[bytes], list[tuple[int, int, str]]]) -> DataFrame:
    """Sites (start, letters, strand) that ``find`` sees in the tiles of circular sequences; tiles overlap by ``longest`` - 1 letters.

    A tile's own starts are its first ``tile`` letters, or what the sequence has left; the last tile goes on over the origin.
    """
    place, n = _place(sequences), F.length("seq")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / tile).cast("int"))
    # the parts are cut before they are exploded, so that no row holds a whole sequence beside its part
    over = lambda t: F.least((t + 1) * tile, n) + longest - 1 - n
    part = lambda t: F.struct((t * tile).cast("long").alias("start"), F.concat(F.substring("seq", t * tile + 1, F.lit(tile + longest - 1)), F.when(over(t) > 0, F.substring("seq", F.lit(1), over(t))).otherwise("")).alias("part"))
    tiles = sequences.where(n >= shortest).select(*place, n.cast("long").alias("len"), F.explode(F.transform(starts, part)).alias("x"))
    cut = tiles.select(*place, "len", "x.start", "x.part")
    flip = bytes.maketrans(b"ACGT", b"TGCA")
    target = ", ".join([*(f"{c} string" for c in place), "len long, strand string, start_bound long, end_bound long, seq string"])
    schema = pa.schema([*((c, pa.string()) for c in place), ("len", pa.int64()), ("strand", pa.string()), ("start_bound", pa.int64()), ("end_bound", pa.int64()), ("seq", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for *where, length, at, text in zip(*(b.column(c).to_pylist() for c in (*place, "len", "start", "part")), strict=True):
                raw = text.encode("latin-1", "replace")
                for i, k, strand in find(raw):
                    if i < min(tile, length - at) and k <= length:
                        word = raw[i : i + k]
                        out.append((*where, length, strand, at + i, at + i + k, (word if strand == "Forward" else word.translate(flip)[::-1]).decode()))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut.mapInArrow(run, target)


def scan_motif(sequences: DataFrame, motif: str = MOTIF, tile: int = TILE) -> DataFrame:
    """(assembly,) replicon, len, strand, start_bound, end_bound, seq: every match of ``motif`` on both strands of circular ``sequences``.

    Sequences are (replicon, seq), or (assembly, replicon, seq) where several assemblies may share a name. Starts lie in
    0..len-1; a match over the origin ends beyond len. ``seq`` is the word as read on its own strand. Sequences shorter than
    the motif, null ones, and letters other than ACGT never match. Sequences are cut into tiles that overlap by the motif's
    length less one, so that tasks and Arrow batches stay small.
    """
    k = len(motif)
    fwd, rev = _masks(motif)
    code = np.zeros(256, np.uint8)
    for i, c in enumerate(b"ACGT"):
        code[c] = 1 << i

    def find(raw: bytes) -> list[tuple[int, int, str]]:
        x, out = code[np.frombuffer(raw, np.uint8)], []
        m = max(len(x) - k + 1, 0)
        for strand, mask in (("Forward", fwd), ("Reverse", rev)):
            ok = np.ones(m, bool)
            for j in range(k):
                ok &= (x[j : j + m] & mask[j]) > 0
            out += [(i, k, strand) for i in np.flatnonzero(ok).tolist()]
        return out

    return _scan(sequences, k, k, tile, find)


#: Two bits a base; other letters are 4. Words of a list at most, so that what goes to each task stays below 16 MB.
BASE = np.full(256, 4, np.uint8)
BASE[list(b"ACGT")] = range(4)
LONGEST, MOST = 31, 1 << 20


def rolling(base: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` letters from each place on as one number, two bits a letter; from runs of 1, 2, 4, .. letters."""
    kind = np.uint32 if k <= 16 else np.uint64
    n, run, width, out, done = len(base) - k + 1, base.astype(kind), 1, None, 0
    if n <= 0:
        return np.zeros(0, kind)
    while width <= k:
        if k & width:
            out = run[:n].copy() if out is None else (out << kind(2 * width)) | run[done : done + n]
            done += width
        if 2 * width <= k:
            run = (run[:-width] << kind(2 * width)) | run[width:]
        width *= 2
    return out


class WordList:
    """Words of one length as sorted numbers; for each whether it, or its reverse complement, is a word."""

    def __init__(self, words: list[str], k: int):
        base = BASE[np.frombuffer("".join(words).encode("ascii"), np.uint8)].reshape(-1, k)
        fwd = np.array([rolling(w, k)[0] for w in base])
        rev = np.array([rolling(3 - w[::-1], k)[0] for w in base])
        self.k, self.codes = k, np.unique(np.concatenate([fwd, rev]))
        self.forward, self.reverse = np.isin(self.codes, fwd), np.isin(self.codes, rev)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.slot(self.codes)] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, base: np.ndarray, bad: np.ndarray) -> list[tuple[int, int, str]]:
        """(place, letters, strand) of every match; ``bad`` counts the letters before each place that are not ACGT."""
        codes = rolling(base & 3, self.k)
        at = np.flatnonzero(self.seen[self.slot(codes)])
        at = at[bad[at] == bad[at + self.k]]
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[place] == codes[at]
        at, place = at[same], place[same]
        return [(i, self.k, s) for flag, s in ((self.forward, "Forward"), (self.reverse, "Reverse")) for i in at[flag[place]].tolist()]


def scan_words(sequences: DataFrame, words: list[str], tile: int = TILE) -> DataFrame:
    """Like ``scan_motif`` for a list of words of up to 31 letters, of one length or several: both strands in one pass.

    A word matches where it stands on either strand, so one with a palindrome matches twice. Repeated words count once, and
    words with letters other than ACGT never match.
    """
    words = sorted({w for w in words if set(w) <= set("ACGT")})
    if len(words) > MOST or any(not 0 < len(w) <= LONGEST for w in words):
        raise ValueError(f"a list has at most {MOST} words of 1 to {LONGEST} letters")
    by = {k: [w for w in words if len(w) == k] for k in {len(w) for w in words}}
    lists = [WordList(own, k) for k, own in sorted(by.items())]

    def find(raw: bytes) -> list[tuple[int, int, str]]:
        base = BASE[np.frombuffer(raw, np.uint8)]
        bad = np.concatenate([[0], np.cumsum(base == 4)])
        return [x for one in lists for x in one.find(base, bad)]

    return _scan(sequences, min(by, default=1), max(by, default=1), tile, find)


def spelled(code: str, k: int) -> Column:
    """The ``k`` letters of a number of two bits a letter, four at a time from a table; null for null."""
    parts = []
    for i in range(0, k, 4):
        m = min(4, k - i)
        table = F.lit(["".join(x) for x in product("ACGT", repeat=m)])
        parts.append(F.element_at(table, F.shiftright(code, 2 * (k - i - m)).bitwiseAND(F.lit(4**m - 1)).cast("int") + 1))
    return F.when(F.col(code).isNotNull(), F.concat(*parts))


def words_of(sequences: DataFrame, k: int = len(MOTIF), tile: int = TILE) -> DataFrame:
    """(word): the distinct runs of ``k`` letters of whole ``sequences`` (seq), from first letter to last and not over the origin.

    Sequences are cut into tiles that overlap by k - 1. Words travel as numbers of two bits a letter, those that a task meets
    again soon once; only words with letters other than ACGT, or of more than 31 letters, travel as text.
    """
    n = F.length("seq")
    starts = F.sequence(F.lit(0), F.floor((n - k) / tile).cast("int"))
    cut = sequences.where(n >= k).select(F.explode(F.transform(starts, lambda t: F.substring("seq", t * tile + 1, F.lit(tile + k - 1)))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = [np.zeros(0, np.int64)]
        words: set[str] = set()

        def out() -> pa.RecordBatch:
            known, text = np.unique(np.concatenate(codes)), list(words)
            codes[:] = [np.zeros(0, np.int64)]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(known), pa.nulls(len(text), pa.int64())]), pa.array([None] * len(known) + text, pa.string())], names=["code", "word"])

        for b in batches:
            for part in b.column("part").to_pylist():
                base = BASE[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
                m = len(base) - k + 1
                bad = np.concatenate([[0], np.cumsum(base == 4)])
                good = (bad[k : k + m] == bad[:m]) if k <= LONGEST else np.zeros(m, bool)
                if good.any():
                    codes.append(np.unique(rolling(base & 3, k)[good]).astype(np.int64))
                words.update(part[i : i + k] for i in np.flatnonzero(~good).tolist())
                if len(words) + sum(map(len, codes)) >= TILE:
                    yield out()
        yield out()

    found = cut.mapInArrow(run, "code long, word string").distinct()
    return found.select(F.coalesce("word", spelled("code", k)).alias("word")) if k <= LONGEST else found.select("word")


def mark_palindromes(sites: DataFrame) -> DataFrame:
    """``sites`` with dimension: Double where both strands match at one start of one replicon of one assembly."""
    return sites.withColumn("dimension", F.when(F.count("*").over(Window.partitionBy(*_place(sites), "start_bound")) > 1, "Double").otherwise("Single"))


def dedupe_sites(sites: DataFrame) -> DataFrame:
    """One row for each place; the forward strand is preferred."""
    w = Window.partitionBy(*_place(sites), "start_bound", "end_bound").orderBy(F.when(F.col("strand") == "Forward", 0).otherwise(1))
    return sites.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sort_sites(sites: DataFrame) -> DataFrame:
    """Sites in the order in which reports list them."""
    return sites.orderBy("replicon", "start_bound", "end_bound", "strand")
