"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A text is cut by the vocabulary's pattern and each piece is encoded by itself, so a piece met before needs no second
call: a task keeps the ids of short pieces (at most ``CACHE`` of them, then it starts anew) and hands the library only
unseen ones, a batch at a time. Decoding maps each token's printable characters back through the byte table; bytes are
joined before they are read as UTF-8, so characters split over several tokens come out whole.

Results for odd rows: null and empty texts have no tokens and decode to empty; special tokens are never produced,
their strings in a text are ordinary text. Rows that repeat or share an id are encoded each; an empty table gives an
empty one; ``encode`` passes other columns through, ``round_trip`` does not read them.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

CACHE, SHORT = 400_000, 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder for a byte-level vocabulary file of the ``tokenizers`` library."""

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True
        self.split = regex.compile(pattern).findall
        self.pieces = self.library.model.tokenize
        self.printable = dict(enumerate(byte_characters()))
        back = {c: b for b, c in enumerate(byte_characters())}
        table = self.library.get_vocab(with_added_tokens=True)
        special = {self.library.token_to_id(t.content): t.content for t in self.library.get_added_tokens_decoder().values()}
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.bytes_of[i] = special[i].encode() if i in special else bytes(back[c] for c in token)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        known = self.known
        pieces = [self.split(x) for x in texts]
        new = list(set().union(*pieces).difference(known)) if pieces else []
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(set().union(*pieces))
        for piece in new:
            tokens = self.pieces(piece.encode().decode("latin-1").translate(self.printable))
            known[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        out = [b"".join([known[p] for p in x]) for x in pieces]
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token; a token with a part of a character holds that character."""
        i = np.frombuffer(ids, "<u4")
        end = np.cumsum([len(self.bytes_of[k]) for k in i.tolist()], dtype=np.int64)
        if not len(i):
            return end, end
        data = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        start = np.concatenate([[0], end[:-1]])
        return char[start], char[end - 1] + 1


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(vocabulary, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ids array<int> and, if asked for, starts and ends array<int> (characters of each token)."""
    C.prepare(docs.sparkSession)
    more = {"ids": pa.list_(pa.int32())} | ({"starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())} if offsets else {})
    kept = [c for c in docs.columns if c not in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in C.slices(batches, text):
            ids = c.encode([x or "" for x in b.column(text).to_pylist()])
            columns = [b.column(k) for k in kept] + [pa.array([np.frombuffer(x, "<i4") for x in ids], more["ids"])]
            if offsets:
                at = [c.offsets(x) for x in ids]
                columns += [pa.array([x[k] for x in at], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *more])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), *(f"{k} array<int>" for k in more)])
    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded`` with decoded (the bytes) and text (the bytes as UTF-8, with U+FFFD for what is not) in place of ids."""
    kept = [c for c in encoded.columns if c not in ("ids", "starts", "ends", "decoded", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            got = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(got, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in got])], names=[*kept, "decoded", "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema.fields), "decoded binary", "text string"])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, and digests of both."""
    C.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in C.slices(batches, "text"):
            ids = c.encode([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(c.decode(x)) for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
