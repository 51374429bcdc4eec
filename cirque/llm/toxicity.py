"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of 3 to 6 characters of the lower-cased text is hashed into ``SLOTS`` slots; a text's features are the slots
it holds. From labelled texts come, for each slot, the smoothed log ratio of its share among toxic and other texts; the
``KEPT`` slots with the strongest association are scaled by it and a logistic regression is fitted on them.

Training uses at most ``SAMPLE`` labelled documents (those with the least hash of their id), a documented bound: only
that sample, one text of each id and ``KEPT`` features a row, reaches the driver. Scoring reads every whole text. Results for odd rows: null and empty
texts hold no n-gram and get the intercept's score; null labels and labels of unknown documents are not used; of several
labels of a document the greatest counts; without two classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import fold, labelled

U = np.uint64
SLOTS, KEPT, SAMPLE, SIZES = 1 << 17, 4096, 12_000, (3, 4, 5, 6)
#: Texts whose slots are marked at once while they are counted.
MARKED = 64
#: Rows of the fitted matrix that are numbers at once.
BLOCK = 64


def slots(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, text) of every n-gram, for each n; a space is put before and after each text."""
    n = len(offsets) - 1
    spaced = np.full(len(data) + 2 * n, 32, np.uint8)
    spaced[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = C.lower(data)
    code = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U)
    lead = np.concatenate([[0], np.cumsum((spaced & 0xC0) != 0x80)])
    begin = lead[offsets + 2 * np.arange(n + 1)]
    doc = np.repeat(np.arange(n), np.diff(begin))
    code = code[: len(doc)]
    h = code.copy()
    for k in range(1, max(SIZES)):
        if len(code) <= k:
            return
        h = h[: len(code) - k] * U(0x9E3779B97F4A7C15) + code[k:]
        if k + 1 in SIZES:
            same = doc[: len(code) - k] == doc[k:]
            x = h + U(k)
            yield ((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(47))[same].astype(np.int64), doc[: len(code) - k][same]


def held(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) of the n-grams whose slot has a place of 0 or more, by text."""
    pairs = []
    for slot, doc in slots(data, offsets):
        at = place[slot]
        keep = at >= 0
        pairs.append(doc[keep] * (int(place.max(initial=0)) + 1) + at[keep])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // (int(place.max(initial=0)) + 1), both % (int(place.max(initial=0)) + 1)


def logistic(rows: list[tuple[int, np.ndarray]], scale: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps over a matrix of ``SAMPLE`` x ``KEPT`` at most.

    The matrix holds a byte a slot; ``BLOCK`` rows at a time become numbers, and the weights are scaled, not the matrix.
    """
    y = np.array([label for label, _ in rows], np.float32)
    x = np.zeros((len(rows), len(scale)), np.uint8)
    for k, (_, at) in enumerate(rows):
        x[k, at] = 1
    scale = scale.astype(np.float32)
    block = np.empty((min(BLOCK, len(rows)), len(scale)), np.float32)
    w = np.zeros(len(scale), np.float32)
    v, bias, bias_v = w.copy(), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0
    bound = 0.25 * (float(sum(np.square(scale[at]).sum(dtype=np.float64) for _, at in rows)) / len(rows) + 1)
    rate = np.float32(1 / bound)
    for _ in range(steps):
        ahead, gradient, off = scale * (w + np.float32(0.9) * v), np.zeros(len(scale), np.float32), 0.0
        for i in range(0, len(x), BLOCK):
            part = block[: len(x) - i]
            part[...] = x[i : i + BLOCK]
            z = part @ ahead + np.float32(bias + 0.9 * bias_v)
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i : i + BLOCK]
            gradient += error @ part
            off += float(error.sum())
        v = np.float32(0.9) * v - rate * (gradient * scale / np.float32(len(y)) + np.float32(ridge) * w)
        bias_v = 0.9 * bias_v - float(rate) * off / len(y)
        w, bias = w + v, bias + bias_v
    return w * scale, bias


def one_each(labelled_docs: DataFrame) -> DataFrame:
    """text and label of one document of each doc_id, so that the bound on ids is one on rows: the text with the least MD5."""
    return labelled_docs.groupBy("doc_id").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    picked = labelled(labels, "toxic").where(~fold(4, 2)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    C.prepare(spark)
    sample = one_each(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).select("text", "label").repartition(12).checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, SLOTS), np.float64), np.zeros(2, np.int64)
        for wide in C.slices(batches, "text"):
            for b in (wide.slice(i, MARKED) for i in range(0, wide.num_rows, MARKED)):
                label = b.column("label").to_numpy()
                seen = np.zeros(b.num_rows * SLOTS, bool)
                for slot, doc in slots(*C.utf8(b.column("text"))):
                    seen[doc * SLOTS + slot] = True
                seen = seen.reshape(b.num_rows, SLOTS).view(np.uint8)
                for k in (0, 1):
                    total[k] += np.add.reduce(seen[label == k], 0, dtype=np.uint16)
                    n[k] += (label == k).sum()
        if n.sum():
            yield pa.RecordBatch.from_pydict({"n": [n.tobytes()], "total": [total.astype(np.uint32).tobytes()]})

    n, total = np.zeros(2, np.int64), np.zeros((2, SLOTS))
    for r in sample.mapInArrow(count, "n binary, total binary").collect():
        n += np.frombuffer(r["n"], np.int64)
        total += np.frombuffer(r["total"], np.uint32).reshape(2, SLOTS)
    model = {"share": float(n[1] / n.sum()) if n.sum() else 0.5, "place": None}
    if not n.all():
        return model
    expected = (total[0] + total[1]) * (n[1] / n.sum())
    strength = (total[1] - expected) ** 2 / np.maximum(expected, 1e-9) * ((total[0] + total[1]) >= min(5, n.sum()))
    best = np.sort(np.argsort(-strength, kind="stable")[:KEPT])
    place = np.full(SLOTS, -1, np.int64)
    place[best] = np.arange(len(best))
    p = (total[1] + 1) / (total[1] + 1).sum()
    q = (total[0] + 1) / (total[0] + 1).sum()
    ratio = np.log(p / q)[best]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            doc, at = held(*C.utf8(b.column("text")), place)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([at[i:j].astype("<u2").tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], names=["label", "at"])

    got = [(r["label"], np.frombuffer(r["at"], np.uint16)) for r in sample.mapInArrow(rows, "label int, at binary").collect()]
    got.sort(key=lambda x: (x[0], x[1].tobytes()))
    weight, bias = logistic(got, ratio)
    return model | {"place": place, "weight": weight, "bias": bias}


def probability(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    n = len(offsets) - 1
    if model["place"] is None:
        return np.full(n, model["share"])
    doc, at = held(data, offsets, model["place"])
    z = np.bincount(doc, model["weight"][at], n) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2; such labels are never used), score and predicted."""
    C.prepare(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            p = probability(*C.utf8(b.column("text")), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    seen = docs.select("doc_id", "text", fold(4, 2).alias("held_out"))
    return seen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    C.prepare(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            yield b.filter(pa.array(probability(*C.utf8(b.column("text")), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
