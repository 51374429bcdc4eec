"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

``statistics`` reads each text once and gives ``NAMES``. ``fit`` sums first and second moments for each class in Spark,
shrinks each class covariance toward the pooled one and that toward a multiple of the identity, and keeps Cholesky
factors; ``score`` turns the difference of the Mahalanobis log densities into a probability.

Labels come from all labelled rows of the training folds. Results for odd rows: a null or empty text has statistics of
zero and is scored like any other; labels that are null, or for unknown documents, are not used; of several labels for
a document the greatest counts; without two classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
NAMES = ["words", "word_length", "symbols", "upper", "digits", "distinct", "repeats", "pairs", "symbol_words", "lines", "line_length", "top_byte", "stops"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    per = lambda mask: np.bincount(doc[mask], minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbol = (data > 32) & (data < 127) & ~letter & ~digit & (data != 44) & (data != 46)
    start, end, of = C.word_spans(data, offsets)
    words = np.bincount(of, minlength=n)
    h = C.word_hashes(C.lower(data), start, end)
    same = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else np.zeros(0, bool)

    def distinct(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, who))
        k, w = keys[order], who[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]) if len(k) else np.zeros(0, bool)
        return np.bincount(w[first], minlength=n)

    pair = C.joined(h, 2)[: max(0, len(h) - 1)]
    in_text = same[1:] if len(same) else same
    pairs, total = distinct(pair[in_text], of[:-1][in_text] if len(of) else of), np.bincount(of[:-1][in_text] if len(of) else of, minlength=n)
    hits = np.concatenate([[0], np.cumsum(symbol)])
    odd = hits[end] > hits[start]
    lines = per(data == 10) + 1
    logit = lambda p, k: np.log((p * k + 0.5) / (k - p * k + 0.5))
    most = np.zeros(n)
    for i in np.flatnonzero(size):
        most[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)[33:].max(initial=0) / size[i]
    x = np.stack([
        np.log1p(words), np.log1p(share(size, words)), np.sqrt(share(per(symbol), size)), np.sqrt(share(per(upper), size)), np.sqrt(share(per(digit), size)),
        share(distinct(h, of), np.maximum(words, 1) ** 0.85), np.sqrt(share(np.bincount(of[1:][in_text & (h[1:] == h[:-1])] if len(of) else of, minlength=n), words)), share(pairs, total),
        np.sqrt(share(np.bincount(of[odd], minlength=n), words)), np.log1p(share(lines * 100, size)), np.log1p(share(words, lines)), most, logit(share(per((data == 46) | (data == 44)), words + 1), words + 1) / 4,
    ], 1)
    return np.where(size[:, None] > 0, x, 0.0)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f, an array of the statistics of each text."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            x = statistics(*C.utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<double>")


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> dict:
    """The model of ``rows`` (f, label): for each class its prior, mean and inverse Cholesky factor."""
    d = len(NAMES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)), *(F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"q{i}_{j}") for i, j in upper)).collect()
    model: dict = {"prior": 0.5, "classes": {}}
    count = {r["label"]: r["n"] for r in sums}
    if sums:
        model["prior"] = count.get(1, 0) / sum(count.values())
    if len(count) < 2 or min(count.values()) < 2:
        return model
    moments = {}
    for r in sums:
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        cov = np.zeros((d, d))
        for i, j in upper:
            cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
        moments[r["label"]] = (r["n"], mean, cov)
    pooled = sum(n * c for n, _, c in moments.values()) / sum(count.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    for label, (n, mean, cov) in moments.items():
        s = ((1 - shrink) * cov + shrink * pooled) / np.outer(scale, scale)
        s = (1 - ridge) * s + ridge * np.trace(s) / d * np.eye(d)
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        model["classes"][int(label)] = (n / sum(count.values()), mean, np.linalg.inv(factor) / scale, float(np.log(np.diag(factor)).sum()))
    return model


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    if not model["classes"]:
        return np.full(len(x), model["prior"])
    log = {}
    for label, (prior, mean, inverse, half_log) in model["classes"].items():
        z = (x - mean) @ inverse.T
        log[label] = np.log(prior) - 0.5 * (z * z).sum(1) - half_log
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fold(folds: int, rest: int):
    """Whether crc32 of the doc_id as text leaves ``rest``; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest, F.lit(False))


def labelled(labels: DataFrame, name: str) -> DataFrame:
    return labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0; such labels are never used), score and predicted."""
    C.prepare(docs.sparkSession)
    seen = features(docs).withColumn("held_out", fold(5, 0)).checkpoint()
    model = fit(seen.where(~F.col("held_out")).join(labelled(labels, "quality"), "doc_id").select("f", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = b.column("f")
                x = f.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                p = probability(x, model)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return seen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
