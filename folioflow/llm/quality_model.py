"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features of a text are its words' 1- and 2-grams and the 1- and 2-grams of the words' shapes (letters,
digits and each symbol, runs collapsed), hashed to ``2 ** bits`` buckets; a bucket's value is its count
over the square root of the number of features. Training is FTRL-Proximal with per-coordinate rates,
one pass after another over the labelled rows in hash order, in one task that holds the sparse vectors of at
most ``max_rows`` rows (the bound of the labelled sample; 8 bytes for each different bucket of a text, 2 MB at
most). The vectors are made where the texts are read. The weights are 2 ** bits floats whatever the
corpus; each text's score is one sparse dot product, and all texts are scored whole.

A row with several labels counts once per label; labels other than 0 and 1 don't count.

Null and empty texts score as the bias alone. Without both labels the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import bounded_batches
from folioflow.llm.textkit import SPACE, Words, buffers, mix, ngrams, release, slices

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the hashed n-grams of each text, repeats included."""
    data, offsets = buffers(texts)
    words = Words(data, offsets, SPACE, True)
    shape = _CLASS[data]
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[offsets[offsets < len(shape)]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    shapes = Words(shape[fresh], before[offsets], SPACE, False)
    parts, docs = [], []
    for salt, w in enumerate((words, shapes)):
        doc = w.doc
        for n in (1, 2):
            grams = ngrams(w.hash, n)
            inside = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
            parts.append(mix(grams[inside] + np.uint64(7 * salt + n)) >> np.uint64(64 - bits))
            docs.append(doc[: len(grams)][inside])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    counts = np.bincount(doc, minlength=len(texts))
    return np.concatenate(parts)[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-Proximal over (buckets, values, label); the last weight is the bias."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    positive = sum(y for *_, y in rows)
    if not 0 < positive < len(rows):
        return w
    for _ in range(epochs):
        for i, x, y in rows:
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - sigma * wi
            n[i] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _vectors(batches, bits: int):
    """(order, label, buckets, counts, size): a text's different buckets and how often each is there."""
    for b in slices(batches):
        buckets, first = features(b.column("text"), bits)
        parts = [np.unique(buckets[i:j], return_counts=True) for i, j in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("order"), b.column("label"), pa.array([i.astype(np.int32).tobytes() for i, _ in parts], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in parts], pa.binary()), pa.array(np.diff(first), pa.int64())],
            names=["order", "label", "buckets", "counts", "size"],
        )


def _train(batches, bits: int, **options):
    rows = []
    for b in batches:
        for i, c, y, size in zip(*(b.column(k).to_pylist() for k in ("buckets", "counts", "label", "size"))):
            x = np.append(np.frombuffer(c, np.float32) / np.float32(np.sqrt(max(1, size))), np.float32(1))
            rows.append((np.append(np.frombuffer(i, np.int32), np.int32(1 << bits)), x, int(y)))
    weights = train(rows, bits, **options)
    del rows
    release()
    yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], names=["weights"])


def fit(texts: DataFrame, bits: int = 18, epochs: int = 5, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, max_rows: int = 20_000) -> np.ndarray:
    """Weights from rows (order, text, label); of more than ``max_rows`` the first by ``order``."""
    bounded_batches(texts.sparkSession)

    def vectors(batches):
        return _vectors(batches, bits)

    def run(batches):
        return _train(batches, bits, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)

    known = texts.where("label in (0, 1)").select(F.col("order").cast("bigint").alias("order"), F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    found = known.mapInArrow(vectors, "order bigint, label int, buckets binary, counts binary, size bigint")
    sample = found.orderBy("order", "buckets", "counts", "label").limit(max_rows).coalesce(1)
    row = sample.mapInArrow(run, "weights array<double>").first()
    return np.array(row[0]) if row else np.zeros((1 << bits) + 1)


def score_batch(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    buckets, first = features(texts, bits)
    size = np.diff(first)
    total = np.zeros(len(size))
    some = size > 0
    if some.any():  # each text's sum on its own, so that no other text's features move it
        total[some] = np.add.reduceat(weights[buckets], first[:-1][some]) / np.sqrt(size[some])
    return 1 / (1 + np.exp(-np.clip(total + weights[-1], -35, 35)))


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, score): the probability of label 1 for every row of df, its columns in ``row``."""
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score_batch(b.column("text"), shared.value))], names=["row", "score"])

    return src.mapInArrow(run, f"row {kind}, score double")


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(order, text, label) of the rows that may be learned from: crc32 of the id mod 5 is not 0. At
    most ``max_rows`` labels, by the hash of their ids, look up their texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.expr("crc32(cast(id as string)) % 5 <> 0") & F.col("label").isin(0, 1))
    known = known.withColumn("order", F.xxhash64("id")).orderBy("order", "id", "label").limit(max_rows)
    return docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).join(known, "id").select("order", "text", "label")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    weights = fit(labelled(docs, labels))
    got = score(docs.select("doc_id", "text"), weights)
    return got.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.expr("crc32(cast(row.doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
