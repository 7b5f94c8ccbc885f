"""Toxicity: character n-gram linear classifier, features scaled by naive Bayes log-count ratios (Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Character n-grams of these lengths are hashed into BUCKETS features; a feature is present in a text or it isn't.
ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
#: Labelled training rows used per class at most: the bound of the sample that the classifier is fitted on.
TRAIN_ROWS_PER_CLASS = 3000
#: A feature enters the model if so many sample texts hold it and its log-count ratio is at least so far from 0.
MIN_TEXTS, MIN_RATIO = 5, 1.5
#: Characters that are turned into features at a time; bounds memory, not the text.
CHUNK = 1 << 18


@dataclass
class Model:
    weights: np.ndarray  # float32 by bucket, 0 for features outside the model
    bias: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin + self.bias, -30, 30)))


def _buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets): the bucket of the n-gram that starts at each place."""
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] ^ (h[: len(codes) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in ORDERS:
            yield n, (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 20)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, row of each code point), so many texts at a time that CHUNK is about reached.

    A text ends with a mark that no n-gram of the model spans: rows of both ends of an n-gram are compared.
    """
    start, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size >= CHUNK:
            if i > start:
                coded = [np.frombuffer(f" {(x or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts[start:i]]
                yield start, np.concatenate(coded), np.repeat(np.arange(i - start, dtype=np.int32), [len(x) for x in coded])
            start, size = i, 0
        if i < len(texts):
            size += len(texts[i] or "")


def features(texts: list[str | None], keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, keys): keys are sorted and distinct, row * BUCKETS + bucket, rows counted from the first. keep: buckets wanted."""
    for start, codes, rows in _groups(texts):
        found = []
        for n, b in _buckets(codes):
            at = np.flatnonzero(keep[b]) if keep is not None else np.arange(len(b))
            at = at[rows[at] == rows[at + n - 1]]
            found.append(rows[at].astype(np.int64) * BUCKETS + b[at])
        yield start, np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def fit(texts: list[str], labels: list[int], rounds: int = 300) -> Model:
    """Naive Bayes log-count ratios of n-gram presence, then L2-regularised logistic regression on the scaled features."""
    y = np.asarray(labels, np.float64)
    none = Model(np.zeros(BUCKETS, np.float32), 0.0)
    if not len(y) or y.min() == y.max():
        none.bias = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return none
    # Two passes over the texts: the first keeps counts alone, the second the few features that the model may use.
    pos, neg = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for start, keys in features(texts):
        one = y[start + (keys >> 20)] > 0
        np.add.at(pos, keys[one] & (BUCKETS - 1), 1)
        np.add.at(neg, keys[~one] & (BUCKETS - 1), 1)
    ratio = np.log(((pos + 1) / (y.sum() + 2)) / ((neg + 1) / ((1 - y).sum() + 2)))
    chosen = (pos + neg >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO)
    keys = np.concatenate([start * BUCKETS + k for start, k in features(texts, chosen)] or [np.empty(0, np.int64)])
    row, bucket = keys >> 20, keys & (BUCKETS - 1)
    names, col = np.unique(bucket, return_inverse=True)
    value = ratio[bucket]
    w, bias, n = np.zeros(len(names)), 0.0, len(y)
    balance = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))  # classes weigh alike while fitting
    scale = np.bincount(col, value**2, len(names)) / n + 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * value, n) + bias, -30, 30)))
        g = (p - y) * balance
        w -= 0.1 * (np.bincount(col, g[row] * value, len(names)) / n + 1e-4 * w) / np.sqrt(scale * max(1, np.sqrt(len(names))))
        bias -= 0.5 * g.mean()
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = w * ratio[names]
    return Model(weights, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows with crc32(doc_id) mod 5 other than 0, at most TRAIN_ROWS_PER_CLASS of each class.

    Several labels of one document: the highest holds. Which rows are taken depends on a hash of doc_id alone.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    taken = [known.where(f"toxic = {c}").orderBy("h", "doc_id").limit(TRAIN_ROWS_PER_CLASS).select(F.col("doc_id").alias("label_id"), "toxic") for c in (0, 1)]
    sample = F.broadcast(taken[0].union(taken[1]))  # bounded: 2 * TRAIN_ROWS_PER_CLASS rows of two numbers
    found = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits in one task over the bounded sample; the driver receives the model's nonzero weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            marks += b.column("toxic").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", marks[i]))
        m = fit([texts[i] for i in order], [marks[i] for i in order])
        at = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "weight": pa.array(np.append(m.weights[at], m.bias), pa.float64())})

    got = training_rows(docs, labels).repartition(1).mapInArrow(run, "bucket int, weight double").collect()
    weights = np.zeros(BUCKETS, np.float32)
    bias = 0.0
    for bucket, weight in got:
        if bucket < 0:
            bias = weight
        else:
            weights[bucket] = weight
    return Model(weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity, 0 to 1. Null and empty texts get the score of a text without features; rows stay as they are.

    A column of that name in docs is replaced. Texts are read whole, whatever their length.
    """
    at = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at], model.bias))
    kept = [c for c in docs.columns if c.lower() != "toxicity"]
    schema = docs.select(*kept).schema.add("toxicity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = sent.value
        weights, keep = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
        weights[at], keep[at] = values, True
        m = Model(weights, bias)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            margin = np.zeros(len(texts))
            for start, keys in features(texts, keep):
                part = np.bincount(keys >> 20, weights[keys & (BUCKETS - 1)])
                margin[start : start + len(part)] += part
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(m.score(margin))], names=[*kept, "toxicity"])

    return docs.select(*kept).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxicity, from a model trained on labels (doc_id, toxic) and the texts that they name."""
    return score(docs, train(docs.select("doc_id", "text"), labels))
