"""Embeddings of names and descriptions, and similarity search, without Python in the hot path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.answers import Provider, ask

#: Texts that a provider of embeddings gets at a time.
BATCH = 50
#: Candidates ranked, least similarity, and characters of a description that are embedded and shown.
CANDIDATES, LEAST, EMBEDDED, SHOWN = 200, 0.3, 500, 200
DIMENSIONS = 64
#: Vectors of a block of a matrix product.
BLOCK = 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if one has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((norm(x) == 0) | (norm(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """An embedding without a model: words and their character trigrams are counted by hash into signed dimensions."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda ws: F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substring(w, i, F.lit(3)))))
    hashed = lambda ws: F.transform(F.concat(ws, grams(ws)), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))
    sign = lambda h: F.when(F.floor(h / dimensions) % 2 == 0, 1.0).otherwise(-1.0)
    counted = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(hs, F.lit(0.0), lambda s, h: s + F.when(h % dimensions == d, sign(h)).otherwise(0.0)).cast("float"))
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731 - a text is hashed once, not for each dimension
    return once(words, lambda ws: once(hashed(ws), counted))


def search(tables: DataFrame, query: Column, limit: int = 10, name: str = "table_name", vector: str = "vector", candidates: int | None = CANDIDATES, least: float = LEAST) -> DataFrame:
    """tables nearest to the query vector, with similarity: the first candidates by name (None: all) are ranked, the best
    `limit` taken, and of those the ones that reach the least similarity (rounded to 4 places) returned."""
    there = F.col(vector).isNotNull() & (F.size(vector) > 0)
    some = tables if candidates is None else tables.where(there).orderBy(name).limit(candidates)
    # rows without a vector rank last and reach nothing: a filter on the vector would have it made twice
    return some.withColumn("similarity", F.when(there, F.round(cosine(F.col(vector), query), 4))).orderBy(F.desc("similarity"), name).limit(limit).where(F.col("similarity") >= least)


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name_keys, name_rows): vectors in blocks of about BLOCK, by a hash of the key; those without a length are left out."""
    at = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x)) AND exists(v, x -> x <> 0)")
    n = max(1, -(-at.count() // BLOCK))
    return at.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).select(F.col("x.k").alias(f"{name}_keys"), F.col("x.v").alias(f"{name}_rows"))


def top_k(questions: DataFrame, stored: DataFrame, k: int, question: str = "question_id", key: str = "key", vector: str = "vector", places: int = 9) -> DataFrame:
    """(question, key, similarity): the k stored vectors nearest to each question by cosine, of equal ones those with the least key.

    Blocks of questions meet blocks of stored vectors; a pair of blocks is one matrix product that leaves k rows a question,
    which are then ranked. Keys and question ids are numbers, each once; similarities are rounded to so many places. Vectors
    that are null, zero, of another length, or hold nulls or NaN match nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, s = ([(kk, np.asarray(v)) for kk, v in zip(b.column(f"{x}_keys")[i].values.to_pylist(), (r.values.to_numpy() for r in b.column(f"{x}_rows")[i].values), strict=True)] for x in ("q", "s"))
                for size in {len(v) for _, v in q}:
                    ask, have = [x for x in q if len(x[1]) == size], [x for x in s if len(x[1]) == size]
                    if not have:
                        continue
                    unit = [np.stack([v for _, v in x]) / np.linalg.norm(np.stack([v for _, v in x]), axis=1, keepdims=True) for x in (ask, have)]
                    close = np.round(unit[0] @ unit[1].T, places)
                    best = np.argsort(-close, axis=1, kind="stable")[:, :k]  # keys ascend, so equal ones stay in their order
                    keys = np.array([x[0] for x in have], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in ask], best.shape[1]), pa.int64()), pa.array(keys[best].ravel()), pa.array(np.take_along_axis(close, best, 1).ravel())], names=[question, key, "similarity"])

    # the questions are asked of all rows, block by block
    tiles = _blocks(stored, key, vector, "s").crossJoin(_blocks(questions, question, vector, "q"))
    near = tiles.mapInArrow(run, f"{question} long, {key} long, similarity double")
    order = W.partitionBy(question).orderBy(F.desc("similarity"), key)
    return near.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def search_text(tables: DataFrame, text: str, limit: int = 10, candidates: int | None = CANDIDATES) -> DataFrame:
    """search() for a text over tables (schema_name, table_name, description), embedded without a model.

    candidates: so many described tables, the first by name, are embedded and ranked; None: all of them.
    """
    described = tables.where(F.coalesce("description", F.lit("")) != "")
    if candidates is not None:  # every text has a vector, so these are the ones that search() ranks
        described = described.orderBy("table_name").limit(candidates)
    else:  # the rows are small, their vectors take time: dealt anew, or one task would embed a whole file
        described = described.repartition(4 * tables.sparkSession.sparkContext.defaultParallelism)
    described = described.withColumn("vector", hashed_embedding(F.substring("description", 1, EMBEDDED)))
    asked = tables.sparkSession.range(1).select(hashed_embedding(F.lit(text[:EMBEDDED])).alias("vector")).first().vector
    found = search(described, F.array(*(F.lit(float(x)) for x in asked)), limit, candidates=candidates)
    return found.select(F.coalesce(F.nullif("schema_name", F.lit("")), F.lit("public")).alias("schema_name"), "table_name", F.substring("description", 1, SHOWN).alias("description"), "similarity")


def vectorise_by(df: DataFrame, text: Column, provider: Provider, store: str, vector: str = "vector", batch: int = BATCH) -> DataFrame:
    """df with vectors from a provider for the rows that have none, and error where it failed.

    The provider gets texts, BATCH at a time, and returns a JSON array of numbers for each; see answers.ask(). Texts are
    asked for once, by this run and by later ones on the same store; null and blank ones aren't and have no vector.
    """
    lacks = F.col(vector).isNull() | (F.size(vector) == 0)
    prompt = F.when(lacks & (F.trim(F.coalesce(text, F.lit(""))) != ""), text)
    asked = ask(df.select(F.struct("*").alias("row"), lacks.alias("lacks"), prompt.alias("prompt")), provider, store, batch)
    made = F.when(F.col("lacks"), F.from_json("answer", "array<float>")).otherwise(F.col("row")[vector])
    return asked.select(*(made.alias(c) if c == vector else F.col("row")[c].alias(c) for c in df.columns if c != "error"), "error")


def vectorise(df: DataFrame, text: Column, vector: str = "vector", missing_only: bool = True, limit: int | None = None) -> DataFrame:
    """df with vectors filled in: of the rows without one, or all; limit: so many of them, by the order of the rows' keys."""
    lacks = F.col(vector).isNull() | (F.size(vector) == 0)
    todo = lacks if missing_only else F.lit(True)
    if limit is not None:
        keys = [c for c in df.columns if c != vector]
        chosen = df.where(todo).select(*keys).orderBy(*keys).limit(limit).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_todo"))
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        df = df.join(F.broadcast(chosen), on, "left").drop(*(f"_{k}" for k in keys))  # at most `limit` rows
        todo = F.coalesce("_todo", F.lit(False))
    return df.withColumn(vector, F.when(todo, hashed_embedding(text)).otherwise(F.col(vector))).drop("_todo")
