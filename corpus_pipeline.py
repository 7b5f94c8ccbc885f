"""The corpus pipeline: what one stage keeps is written as Parquet and is the next one's documents.

Stages: toxic documents go; repeated runs of lines are cut out of the texts (a text that was nothing else becomes empty
and stays); of each class of near-duplicates the document with the least doc_id stays; documents that hold a benchmark
item go; what is left is encoded, decoded again and described by its digests.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, jaccard, lines, queries, toxicity
from tracewright.llm.common import delete, passing, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("toxicity < 0.5").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a doc_id and texts without words have no class and stay; of repeated rows of a document one stays."""
    gone = jaccard.classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return left.withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("n-gram jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding", encode),
]

#: SQL expresses neither the classifier nor the encoder; tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with passing(spark):  # what a stage writes on its way goes when its result is there
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
