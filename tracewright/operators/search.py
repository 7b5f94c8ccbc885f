"""Searches over values, tables and past questions that rank or relax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import similar, vectors

#: Shortest prefix tried, weights of past questions, and the scores that reuse or adapt one.
SHORTEST, WEIGHTS, REUSE, ADAPT = 2, (0.5, 0.3, 0.2), 0.9, 0.7
#: Least similarity of a term to a stored value.
VALUE = 0.8


def by_prefix(values: DataFrame, keyword: str, column: str, limit: int = 20) -> DataFrame:
    """(value, used): values that contain the keyword or, if none does, its longest prefix of two letters or more that some do.

    One scan: each value gets the longest prefix it contains, then only those with the longest of all are kept.
    """
    word = F.lower(F.lit(keyword))
    sizes = F.sequence(F.lit(len(keyword)), F.lit(min(SHORTEST, len(keyword))), F.lit(-1))
    held = F.get(F.filter(F.transform(sizes, lambda n: F.substring(word, F.lit(1), n)), lambda p: F.contains(F.lower(column), p)), F.lit(0))
    found = values.select(F.col(column).alias("value"), held.alias("used")).where(F.col("used").isNotNull()).distinct()
    best = found.agg(F.max(F.length("used")).alias("best"))  # one row
    return found.join(F.broadcast(best), F.length("used") == F.col("best")).drop("best").orderBy("value").limit(limit)


def ranked(tables: DataFrame, importance: DataFrame) -> DataFrame:
    """tables (table_name, similarity) with importance and score, the harmonic mean of both, the best first."""
    imp = F.coalesce("importance", F.lit(0.0))
    score = 2 * (F.col("similarity") * imp) / (F.col("similarity") + imp + 1e-9)
    return tables.join(importance.select("table_name", "importance"), "table_name", "left").withColumn("score", score).orderBy(F.desc("score"), "table_name")


def past_questions(found: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The most similar of found (key, similarity, success_rate, usage), by the least key among equals, with final_score, rank and what to do with the best."""
    a, b, c = WEIGHTS
    score = a * F.col("similarity") + b * F.col("success_rate") + c * F.col("usage")
    out = found.orderBy(F.desc("similarity"), key).limit(limit).withColumn("final_score", score)
    action = F.when(F.col("final_score") > REUSE, "IMMEDIATE_TEMPLATE_REUSE").when(F.col("final_score") > ADAPT, "ADAPT_TEMPLATE").otherwise("GENERATE_NEW")
    return out.withColumns({"rank": F.rank().over(W.orderBy(F.desc("final_score"))), "action": action})  # over the few that are left


def recalled(questions: DataFrame, stored: DataFrame, k: int = 50, **names: str) -> DataFrame:
    """(question_id, key, final_score, rank, action): the k stored questions nearest to each question by their vectors, re-ranked.

    questions: question_id, vector; stored: key, vector, success_rate, usage. See vectors.top_k().
    """
    a, b, c = WEIGHTS
    near = vectors.top_k(questions, stored, k, **names)
    scored = near.join(stored.select("key", "success_rate", "usage"), "key").withColumn("final_score", F.round(a * F.col("similarity") + b * F.col("success_rate") + c * F.col("usage"), 9))
    action = F.when(F.col("final_score") > REUSE, "IMMEDIATE_TEMPLATE_REUSE").when(F.col("final_score") > ADAPT, "ADAPT_TEMPLATE").otherwise("GENERATE_NEW")
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("final_score"), "key"))  # over k rows
    return scored.select("question_id", "key", "final_score", rank.alias("rank"), action.alias("action"))


def error_hints(message: Column) -> Column:
    """Columns that a database error names: the missing one and the one it proposes."""
    missing = F.regexp_extract(message, r'column "(\w+)" does not exist', 1)
    meant = F.regexp_extract(message, r'Perhaps you meant to reference the column "(\w+)"."(\w+)"', 1)
    column = F.regexp_extract(message, r'Perhaps you meant to reference the column "(\w+)"."(\w+)"', 2)
    return F.filter(F.array(missing, F.when(meant != "", F.concat(meant, F.lit("."), column)).otherwise("")), lambda x: x != "")


def map_values(terms: DataFrame, values: DataFrame, least: float = VALUE, measure: Column | None = None, bound: float | None = None) -> DataFrame:
    """(term, value, kind): each term's stored value: the equal one, else the most similar of all, the least of several.

    Similarity is the share of letters in matching blocks, case ignored, unless measure (over a, the term, and b, the value)
    and its bound are given, see similar.similar(). Terms without a similar value have no row.
    """
    v = values.select("value").where(F.col("value").isNotNull()).distinct()
    exact = terms.select("term").distinct().join(v, F.col("term") == F.col("value")).select("term", "value", F.lit("EXACT").alias("kind"))
    rest = terms.select("term").where("term IS NOT NULL").distinct().join(exact, "term", "left_anti")
    near = similar.similar(rest.select(F.col("term").alias("a")), v.select(F.col("value").alias("b")), least, measure, bound)
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("x"))
    return exact.unionByName(best.select(F.col("a").alias("term"), F.col("x.b").alias("value"), F.lit("SIMILAR").alias("kind")))


def existing(mapped: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings whose value stands in its column, the others). mapped: table_name, column_name, value and more; stored: those three.

    A column has any number of equal values; a mapping is checked against the different ones.
    """
    at = ["table_name", "column_name", "value"]
    have = stored.select(*at).distinct()
    return mapped.join(have, at, "left_semi"), mapped.join(have, at, "left_anti")
