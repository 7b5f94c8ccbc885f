"""Similarity joins of short texts (names, values) by q-grams, with bounds that lose no pair.

Two measures are served: those that are at most the insert-delete similarity 2 L / (|a| + |b|), L being the longest
common subsequence. With a least similarity t, L is at least t (|a| + |b|) / 2; what isn't in L was deleted from a or
inserted into b. A deleted letter spoils at most q of a's q-grams, an inserted one at most q - 1 more, so a and b share at
least |a| - q + 1 - q (|a| - L) - (q - 1) (|b| - L) q-grams (repeated ones counted). Pairs that share as many are found by
the rarest grams of each side alone (prefix filter), counted, and only then measured.

Pairs of grams are used where that bound is over 0; single letters, of which L are shared, for the rest: very short
texts, or a low t.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Similarities are compared with this tolerance when bounds are made, so that rounding loses nothing.
EPS = 1e-9
#: The bound of bigrams grows with the length only for a t above this.
BIGRAMS = 2 / 3


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of two texts, case ignored: twice the letters in matching blocks by all letters.

    Blocks are those of the standard library, which looks for them in the second text; so the order of the two counts.
    """
    known: dict[tuple[str, str], float] = {}
    for x, y in zip(a.fillna("").str.lower(), b.fillna("").str.lower(), strict=True):
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
    return pd.Series([known[p] for p in zip(a.fillna("").str.lower(), b.fillna("").str.lower(), strict=True)], dtype="float64")


def _shared(a: str, b: str, q: int, t: float) -> str:
    """SQL for the q-grams that texts of lengths a and b with an insert-delete similarity of t or more share at least."""
    common = f"ceil({t}D * ({a} + {b}) / 2 - {EPS})"
    return f"({a} - {q - 1} - {q} * ({a} - {common}) - {q - 1} * ({b} - {common}))"


def _best_shared(a: str, b: str, q: int, t: float) -> str:
    """The bound holds with either text as the first one."""
    return f"greatest({_shared(a, b, q, t)}, {_shared(b, a, q, t)})"


def _lengths(n: str, t: float) -> str:
    """SQL for the lengths of texts that one of length n can be similar to."""
    share = f"{t}D / (2 - {t}D)"
    return f"sequence(greatest(1, cast(ceil({n} * {share} - {EPS}) AS int)), cast(floor({n} / ({share}) + {EPS}) AS int))"


def _grams(q: int) -> str:
    """SQL for the q-grams of x, each with the number of equal ones before it, so that repeated ones differ."""
    all_of = f"transform(sequence(1, length(x) - {q - 1}), i -> substring(x, i, {q}))"
    return f"if(length(x) < {q}, array(), aggregate({all_of}, struct(cast(map() AS map<string,int>) AS seen, cast(array() AS array<string>) AS out), (s, g) -> struct(map_concat(map_filter(s.seen, (k, v) -> k <> g), map(g, coalesce(s.seen[g], 0) + 1)) AS seen, array_append(s.out, concat(g, coalesce(s.seen[g], 0))) AS out), s -> s.out))"


def _found_by(a: str, b: str, q: int, t: float) -> str:
    """SQL that tells whether pairs of texts of these lengths are looked for by q-grams."""
    return f"({_best_shared(a, b, 2, t)} {'>' if q == 2 else '<='} 0)" if t > BIGRAMS else "true"


def _prefixed(texts: DataFrame, often: DataFrame, q: int, t: float) -> DataFrame:
    """(x, n, grams, g): each text with the grams of its prefix: so many of the rarest that a similar text must have one of them."""
    other = f"filter({_lengths('n', t)}, m -> {_found_by('n', 'm', q, t)})"
    least = f"array_min(transform({other}, m -> {_best_shared('n', 'm', q, t)}))"
    each = texts.where(F.expr(f"size({other}) > 0")).select("x", "n", "grams", F.expr(f"size(grams) - greatest(1, {least}) + 1").cast("int").alias("p"))
    counted = each.select("x", "n", "grams", "p", F.explode("grams").alias("g")).join(often, "g", "left")
    first = counted.groupBy("x").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("p").alias("p"), F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("by"))
    return first.select("x", "n", "grams", F.explode(F.expr("slice(by, 1, p)")).alias("y")).select("x", "n", "grams", "y.g")


def candidates(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b): every pair of texts, compared in lower case, with an insert-delete similarity of t or more, and few others.

    left: a; right: b. Null and empty texts have no pairs; equal ones in lower case are pairs. t is over 0.
    """
    if not 0 < t <= 1:
        raise ValueError("t must be over 0 and at most 1")
    found = None
    texts = {side: df.select(F.lower(c).alias("x")).where("x <> ''").distinct().withColumn("n", F.length("x")) for side, df, c in (("a", left, "a"), ("b", right, "b"))}
    for q in (2, 1) if t > BIGRAMS else (1,):
        one = {side: df.withColumn("grams", F.expr(_grams(q))) for side, df in texts.items()}
        often = one["b"].select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
        a, b = (_prefixed(one[side], often, q, t) for side in ("a", "b"))
        pairs = a.select("g", F.col("x").alias("la"), F.col("n").alias("na"), F.col("grams").alias("ga")).join(b.select("g", F.col("x").alias("lb"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "g")
        pairs = pairs.where(f"2 * least(na, nb) >= {t}D * (na + nb) - {EPS}").where(_found_by("na", "nb", q, t))
        pairs = pairs.dropDuplicates(["la", "lb"]).where(f"size(array_intersect(ga, gb)) >= {_best_shared('na', 'nb', q, t)}").select("la", "lb")
        found = pairs if found is None else found.union(pairs)
    a, b = left.select("a").distinct().withColumn("la", F.lower("a")), right.select("b").distinct().withColumn("lb", F.lower("b"))
    return found.join(a, "la").join(b, "lb").select("a", "b")


def similar(left: DataFrame, right: DataFrame, least: float, measure: Column | None = None, bound: float | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs with measure(a, b) of `least` or more.

    measure: a column over a and b, matching_blocks unless given; bound: the least insert-delete similarity of a pair that
    has it, `least` unless given.
    """
    score = measure if measure is not None else matching_blocks("a", "b")
    return candidates(left, right, least if bound is None else bound).withColumn("similarity", score).where(F.col("similarity") >= least)
