"""Similarity of names and compatibility of types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fixed


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel(a: str, b: str) -> float:
    """Normalised insert-delete similarity, 0 to 1: 2 * lcs / (len(a) + len(b))."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    """The best similarity of the shorter text to a window of the longer one (windows at the ends may be shorter)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 1.0
    best = max(indel(a, w) for w in {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))})
    if len(a) == len(b):  # neither is the shorter one
        best = max(best, *(indel(b, w) for w in {a[max(0, i) : i + len(b)] for i in range(1 - len(b), len(a))}))
    return best


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The better of sorted-token and token-set similarity."""
    common, only_a, only_b = _token_sets(a, b)
    if common and (not only_a or not only_b):
        return 1.0
    best = indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    left, right = f"{common} {only_a}".strip(), f"{common} {only_b}".strip()
    best = max(best, indel(left, right))
    return max(best, indel(common, left), indel(common, right)) if common else best


def partial_token_ratio(a: str, b: str) -> float:
    common, only_a, only_b = _token_sets(a, b)
    if common:
        return 1.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(only_a, only_b))


def weighted(a: str, b: str) -> float:
    """Weighted ratio, 0 to 1: plain, token and (for lengths that differ) partial similarity, each with its weight."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(indel(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(indel(a, b), scale * partial(a, b), 0.95 * scale * partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Half the insert-delete similarity and half the weighted ratio of two names, case ignored."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a.fillna("").str.lower(), b.fillna("").str.lower(), strict=True):
        if (x, y) not in known:
            known[x, y] = 0.5 * indel(x, y) + 0.5 * weighted(x, y)
        out.append(known[x, y])
    return pd.Series(out, dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, case ignored: a stand-in that stays in the JVM."""
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b))


def type_family(kind: Column) -> Column:
    lower = F.lower(kind)
    return F.when(lower.rlike("|".join(fixed.NUMERIC_TYPES)), "number").when(lower.rlike("|".join(fixed.STRING_TYPES)), "text").when(lower.rlike("|".join(fixed.DATE_TYPES)), "time")


def types_compatible(a: Column, b: Column) -> Column:
    """Unknown types fit all; else types are equal or contain words of one family."""
    unknown = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    both = F.lit(False)
    for family in (fixed.NUMERIC_TYPES, fixed.STRING_TYPES, fixed.DATE_TYPES):
        both = both | (F.lower(a).rlike("|".join(family)) & F.lower(b).rlike("|".join(family)))
    return unknown | F.coalesce((F.lower(a) == F.lower(b)) | both, F.lit(False))
