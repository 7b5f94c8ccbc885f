"""Source divergence audit: how far the term distributions of the sources of a language lie apart, by sorted streams.

1. Each task turns its documents into rows (lang, term, source, document, docs, n): a row stands for the documents of one
   source, from `document` on, that the task has read in one slice, with the number of those that hold the term and its
   occurrences, so that frequent terms are small before anything is shuffled.
2. Rows are dealt by (lang, term, source) and sorted by (lang, term, source, document). A run of equal lang, term and
   source is scanned and gives its document frequency and count. A hot term of a hot source has at most a row for each
   slice.
3. Runs are dealt by (lang, term) and sorted by source. A scan sees the sources of a term after each other, at most as many as
   there are sources; terms in enough documents of the language are kept.
4. Kept terms with their probabilities are scanned once more. Each run of a term emits its partial pairs, added up in the task: what two
   sources that both have the term differ by from sources that have it alone; and the sources' foremost terms. Terms that
   a source lacks have one probability for each source, so what they add follows from how many terms a source has with
   each count: the dense table of terms and sources is never made.

All arithmetic is on integers: shares are in billionths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, slices_of_bytes

#: A term is kept in a language where so many documents hold it; terms of a source are listed to this rank.
LEAST_DOCS, TOP = 10, 10
#: Bytes of text that are counted at a time: what a slice's rows are pre-aggregated over.
AT_ONCE = 16 << 20
#: Partial pairs that a task holds before it adds them up, and after which it emits them.
HELD, EMIT = 1 << 20, 1 << 19

#: Bytes of terms, lower-cased; all others are spaces.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

_COUNTS = "lang string, term string, source string, document long, docs long, n long"
_RUNS = "lang string, term string, source string, docs long, n long"


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with terms in lower case and spaces between them; a table of bytes does it, since all separators are ASCII."""
    texts = texts.cast(pa.large_string()).fill_null("")
    first, last = (int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + i]) for i in (0, len(texts))) if len(texts) else (0, 0)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] - first
    data = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]] if last > first else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTS for each slice of documents (lang, source, text)."""
    document = TaskContext.get().partitionId() << 33
    for b in slices_of_bytes(batches, "text", AT_ONCE):
        words = pc.ascii_split_whitespace(_spaced(b.column("text")))
        size = pc.list_value_length(words).to_numpy()
        flat = words.flatten()
        row = np.repeat(np.arange(len(size)), size)
        full = pc.not_equal(flat, "")  # what stands before the first separator and after the last
        coded, row = flat.filter(full).dictionary_encode(), row[full.to_numpy(zero_copy_only=False)]
        if len(coded):
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
            first = np.full(len(names), len(size), np.int64)
            np.minimum.at(first, group, np.arange(len(size)))
            code = coded.indices.to_numpy().astype(np.int64)
            many = len(coded.dictionary)
            in_doc, n = np.unique(row * many + code, return_counts=True)
            key = group[in_doc // many] * many + in_doc % many
            key, at = np.unique(key, return_inverse=True)
            docs, total = np.bincount(at, minlength=len(key)), np.bincount(at, n, minlength=len(key)).astype(np.int64)
            g, term = key // many, coded.dictionary.take(pa.array(key % many)).cast(pa.string())
            known = list(names)
            lang, source = (pa.array([x[i] for x in known], pa.string()).take(pa.array(g)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, term, source, pa.array(first[g] + document), pa.array(docs, pa.int64()), pa.array(total)], names=["lang", "term", "source", "document", "docs", "n"])
        document += b.num_rows


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of _COUNTS by runs of lang, term and source, with document frequency and count; a run may span batches."""
    names, held = ["lang", "term", "source"], None
    for b in batches:
        if not b.num_rows:
            continue
        starts = np.flatnonzero(_changes(*(b.column(c) for c in names)))
        docs, n = (np.add.reduceat(b.column(c).to_numpy(), starts) for c in ("docs", "n"))
        keys = [b.column(c).take(pa.array(starts)) for c in names]
        if held is not None:
            if all(h[0].as_py() == k[0].as_py() for h, k in zip(held[:3], keys, strict=True)):
                docs[0] += held[3]
                n[0] += held[4]
            else:
                yield pa.RecordBatch.from_arrays([*held[:3], pa.array([held[3]]), pa.array([held[4]])], names=[*names, "docs", "n"])
        held = [*(k[-1:] for k in keys), int(docs[-1]), int(n[-1])]
        yield pa.RecordBatch.from_arrays([*(k[:-1] for k in keys), pa.array(docs[:-1]), pa.array(n[:-1])], names=[*names, "docs", "n"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held[:3], pa.array([held[3]]), pa.array([held[4]])], names=[*names, "docs", "n"])


def term_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n): document frequency and occurrences of each term in each source of each language."""
    counts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(_counted, _COUNTS)
    dealt = counts.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(_runs, _RUNS)


def _kept(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (lang, term), those of terms in `least` documents or more; the last term waits for the next batch."""
        wait: list[pa.RecordBatch] = []

        def chosen(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            column = lambda c: rows.column(c).chunk(0) if rows.num_rows else pa.array([], rows.schema.field(c).type)
            starts = np.flatnonzero(_changes(column("lang"), column("term")))
            total = np.add.reduceat(column("docs").to_numpy(), starts) if len(starts) else np.empty(0, np.int64)
            keep = np.repeat(total >= least, np.diff(np.append(starts, rows.num_rows)))
            return pa.RecordBatch.from_arrays([column(c).filter(pa.array(keep)) for c in ("lang", "term", "source", "n")], names=["lang", "term", "source", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            last = int(np.flatnonzero(_changes(b.column("lang"), b.column("term")))[-1])
            if wait and last == 0 and all(b.column(c)[0].as_py() == wait[-1].column(c)[0].as_py() for c in ("lang", "term")):
                wait.append(b)
                continue
            yield chosen(pa.Table.from_batches([*wait, b.slice(0, last)]))
            wait = [b.slice(last)]
        if wait:
            yield chosen(pa.Table.from_batches(wait))

    return run


def kept_terms(runs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n) of the terms in at least so many documents of their language."""
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(_kept(least), "lang string, term string, source string, n long")


def share(n: Column, total: Column, v: Column) -> Column:
    """p: the smoothed share of a term with n of total occurrences, among v terms, in billionths and one more."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * v))


def distance(p: Column, q: Column) -> Column:
    """f: the square of the difference by the sum, rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pairs and terms of rows (lang, term, sid, p, p0, q) sorted by (lang, term).

    Pairs (lang, a, b, null, value): over terms that sources a < b both have, f(pa, pb) - f(pa, b0) - f(a0, pb) + f(a0, b0).
    Terms (lang, a, null, term, value): at most TOP of a source with p over the language's q, the task's foremost.
    """
    lang, base = None, {}
    pairs: list[np.ndarray] = []
    size = 0
    best: dict[int, list[tuple[int, str]]] = {}

    def added() -> np.ndarray:
        x = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
        order = np.lexsort((x[:, 1], x[:, 0]))
        x = x[order]
        if not len(x):
            return x
        starts = np.flatnonzero(np.append(True, (x[1:, :2] != x[:-1, :2]).any(1)))
        return np.column_stack([x[starts, :2], np.add.reduceat(x[:, 2], starts)])

    def row(a: np.ndarray, b: list | np.ndarray, term: list, value: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(term, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "term", "value"])

    def flush() -> Iterator[pa.RecordBatch]:
        x = added()
        yield row(x[:, 0], x[:, 1], [None] * len(x), x[:, 2])
        found = [(a, t, v) for a, some in best.items() for v, t in _foremost(some)]
        yield row([a for a, _, _ in found], [None] * len(found), [t for _, t, _ in found], [v for _, _, v in found])

    def term_rows(rows: pa.RecordBatch) -> None:
        nonlocal size, pairs
        sid, p, p0, q = (rows.column(c).to_numpy() for c in ("sid", "p", "p0", "q"))
        starts = np.append(np.flatnonzero(_changes(rows.column("term"))), rows.num_rows)
        terms = rows.column("term").take(pa.array(starts[:-1])).to_pylist()
        own = _f(p, q)
        for term, i, j in zip(terms, starts[:-1], starts[1:], strict=True):
            s, x, zero = sid[i:j], p[i:j], p0[i:j]
            if len(s) > 1:
                a, b = np.triu_indices(len(s), 1)
                v = _f(x[a], x[b]) - _f(x[a], zero[b]) - _f(zero[a], x[b]) + _f(zero[a], zero[b])
                pairs.append(np.column_stack([s[a], s[b], v]))
                size += len(v)
            for k in range(i, j):
                if p[k] > q[k]:
                    some = best.setdefault(int(sid[k]), [])
                    some.append((int(own[k]), term))
                    if len(some) >= 32 * TOP:
                        best[int(sid[k])] = _foremost(some)

    wait = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([x for x in (wait, b) if x is not None]).combine_chunks().to_batches()[0]
        edges = np.append(np.flatnonzero(_changes(rows.column("lang"), rows.column("term"))), rows.num_rows)
        wait = rows.slice(int(edges[-2]))
        done = rows.slice(0, int(edges[-2]))
        for part in _by_lang(done):
            if part.column("lang")[0].as_py() != lang:
                if lang is not None:
                    yield from flush()
                lang, pairs, size, best = part.column("lang")[0].as_py(), [], 0, {}
            term_rows(part)
            if size > HELD:
                pairs = [added()]
                size = len(pairs[0])
                if size > EMIT:
                    yield row(pairs[0][:, 0], pairs[0][:, 1], [None] * size, pairs[0][:, 2])
                    pairs, size = [], 0
    if wait is not None:
        if wait.column("lang")[0].as_py() != lang:
            if lang is not None:
                yield from flush()
            lang, pairs, size, best = wait.column("lang")[0].as_py(), [], 0, {}
        term_rows(wait)
        yield from flush()


def _by_lang(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    edges = np.append(np.flatnonzero(_changes(rows.column("lang"))), rows.num_rows) if rows.num_rows else [0]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield rows.slice(int(i), int(j - i))


def _foremost(some: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The TOP highest values; of equal ones the terms that come first in UTF-8."""
    return sorted(some, key=lambda x: (-x[0], x[1].encode()))[:TOP]


def audit(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has each other source of the language, part 'term' the foremost terms.

    Null texts, languages and sources count as empty ones, repeated rows as documents of their own. Every group of lang
    and source that occurs has its pairs, with or without terms; without kept terms in a language all values are 0. Ties
    are in the order of the items' UTF-8 bytes. An empty table gives no rows; other columns aren't carried.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    kept = cut(kept_terms(term_runs(rows), least), "kept")
    # one row for each language, one for each group; sid numbers a language's sources
    langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0))
    groups = cut(groups.withColumn("sid", F.row_number().over(W.partitionBy("lang").orderBy("source"))), "groups")

    lang_n = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    known = kept.join(lang_n, ["lang", "term"]).join(groups, ["lang", "source"])
    known = known.select("lang", "term", "sid", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    known = cut(known, "known")
    dealt = known.repartition("lang", "term").sortWithinPartitions("lang", "term", "sid")
    partials = cut(dealt.select("lang", "term", "sid", "p", "p0", "q").mapInArrow(_partials, "lang string, a int, b int, term string, value long"), "partials")

    # what a's terms add to a pair as long as b lacks them: a source's terms of equal count are alike
    counts = known.groupBy("lang", "sid", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("b0"), F.col("terms").alias("b_terms"))
    alone = counts.join(other, "lang").where("sid <> b").groupBy("lang", F.col("sid").alias("a"), "b").agg(F.sum(F.col("times") * distance(F.col("p"), F.col("b0"))).alias("value"))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    neither = groups.select("lang", F.col("sid").alias("a"), F.col("p0").alias("a0"), "terms", "v").join(other, "lang").where("a < b")
    neither = neither.select("lang", "a", "b", F.when(F.col("v") > 0, (F.col("v") - F.col("terms") - F.col("b_terms")) * distance(F.col("a0"), F.col("b0"))).otherwise(0).alias("value"))
    values = partials.where("b IS NOT NULL").select("lang", "a", "b", "value").union(alone).union(neither).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = values.select("lang", "a", "b", "value").union(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select(F.col("lang").alias("l"), F.col("sid"), F.col("source").alias("name"))
    named = lambda df, c, to: df.join(names, (F.col("lang") == F.col("l")) & (F.col(c) == F.col("sid"))).drop("l", "sid", c).withColumnRenamed("name", to)
    pairs = named(named(both, "a", "source"), "b", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = named(partials.where("b IS NULL").drop("b"), "a", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP))
