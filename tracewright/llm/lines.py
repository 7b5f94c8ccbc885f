"""Line dedup by winnowing over line hashes, with DataFrame functions only.

1. Each non-blank line gets a hash of its lower-cased text with white space folded, and its number of words.
2. Windows: each line that has MIN_WORDS words alone; from each line on, the fewest lines, two or more, that reach
   MIN_WORDS words; and the same backwards from each line. The place of a window's least line hash is selected. Neighbouring
   windows mostly select the same place, so few places are: they are the fingerprints, and each is kept with its windows.
3. Fingerprints that stand at one place only are dropped with their windows. The positions of the others are joined: each
   with the first one that agrees with it in a whole window. A frequent line is the minimum of many different windows;
   without the window, pairs of all its places would be their square, and its first place alone may lie in another context.
4. Matches of two texts on one diagonal are put together and extended both ways, line hash by line hash, as far as the
   texts agree. What a text repeats of an earlier place is deleted.

This is all of every run of MIN_WORDS words or more that equals an earlier one: any two neighbours in such a run lie in a
window inside it, the first line's forward window, their own, or the last line's backward one, and equal windows select
the same place, so they meet the first of their kind, which stood earlier. The work is linear in lines, but for the
extension, which reads a text's lines once for each run it shares with another.
Every line's first place stays, since a line is only deleted where an equal one stands earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: A repeated run goes if it has at least so many words.
MIN_WORDS = 50

_LINES = """
  filter(
    transform(split(coalesce(text, ''), '\n'), (x, i) -> struct(
      xxhash64(lower(trim(regexp_replace(x, '\\\\s+', ' ')))) AS h,
      regexp_count(x, '\\\\S+') AS w,
      i AS i)),
    x -> x.w > 0)
"""


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines): one row per different (doc_id, text); lines are non-blank: hash h, words w, place i in the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.expr(_LINES).alias("lines")).where("size(lines) > 0").dropDuplicates(["doc_id", "th"])


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, at, h, windows): the selected places of the texts, the line hash there, and the windows that select them.

    windows: struct(k, s, e), the hash of a window's whole sequence and its first and last line, counted among the non-blank ones.
    """
    each = lines.select("doc_id", "th", F.posexplode("lines").alias("p", "x")).select("doc_id", "th", "p", "x.h", F.col("x.w").cast("long").alias("w"))
    doc = W.partitionBy("doc_id", "th")
    each = each.withColumn("upto", F.sum("w").over(doc.orderBy("p"))).withColumn("before", F.col("upto") - F.col("w"))
    order = doc.orderBy("before")
    ahead, back = order.rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    following = {"hs": F.collect_list("h").over(ahead), "words": F.sum("w").over(ahead), "next_h": F.lead("h").over(order)}
    each = each.withColumns(following).withColumns({"back_hs": F.collect_list("h").over(back), "back_words": F.sum("w").over(back)})

    def window(hs: Column, s: Column) -> Column:
        least = s + F.array_position(hs, F.array_min(hs)).cast("int") - 1
        return F.struct(least.alias("at"), F.array_min(hs).alias("h"), F.struct(F.xxhash64(hs).alias("k"), s.alias("s"), (s + F.size(hs) - 1).alias("e")).alias("x"))

    long, p = F.col("w") >= min_words, F.col("p")
    alone = F.when(long, window(F.array("h"), p))
    forward = F.when(long & F.col("next_h").isNotNull(), window(F.array("h", "next_h"), p)).when(~long & (F.col("words") >= min_words), window(F.col("hs"), p))
    # where the lines before the last one don't reach min_words, or it does alone, the window is its first line's forward one
    backward = F.when(~long & (F.col("back_words") - F.col("w") >= min_words), window(F.col("back_hs"), p - F.size("back_hs") + 1))
    found = each.select("doc_id", "th", F.explode(F.filter(F.array(alone, forward, backward), lambda x: x.isNotNull())).alias("y"))
    # still dealt by text; a line is the minimum of windows that hold it, of which there are few
    return found.groupBy("doc_id", "th", "y.at").agg(F.first("y.h").alias("h"), F.collect_list("y.x").alias("windows"))


def candidates(selected: DataFrame) -> DataFrame:
    """(h, k, doc_id, th, s, e): the windows of fingerprints that stand at two places or more."""
    shared = selected.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("shared"))
    return selected.join(shared, F.col("h") == F.col("shared")).select("h", "doc_id", "th", F.explode("windows").alias("x")).select("h", "x.k", "doc_id", "th", "x.s", "x.e")


def _merged(found: DataFrame, *key: str) -> DataFrame:
    """(key, s, e): stretches that overlap, put together."""
    order = W.partitionBy(*key).orderBy("s")
    opens = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = found.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def _equal(a: str, b: str) -> str:
    """SQL for the number of elements in which two arrays agree from their starts on."""
    return f"cast(array_position(concat(zip_with({a}, {b}, (x, y) -> x <=> y AND x IS NOT NULL), array(false)), false) - 1 AS int)"


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): for texts with runs to delete, runs as struct(s, e), first and last place among the text's lines."""
    lines = cut(line_table(docs), "lines")
    found = cut(candidates(cut(fingerprints(lines, min_words), "fingerprints")), "candidates")
    first = found.groupBy("h", "k").agg(F.min(F.struct("doc_id", "th", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("fh"), F.col("k").alias("fk"), "first")
    met = found.join(first, (found.h == first.fh) & (found.k == first.fk)).where("NOT (doc_id <=> first.doc_id AND th = first.th AND s = first.s)")
    met = met.select("doc_id", "th", "s", "e", F.col("first.doc_id").alias("from_id"), F.col("first.th").alias("from_th"), (F.col("first.s") - F.col("s")).alias("shift"))
    runs = _merged(met, "doc_id", "th", "from_id", "from_th", "shift").groupBy("doc_id", "th", "from_id", "from_th").agg(F.collect_list(F.struct("s", "e", "shift")).alias("met"))
    runs = cut(runs, "met")  # one row for two texts
    hashes = lambda to: lines.select(F.col("doc_id").alias(f"{to}_i"), F.col("th").alias(f"{to}_t"), F.expr("transform(lines, x -> x.h)").alias(to), *([F.expr("transform(lines, x -> x.i)").alias("places")] if to == "own" else []))
    own, source = hashes("own"), hashes("source")
    both = runs.join(own, F.col("doc_id").eqNullSafe(F.col("own_i")) & (F.col("th") == F.col("own_t"))).join(source, F.col("from_id").eqNullSafe(F.col("source_i")) & (F.col("from_th") == F.col("source_t")))
    back = _equal("reverse(slice(own, 1, m.s))", "reverse(slice(source, 1, m.s + m.shift))")
    on = _equal("slice(own, m.e + 2, size(own))", "slice(source, m.e + m.shift + 2, size(source))")
    extended = f"transform(met, m -> struct(places[m.s - {back}] AS s, places[m.e + {on}] AS e))"
    gone = both.select("doc_id", "th", F.explode(F.expr(extended)).alias("x")).select("doc_id", "th", "x.s", "x.e")
    return _merged(gone, "doc_id", "th").groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated runs cut out of text; columns n_lines and n_deleted are added (or replaced).

    The order of documents is that of doc_id (null first), then of a hash of the text; the earliest copy of a run stays.
    Null texts stay null, texts without a line of words stay as they are. Rows that agree in doc_id and text are one
    document and are treated alike; rows are never dropped, a text may become empty. Blank lines inside a deleted run go
    with it. Lines compare without regard to case and white space.
    """
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("run_id"), F.col("th").alias("run_th"), F.col("runs").alias("run_list"))
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))  # whatever its columns are called
    joined = row.join(runs, F.col("row.doc_id").eqNullSafe(F.col("run_id")) & (F.xxhash64("row.text") == F.col("run_th")), "left")
    left = F.expr("CASE WHEN run_list IS NOT NULL THEN filter(split(row.text, '\n'), (x, i) -> NOT exists(run_list, r -> i BETWEEN r.s AND r.e)) END")
    n = F.size(F.split(F.coalesce("row.text", F.lit("")), "\n"))
    out = joined.select("row", left.alias("left"), n.alias("n"))
    kept = [F.coalesce(F.array_join("left", "\n"), "row.text").alias("text") if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    return out.select(*kept, F.col("n").alias("n_lines"), F.coalesce(F.col("n") - F.size("left"), F.lit(0)).alias("n_deleted"))
