"""Personal data: pattern spans, and terms that give protected entities away, with DataFrame functions only.

Patterns find the base spans. Each found value (an address, a number) is a protected entity; its context is the rest of
its line, on either side up to the next value of its kind. Over the whole corpus, the co-occurrence
of terms and entities estimates what a term discloses: the share of documents with the term that hold the entity in its
context, and the pointwise mutual information of both in bits. Terms over both thresholds, seen in enough different
contexts, are themselves spans wherever they occur. In sanitised texts base spans are generalised to their kind; terms
are generalised to a placeholder or removed.

A pair of a term and an entity is counted in the corpus only if the contexts allow it: its share is at most that among
the documents whose contexts hold the term, its bits are at most those of the entity alone.

Positions come from marking matches with two control characters and adding up lengths; those characters are first
replaced by a third in the text, one for one, so that positions stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "term")
#: A term is disclosed if, of documents that hold it, such a share holds one entity in its context, with so many bits of
#: mutual information, in so many different contexts.
LEAST_SHARE, LEAST_BITS, LEAST_CONTEXTS = 0.5, 4.0, 3
#: Marked parts that are added up at a time, so that the work on a text with very many values isn't the square of them.
CHUNK = 256

#: The base patterns. Possessive where nothing that follows could need a character back, and not starting inside a run
#: that has failed already: the matches are those of the plain patterns, in linear time and stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A cheap test that a text may hold the kind at all.
_MAY = {"email": "instr(t, '@') > 0", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9]'", "phone": "instr(t, '+') > 0"}
_TERM = r"[\\p{L}\\p{M}]+"
_SPANS = "array<struct<s:int,e:int,v:string>>"
_FOUND = "array<struct<s:int,e:int,v:string,near:string>>"
_MARKED, _REST = "substring_index(x, '\u0002', 1)", "substring_index({}, '\u0002', -1)"


def valid(kind: str, v: str = "v") -> str:
    """SQL that tells whether a match v counts."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    # doubled digits from the right, every second one; the sum of all must end in 0
    luhn = f"""aggregate(transform(split(reverse({digits}), ''), (c, i) ->
      if(i % 2 = 0, cast(c AS int), cast(c AS int) * 2 - if(cast(c AS int) > 4, 9, 0))), 0, (a, x) -> a + x) % 10 = 0"""
    return {
        "email": "true",
        "ip": f"{v} rlike '^{_BYTE}([.]{_BYTE}){{3}}$'",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }[kind]


def _near(before: str, after: str) -> str:
    """SQL for the context between two texts: their ends, within the line."""
    return f"concat(substring_index({before}, '\\n', -1), ' ', substring_index({after}, '\\n', 1))"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def _placed(keep: str, kind: str, more: str = "") -> str:
    """SQL for the spans of the column parts, a text split before each marked value: those that keep lets through.

    Lengths are added up within chunks of parts, then the lengths of the chunks. more: fields of a span besides s, e and v.
    """
    return f"""CASE WHEN size(parts) < 2 THEN cast(array() AS {kind}) ELSE flatten(aggregate(
      transform(sequence(0, cast((size(parts) - 2) div {CHUNK} AS int)), c ->
        aggregate(slice(parts, c * {CHUNK} + 2, {CHUNK}), struct(0 AS at, c * {CHUNK} AS i, cast(array() AS {kind}) AS out),
          (a, x) -> struct(a.at + length(x) - 1 AS at, a.i + 1 AS i,
            if({keep}, array_append(a.out, struct(a.at AS s, a.at + instr(x, '\u0002') - 1 AS e, {_MARKED} AS v{more})), a.out) AS out))),
      struct(length(parts[0]) AS at, cast(array() AS array<{kind}>) AS out),
      (b, y) -> struct(b.at + y.at AS at, if(size(y.out) = 0, b.out, array_append(b.out,
        transform(y.out, m -> struct(m.s + b.at AS s, m.e + b.at AS e, m.v AS v{", m.near AS near" if more else ""})))) AS out),
      b -> b.out)) END"""


def base_spans(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with th (hash of the text) and, per base kind, an array of struct(s, e, v, near) in order."""
    out = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002", "\u0003\u0003").alias("t"))
    for kind, pattern in PATTERNS.items():
        # Parts are looked at one by one only where a text has any; the marked text is split once.
        parts = f"CASE WHEN {_MAY[kind]} THEN split(regexp_replace(t, '{_quoted(pattern)}', '\u0001$0\u0002'), '\u0001') ELSE array() END"
        out = out.withColumn("parts", F.expr(parts)).withColumn(kind, F.expr(_placed(valid(kind, _MARKED), _FOUND, f", {_near(_REST.format('parts[a.i]'), _REST.format('x'))} AS near")))
    return out.drop("t", "parts")


def _terms(text: str) -> str:
    """SQL for the different terms of a text: lower-cased runs of letters. In scripts without spaces a run is what they write as one."""
    return f"array_distinct(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{M}}]+'), w -> w <> ''))"


def _term_counts(spans: DataFrame) -> tuple[DataFrame, int]:
    """(term, n_term) and the number of documents; rows that agree in doc_id and text are one document."""
    copies = spans.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    total = copies.count()
    again = cut(copies.where("n > 1").select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), (1 - F.col("n")).alias("more")), "again")
    known = spans.select(F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    if not again.isEmpty():
        one = spans.join(again, spans.doc_id.eqNullSafe(again.a_id) & (spans.th == again.a_th)).select("doc_id", "th", "more", "text").dropDuplicates(["doc_id", "th"])
        known = known.union(one.select("more", F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").agg(F.sum("more").alias("n")).select("term", "n"))
        known = known.groupBy("term").agg(F.sum("n").alias("n"))
    return cut(known.select("term", F.col("n").alias("n_term")), "vocabulary"), total


def disclosing_terms(spans: DataFrame) -> DataFrame:
    """(term, kind, entity, share, bits): terms over the thresholds. spans: base_spans of all documents."""
    some = spans.where(" OR ".join(f"size({k}) > 0" for k in PATTERNS))
    each = some.select("doc_id", "th", F.explode(F.expr("concat(" + ", ".join(f"transform({k}, m -> struct('{k}' AS kind, lower(m.v) AS entity, m.near AS near))" for k in PATTERNS) + ")")).alias("x"))
    met = cut(each.select("doc_id", "th", "x.kind", "x.entity", F.xxhash64("x.near").alias("context"), F.explode(F.expr(_terms("x.near"))).alias("term")), "met")
    if met.isEmpty():
        return met.select("term", "kind", "entity", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    known, total = _term_counts(spans)
    entities = each.select("doc_id", "th", "x.kind", "x.entity").distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    # Distinct documents and contexts are counted in two steps, so a frequent pair is spread by document and by context first.
    in_docs = met.select("term", "kind", "entity", "doc_id", "th").distinct().groupBy("term", "kind", "entity").agg(F.count("*").alias("n_both"))
    in_contexts = met.select("term", "kind", "entity", "context").distinct().groupBy("term", "kind", "entity").agg(F.count("*").alias("n_contexts"))
    pairs = in_contexts.where(F.col("n_contexts") >= LEAST_CONTEXTS).join(in_docs, ["term", "kind", "entity"])
    pairs = pairs.join(entities.where(F.col("n_entity") * 2.0**LEAST_BITS <= total), ["kind", "entity"])
    near = met.select("term", "doc_id", "th").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = cut(pairs.join(near, "term").where(F.col("n_both") >= LEAST_SHARE * F.col("n_near")), "pairs")
    scored = pairs.join(known, "term")
    share, bits = F.col("n_both") / F.col("n_term"), F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity").cast("double")))
    return scored.select("term", "kind", "entity", share.alias("share"), bits.alias("bits")).where((F.col("share") >= LEAST_SHARE) & (F.col("bits") >= LEAST_BITS))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, email, ip, card, phone, term) for every row of docs: arrays of struct(s, e, v), sorted by place.

    Null and empty texts have no spans; rows that agree in doc_id and text are alike and count as one document. Spans of
    one kind don't overlap; spans of different kinds may. Terms that lie inside a base span are left out. Empty tables
    give no rows; other columns aren't carried.
    """
    spans = cut(base_spans(docs), "spans")
    terms = cut(disclosing_terms(spans).select("term").distinct(), "terms")
    base = [F.expr(f"transform({k}, m -> struct(m.s AS s, m.e AS e, m.v AS v))").alias(k) for k in PATTERNS]
    if terms.isEmpty():
        return spans.select("doc_id", "text", *base, F.expr(f"cast(array() AS {_SPANS})").alias("term"))
    where = spans.select("doc_id", "th", F.explode(F.expr(_terms("text"))).alias("term")).join(terms, "term").groupBy("doc_id", "th").agg(F.collect_set("term").alias("terms"))
    where = cut(where.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "terms"), "termed")
    both = spans.join(where, spans.doc_id.eqNullSafe(where.w_id) & (spans.th == where.w_th), "left")
    marked = both.withColumn("parts", F.expr(f"CASE WHEN terms IS NULL THEN array() ELSE split(regexp_replace(translate(text, '\u0001\u0002', '\u0003\u0003'), '{_TERM}', '\u0001$0\u0002'), '\u0001') END"))
    inside = " OR ".join(f"exists({k}, b -> b.s <= m.s AND m.e <= b.e)" for k in PATTERNS)
    found = f"filter({_placed(f'array_contains(terms, lower({_MARKED}))', _SPANS)}, m -> NOT ({inside}))"
    return marked.select("doc_id", "text", *base, F.expr(found).alias("term"))


def joined_spans(kinds: tuple[str, ...]) -> Column:
    """The spans as text: kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    each = ", ".join(f"transform({k}, m -> struct(m.s AS s, {KINDS.index(k)} AS o, concat('{k}:', m.s, ':', m.e) AS x))" for k in kinds)
    return F.expr(f"array_join(transform(array_sort(concat({each})), y -> y.x), ',')")


def sanitise(found: DataFrame, remove_terms: bool = False) -> DataFrame:
    """found (of find()) with the column clean: spans replaced by their kind in angle brackets, of overlapping ones the first.

    remove_terms: disclosing terms are deleted instead.
    """
    each = ", ".join(f"transform({k}, m -> struct(m.s AS s, {KINDS.index(k)} AS o, m.e AS e, {repr('') if k == 'term' and remove_terms else repr(f'<{k.upper()}>')} AS r))" for k in KINDS)
    clean = f"""aggregate(array_sort(concat({each})), struct(0 AS at, cast('' AS string) AS out),
      (a, m) -> if(m.s < a.at, a, struct(m.e AS at, concat(a.out, substring(text, a.at + 1, m.s - a.at), m.r) AS out)),
      a -> concat(a.out, substring(text, a.at + 1)))"""
    return found.withColumn("clean", F.when(F.col("text").isNotNull(), F.expr(clean)))
