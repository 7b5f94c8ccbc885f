"""File types from contents: weighted patterns, dialect and kind votes, all as one projection in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import patterns as P
from .needed import NEEDED

SQL_TYPES = ("oracle_sp", "oracle_ddl", "postgresql_sp", "postgresql_ddl")


def describe(pattern: str) -> str:
    """A pattern in words: what it always holds, in order."""
    held = [w for op in NEEDED[pattern] if len(op) == 1 for w in op if any(c.isalnum() for c in w)]
    return " ".join(held).strip() or "/".join(x for op in NEEDED[pattern] for x in op)


#: Every pattern that a file is held against, with its flags: types' patterns, then the signs of dialect and kind.
_FLAGS = {t: "md" if t == "xml" else "imd" for t in P.TYPES}
_ALL = list(dict.fromkeys([(p, _FLAGS[t]) for t, ps in P.TYPES.items() for p, _ in ps] + [(p, "id") for p in (*P.ORACLE_SIGNS, *P.POSTGRESQL_SIGNS, P.BLOCK)] + [(p, "imd") for p in (*P.SP_SIGNS, *P.DDL_SIGNS)]))
_WORDS = sorted({w for p, _ in _ALL for op in NEEDED[p] for w in op})


def _hits(patterns: tuple[str, ...], flags: str) -> Column:
    """Whether each of the patterns matched, as an array."""
    return F.transform(F.array(*(F.lit(_ALL.index((p, flags))) for p in patterns)), lambda i: F.get("hits", i))


def _tested(pattern: str, flags: str) -> Column:
    """Whether content matches; the pattern is only tried where the words are that it needs."""
    found = F.col("content").rlike(f"(?{flags}){pattern}")
    for op in NEEDED[pattern]:
        found = reduce(lambda a, b: a | b, (F.get("words", F.lit(_WORDS.index(w))) for w in op)) & found
    return found


def _number(hits: Column) -> Column:
    return F.size(F.filter(hits, lambda x: x))


def _up(c: Column, by: Column | float) -> Column:
    return F.least(F.lit(1.0), c + by)


def _down(c: Column, by: Column | float) -> Column:
    return F.greatest(F.lit(0.0), c - by)


def detect(files: DataFrame) -> DataFrame:
    """(file, file_type, confidence, details, suggested_strategy, suggested_target) for every row of files (file, content).

    details lists the first five patterns of the type that matched, in words. Blank or null contents are unknown with confidence 0.
    """
    ext = F.when(F.instr("file", ".") > 0, F.lower(F.substring_index("file", ".", -1))).otherwise(F.lit(""))
    df = files.select("file", F.coalesce("content", F.lit("")).alias("content")).withColumn("ext", ext)
    # Each text is lower-cased, searched for words and held against each pattern once: arrays that later columns index.
    low = F.lower("content")
    # transform() keeps the patterns out of generated code, which they would make too long to compile; low and words are
    # used more than once, so the optimizer doesn't fold them into what uses them.
    df = df.withColumn("low", low).withColumn("words", F.array(*(F.contains("low", F.lit(w)) for w in _WORDS)))
    df = df.select("file", "ext", (F.btrim("content", F.lit(" \t\r\n\x0b\x0c")) == "").alias("empty"), F.transform(F.array(*(_tested(*x) for x in _ALL)), lambda x: x).alias("hits"))
    for t, ps in P.TYPES.items():
        hits = _hits(tuple(p for p, _ in ps), _FLAGS[t])
        weight = F.aggregate(F.zip_with(hits, F.array(*(F.lit(float(w)) for _, w in ps)), lambda h, w: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        df = df.withColumns({"w": weight, "n": _number(hits)})
        df = df.withColumn(t, F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.col("w") / F.col("n")) * F.least(F.lit(1.0), F.col("n") / 3))))
    for t, e in (("java", "java"), ("python", "py"), ("xml", "xml")):
        df = df.withColumn(t, F.when(F.col("ext") == e, _up(F.col(t), 0.3)).otherwise(F.col(t)))
    df = df.withColumns({t: F.when(F.col("ext").isin(*P.SQL_BONUS), _up(F.col(t), 0.1)).otherwise(F.col(t)) for t in SQL_TYPES})

    df = df.withColumns({"n_oracle": _number(_hits(P.ORACLE_SIGNS, "id")), "n_pg": _number(_hits(P.POSTGRESQL_SIGNS, "id")), "n_sp": _number(_hits(P.SP_SIGNS, "imd")), "n_ddl": _number(_hits(P.DDL_SIGNS, "imd")), "block": F.get("hits", F.lit(_ALL.index((P.BLOCK, "id"))))})
    dialect = F.least(F.lit(1.0), F.greatest("n_oracle", "n_pg") / 5) * 0.2
    up = lambda t: F.col("n_oracle") > F.col("n_pg") if t.startswith("oracle") else F.col("n_pg") > F.col("n_oracle")
    df = df.withColumn("by", dialect).withColumns({t: F.when(F.col("n_oracle") == F.col("n_pg"), F.col(t)).when(up(t), _up(F.col(t), F.col("by"))).otherwise(_down(F.col(t), F.col("by"))) for t in SQL_TYPES})

    kind = F.when((F.col("n_ddl") > 0) & ~F.col("block"), "ddl").when(F.col("n_sp") > F.col("n_ddl"), "sp").when(F.col("n_ddl") > F.col("n_sp"), "ddl").otherwise("unknown")
    kind = F.when(F.greatest(*SQL_TYPES) > 0.2, kind).otherwise("unknown")
    df = df.withColumn("kind", kind).withColumn("by", F.least(F.lit(1.0), F.when(F.col("kind") == "ddl", F.col("n_ddl") / 3).otherwise(F.col("n_sp") / 4)) * 0.3)
    df = df.withColumns({t: F.when(F.col("kind") == "unknown", F.col(t)).when(F.lit(t).endswith("_" + "ddl") == (F.col("kind") == "ddl"), _up(F.col(t), F.col("by"))).otherwise(_down(F.col(t), F.col("by"))) for t in SQL_TYPES})

    best = F.greatest(*P.TYPES)
    chosen = reduce(lambda a, t: a.when(F.col(t) == F.col("best"), t), list(P.TYPES)[1:], F.when(F.col(list(P.TYPES)[0]) == F.col("best"), list(P.TYPES)[0]))
    df = df.withColumn("best", best).withColumn("chosen", chosen)
    empty = F.col("empty")
    weak = F.col("best") < 0.3
    generic = weak & F.col("ext").isin(*P.SQL_GENERIC)
    file_type = F.when(empty, "unknown").when(generic, "sql_generic").when(weak, "unknown").otherwise(F.col("chosen"))
    confidence = F.when(empty, 0.0).when(generic, 0.5).otherwise(F.col("best"))
    names = reduce(lambda a, t: a.when(F.col("chosen") == t, _matched(t)), list(P.TYPES)[1:], F.when(F.col("chosen") == "java", _matched("java")))
    details = F.when(empty, "empty file").when(generic, "SQL of unknown dialect").when(weak, F.concat(F.lit("no sure pattern, best "), "chosen")).otherwise(F.array_join(F.slice(names, 1, 5), ", "))
    suggested = lambda i: F.create_map(*(F.lit(x) for t, s in P.SUGGESTED.items() for x in (t, s[i])))[F.col("file_type")]
    return df.select("file", file_type.alias("file_type"), confidence.alias("confidence"), details.alias("details")).withColumns({"suggested_strategy": suggested(0), "suggested_target": suggested(1)})


def _matched(t: str) -> Column:
    ps = tuple(p for p, _ in P.TYPES[t])
    return F.array_compact(F.zip_with(_hits(ps, _FLAGS[t]), F.array(*(F.lit(describe(p)) for p in ps)), lambda h, x: F.when(h, x)))


def votes(detected: DataFrame) -> DataFrame:
    """(kind, choice, n, weight, is_first): counts by type, and confidence-weighted votes for strategy and target.

    Ties go to framework among strategies and else to the first name in order.
    """
    choices = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("choice")) for k, c in (("type", "file_type"), ("strategy", "suggested_strategy"), ("target", "suggested_target"))))
    each = detected.select("confidence", F.explode(choices).alias("x")).select("x.kind", "x.choice", "confidence")
    every = each.groupBy("kind", "choice").agg(F.count("*").alias("n"), F.sum(F.round("confidence", 4).cast("decimal(18,4)")).cast("double").alias("weight"))
    first = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("weight"), F.when(F.col("choice") == "framework", 0).otherwise(1), "choice")) == 1
    return every.withColumn("is_first", first)
