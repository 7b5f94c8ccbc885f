"""Business glossaries: terms with domains, owners and tags, as node and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import now_iso
from .schema import matching

#: Display defaults.
TYPE, STATUS, COLOR = "Business", "Draft", "#3498db"


def list_glossaries(glossaries: DataFrame, terms: DataFrame) -> DataFrame:
    counts = terms.groupBy("glossary_id").agg(F.count("*").alias("n"))
    return glossaries.join(counts, "glossary_id", "left").select("glossary_id", "name", F.coalesce("type", F.lit(TYPE)).alias("type"), F.coalesce("n", F.lit(0)).alias("term_count")).orderBy("name")


def _linked(terms: DataFrame, links: DataFrame, kind: str, name: str) -> DataFrame:
    """terms with the sorted different names of what they are linked to; gathered first, so that links don't multiply."""
    at = links.where(F.col("type") == kind).groupBy("term_id").agg(F.sort_array(F.collect_set("target")).alias(name))
    return terms.join(at, "term_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def list_terms(terms: DataFrame, links: DataFrame, glossary: object = None, search: str | None = None, status: str | None = None, limit: int | None = 100) -> DataFrame:
    """terms with domains, owners and tags (arrays of names), a page of so many by name, or all. links: term_id, type, target."""
    at = terms.where(matching(search, "name", "description"))
    if glossary is not None:
        at = at.where(F.col("glossary_id") == glossary)
    if status:
        at = at.where(F.coalesce("status", F.lit(STATUS)) == status)
    for kind, name in (("BELONGS_TO_DOMAIN", "domains"), ("OWNED_BY", "owners"), ("HAS_TAG", "tags")):
        at = _linked(at, links, kind, name)
    at = at.withColumn("status", F.coalesce("status", F.lit(STATUS)))
    return at if limit is None else at.orderBy("name", "term_id").limit(limit)


def put(df: DataFrame, row: dict, key: str) -> DataFrame:
    """df with a row created, or updated if its key is there; null values of the row leave old ones."""
    from .graph import upsert

    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name in row]
    new = spark.createDataFrame([tuple(row[f.name] for f in fields)], schema=type(df.schema)(fields))
    if "updated_at" in df.columns and "updated_at" not in row:
        new = new.withColumn("updated_at", now_iso())
    out = upsert(df, new, [key])
    return out.select(*df.columns)


def put_links(links: DataFrame, term: object, kind: str, targets: list[str]) -> DataFrame:
    """links with those of one term and type replaced."""
    rest = links.where(~((F.col("term_id") == term) & (F.col("type") == kind)))
    return rest.unionByName(links.sparkSession.createDataFrame([(term, kind, t) for t in targets], links.schema))


def delete_glossary(glossaries: DataFrame, terms: DataFrame, links: DataFrame, glossary: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = terms.where(F.col("glossary_id") == glossary).select("term_id")
    return glossaries.where(F.col("glossary_id") != glossary), terms.join(gone, "term_id", "left_anti"), links.join(gone, "term_id", "left_anti")


def delete_term(terms: DataFrame, links: DataFrame, term: object) -> tuple[DataFrame, DataFrame, int]:
    return terms.where(F.col("term_id") != term), links.where(F.col("term_id") != term), terms.where(F.col("term_id") == term).count()


def named(df: DataFrame) -> DataFrame:
    """Domains, owners or tags by name; tags without a colour get the usual one."""
    return (df.withColumn("color", F.coalesce("color", F.lit(COLOR))) if "color" in df.columns else df).orderBy("name")
