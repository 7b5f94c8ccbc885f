"""User stories and analysis reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import html_escape
from .bounded import first_rows


def stories(units: DataFrame, found: DataFrame, criteria: DataFrame) -> DataFrame:
    """units (unit_id, name, summary) with their stories and each story's criteria, nested; units with neither are left out.

    Criteria belong to a story of the same unit. Ids that are missing count: US-i in a unit, AC-i-j in a story.
    """
    acs = criteria.groupBy("unit_id", "story_id").agg(F.array_sort(F.collect_set(F.struct("criterion_id", "title", "given", "when", "then"))).alias("criteria"))
    each = found.join(acs, ["unit_id", "story_id"], "left").withColumn("criteria", F.coalesce("criteria", F.expr("cast(array() AS array<struct<criterion_id:string,title:string,given:array<string>,when:array<string>,then:array<string>>>)")))
    per = each.groupBy("unit_id").agg(F.array_sort(F.collect_set(F.struct("story_id", "role", "goal", "benefit", "criteria"))).alias("stories"))
    out = units.join(per, "unit_id", "left")
    return out.where((F.length(F.coalesce("summary", F.lit(""))) > 0) | (F.coalesce(F.size("stories"), F.lit(0)) > 0))


def numbered_stories(raw: DataFrame) -> DataFrame:
    """(unit_id, story_id, role, goal, benefit, criteria) of raw (unit_id, stories); missing ids are numbered by place."""
    each = raw.select("unit_id", F.posexplode("stories").alias("i", "s"))
    return each.select("unit_id", F.coalesce("s.id", F.concat(F.lit("US-"), (F.col("i") + 1).cast("string"))).alias("story_id"), "s.role", "s.goal", "s.benefit", F.expr("transform(s.criteria, (c, j) -> struct(coalesce(c.id, concat('AC-', i + 1, '-', j + 1)) AS criterion_id, c.title AS title))").alias("criteria"))


def story_totals(nested: DataFrame) -> DataFrame:
    return nested.agg(F.sum(F.coalesce(F.size("stories"), F.lit(0))).alias("stories"), F.sum(F.expr("aggregate(coalesce(stories, array()), 0, (a, s) -> a + size(s.criteria))")).alias("criteria"))


def markdown(nested: DataFrame) -> DataFrame:
    """(unit_id, text): the requirements of each unit as Markdown."""
    lines = F.expr("""flatten(transform(coalesce(stories, array()), s -> concat(
        array(concat('### ', s.story_id), concat('- As ', s.role, ', I want ', s.goal, ', so that ', s.benefit)),
        flatten(transform(s.criteria, c -> concat(array(concat('#### ', c.criterion_id, ' ', c.title)),
          transform(coalesce(c.given, array()), x -> concat('- Given ', x)), transform(coalesce(c.when, array()), x -> concat('- When ', x)), transform(coalesce(c.then, array()), x -> concat('- Then ', x))))))))""")
    return nested.select("unit_id", F.concat_ws("\n", F.concat(F.lit("## "), "name"), F.nullif("summary", F.lit("")), F.array_join(lines, "\n")).alias("text"))


def totals(uses: DataFrame) -> DataFrame:
    """One row: units, tables, statements and tokens. uses: unit, table_name, statement, tokens."""
    per = uses.groupBy("statement").agg(F.max("tokens").alias("tokens"))
    return uses.agg(F.countDistinct("unit").alias("units"), F.countDistinct("table_name").alias("tables")).join(per.agg(F.count("*").alias("statements"), F.sum("tokens").alias("tokens")), F.lit(True))


def table_usage(uses: DataFrame, contexts: int = 5) -> DataFrame:
    """(unit, table_name, operations, occurrences, contexts): how each unit uses each table, with the first contexts.

    Each task keeps the first contexts of what it reads, so a unit's use of a table may be of any size.
    """
    key = ["unit", "table_name"]
    counted = uses.groupBy(*key, "operation").agg(F.count("*").alias("n")).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("operation")), ",").alias("operations"), F.sum("n").alias("occurrences"))
    first = first_rows(uses.where("line IS NOT NULL OR context IS NOT NULL"), key, ["line", "context"], contexts)
    first = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "context"))), lambda x: x["context"]), ",").alias("contexts"))
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key))
    return counted.alias("c").join(first.alias("f"), same, "left").select(*(f"c.{k}" for k in key), "operations", "occurrences", F.coalesce("contexts", F.lit("")).alias("contexts"))


def preview(names: str, n: int) -> object:
    """The first n of an array as text, and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, F.concat(F.lit(" … "), (F.size(names) - n).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def html(usage: DataFrame) -> DataFrame:
    """One row with an HTML table of the usage of each unit; rows are rendered where they are and joined in order."""
    cells = F.concat(*(F.concat(F.lit("<td>"), html_escape(F.col(c).cast("string")), F.lit("</td>")) for c in ("unit", "table_name", "operations", "occurrences")))
    rows = usage.select("unit", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row"), "table_name")
    per = rows.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    return per.select("unit", F.concat(F.lit("<h2>"), html_escape(F.col("unit").cast("string")), F.lit("</h2>\n<table>\n"), "rows", F.lit("\n</table>")).alias("html"))


def report(usage: DataFrame, counted: DataFrame, statements: DataFrame, shown: int = 20) -> DataFrame:
    """(section, unit, html) of a whole report, in order: the totals, how each unit uses its tables, and its first statements.

    usage: of table_usage(); counted: the one row of totals(); statements: unit, line, kind, text. A section is rendered where
    its rows are, so the report has as many rows as units, not one row with all.
    """
    line = lambda c: F.concat(F.lit("<li>"), html_escape(c), F.lit("</li>"))
    head = counted.select(F.lit(0).alias("section"), F.lit(None).cast("string").alias("unit"), F.concat(F.lit("<h1>Analysis</h1>\n<ul>"), *(F.concat(F.lit(f"<li>{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("</li>")) for c in counted.columns), F.lit("</ul>")).alias("html"))
    tables = html(usage).select(F.lit(1).alias("section"), F.col("unit").cast("string").alias("unit"), "html")
    first = statements.withColumn("_at", F.row_number().over(W.partitionBy("unit").orderBy("line", "text"))).where(F.col("_at") <= shown)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", line(F.concat_ws(" ", F.col("line").cast("string"), "kind", "text")).alias("li")))), lambda x: x["li"]), "\n")
    listed = first.groupBy("unit").agg(items.alias("items")).select(F.lit(2).alias("section"), F.col("unit").cast("string").alias("unit"), F.concat(F.lit("<h3>"), html_escape(F.col("unit").cast("string")), F.lit("</h3>\n<ol>\n"), "items", F.lit("\n</ol>")).alias("html"))
    return head.unionByName(tables).unionByName(listed).orderBy("section", "unit")
