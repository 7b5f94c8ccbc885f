"""Names, identifiers and texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def blank(c: Column) -> Column:
    """Null, white space or 'N/A'."""
    return F.coalesce(F.trim(c), F.lit("")).isin("", "N/A")


def name_case(c: Column, case: str = "original") -> Column:
    return {"uppercase": F.upper, "lowercase": F.lower}.get(case, lambda x: x)(c)


def unquoted(c: Column) -> Column:
    """A name without the quotes, backticks or brackets around it."""
    t = F.trim(c)
    return F.when(t.rlike(r"""(?s)^(".*"|'.*'|`.*`|\[.*\])$""") & (F.length(t) >= 2), t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def table_identifier(c: Column) -> Column:
    """struct(schema, table, db_link) of SCHEMA.TABLE@LINK; the first dot splits, quotes go, the case stays."""
    text = F.trim(F.coalesce(c, F.lit("")))
    left = F.substring_index(text, "@", 1)
    link = F.trim(F.when(F.instr(text, "@") > 0, text.substr(F.length(left) + 2, F.length(text))).otherwise(F.lit("")))
    head = F.substring_index(left, ".", 1)
    tail = F.when(F.instr(left, ".") > 0, left.substr(F.length(head) + 2, F.length(left))).otherwise(F.lit(""))
    schema = F.when(tail != "", unquoted(head)).otherwise(F.lit(""))
    return F.struct(schema.alias("schema"), unquoted(F.when(tail != "", tail).otherwise(left)).alias("table"), F.nullif(unquoted(link), F.lit("")).alias("db_link"))


def fqn(*parts: Column) -> Column:
    """The non-empty parts joined by dots, lower-cased."""
    return F.lower(F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts]))


def normal_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def full_directory(directory: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.nullif(F.regexp_replace(normal_path(directory), "/+$", ""), F.lit("")), file_name)


def default_schema(directory: Column, schemas: Column, case: str = "original") -> Column:
    """The deepest folder that is a known schema (case ignored, as the schema is written), else the last folder, else public."""
    folders = F.filter(F.split(normal_path(F.coalesce(directory, F.lit(""))), "/"), lambda p: p != "")
    known = F.filter(F.transform(F.reverse(folders), lambda p: F.get(F.filter(schemas, lambda s: F.lower(s) == F.lower(p)), F.lit(0))), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), name_case(F.when(F.size(folders) > 0, F.element_at(folders, -1)).otherwise(F.lit("public")), case))


_PART = r'(?:"[^"]+"|[A-Za-z_][\w$#]*)'


def procedure_name(code: Column) -> Column:
    """struct(schema, name) from the head of a procedure: up to three dotted parts, the last two being the name."""
    head = F.regexp_replace(code, r"^\d+\s*:\s*", "")
    full = F.regexp_extract(head, rf"(?i)\b(?:CREATE\s+(?:OR\s+REPLACE\s+)?)?(?:PROCEDURE|FUNCTION|TRIGGER)\s+({_PART}(?:\s*\.\s*{_PART}){{0,2}})", 1)
    parts = F.transform(F.split(full, r"\s*\.\s*"), lambda p: F.btrim(F.trim(p), F.lit('"')))
    n = F.size(parts)
    schema = F.when(n > 1, F.get(parts, F.lit(0)))
    name = F.when(n == 3, F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).when(n == 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.when(full != "", F.struct(schema.alias("schema"), name.alias("name"))).otherwise(F.lit(None).cast("struct<schema:string,name:string>"))


def class_name(kind: Column, code: Column) -> Column:
    """The name behind class, interface or enum in a declaration; null if there's none."""
    found = F.when(kind == "INTERFACE", F.regexp_extract(code, r"\binterface\s+(\w+)", 1)).when(kind == "ENUM", F.regexp_extract(code, r"\benum\s+(\w+)", 1)).otherwise(F.regexp_extract(code, r"\bclass\s+(\w+)", 1))
    return F.nullif(found, F.lit(""))


def is_domain_class(name: Column) -> Column:
    """Whether calls to a class of this name are worth an edge: no builtin, utility or variable-like name."""
    lower = name == F.lower(name)
    variable = (F.length(name) == 1) | (name.rlike("^[a-z]") & (F.length(name) <= 3)) | (lower & name.rlike("[A-Za-z]") & (F.length(name) <= 6))
    return F.coalesce((name != "") & ~name.isin(*fixed.BUILTIN_TYPES, *fixed.UTILITY_CLASSES) & ~variable, F.lit(False))


def statement_name(kind: Column, line: Column) -> Column:
    return F.concat(kind, F.lit("["), line.cast("string"), F.lit("]"))


def node_name(kind: Column, unit_name: Column, file_name: Column, line: Column) -> Column:
    return F.when(kind == "FILE", file_name).when(kind.isin(*fixed.PROCEDURE_TYPES, *fixed.CLASS_TYPES) & unit_name.isNotNull(), unit_name).otherwise(statement_name(kind, line))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def token_estimate(c: Column) -> Column:
    """Tokens of a code text: words, numbers and single marks. A stand-in for a subword tokenizer, at least 1 for a text."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\sA-Za-z0-9]"))))


def token_counter(vocabulary: str) -> Callable[[Column], Column]:
    """A function from a column of texts to their tokens by a tokenizer file; null and empty texts have none.

    Texts go to the library in Arrow batches; each Python worker loads the file once.
    """

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for part in texts:
            yield pd.Series([len(x.ids) for x in tokenizer.encode_batch(part.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

    return count


def parse_maybe(c: Column) -> Column:
    """A text as JSON (a variant) if it is JSON, else as a text."""
    return F.when(c.isNotNull(), F.coalesce(F.try_parse_json(c), F.variant_get(F.to_variant_object(F.array(c)), "$[0]", "variant")))


def access_modes(mode: Column) -> Column:
    """The edge types of an access mode: r reads (FROM), w writes (WRITES), both have both."""
    m = F.lower(F.coalesce(mode, F.lit("")))
    return F.filter(F.array(F.when(m.contains("r"), "FROM"), F.when(m.contains("w"), "WRITES")), lambda x: x.isNotNull())


def variable_role(kind: Column) -> Column:
    return F.when(kind == "PACKAGE_VARIABLE", "package variable").when(kind == "DECLARE", "declaration").when(kind == "SPEC", "parameter").otherwise("variable")


def description_text(description: Column, analysed: Column, mark: str = " | AI 분석: ") -> Column:
    """The written description and the analysed one behind a mark, trimmed."""
    return F.trim(F.concat(F.coalesce(description, F.lit("")), F.when(F.coalesce(analysed, F.lit("")) != "", F.concat(F.lit(mark), analysed)).otherwise(F.lit(""))))


def embedding_text(*parts: Column) -> Column:
    """The non-empty parts joined by ' | '; 'empty' if there are none."""
    text = F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.when(text == "", "empty").otherwise(text)


def now_iso() -> Column:
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
