"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, grammar, hosts, jaccard, lines, merkle, packing, pii, sharding, toxicity, vectors
from .common import cut, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_term counts the spans that the method adds to the base ones; clean_sha256 is the digest of the sanitised text."""
    found = pii.sanitise(pii.find(table(spark, sf_dir, "documents")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.joined_spans(tuple(pii.PATTERNS)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined_spans(pii.KINDS).alias("spans"), F.sha2("clean", 256).alias("clean_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality that labels has under its id: 0 is bad."""
    outcomes = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    held = F.expr("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 5 = 0")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = cut(grammar.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "shards")
    return grammar.digests(shards)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.audit(merkle.manifest(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece's ids are read back from the written pieces."""
    parts = cut(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return packing.placed(parts.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_ALL = (
    op1_sharding, op2_pii, op3_line_dedup, op4_decontamination, op5_url_filters, op6_embedding_near_dedup, op7_bpe_encoding, op8_toxicity, op9_token_files, op10_ngram_jaccard_join,
    op11_merkle_manifest, op12_best_fit_packing, op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}
#: A level's strength from its units (n, k, m), in the bounds of a prior.
_STRENGTH = f"""(1 - rho) / rho FROM (SELECT greatest({hosts.LEAST_RHO}, least({hosts.MOST_RHO}, coalesce(sum(((k - n * m) ** 2 - k * (1 - m) ** 2 - (n - k) * m ** 2) / (n - 1)) FILTER (n > 1) / nullif(sum(n * m * (1 - m)) FILTER (n > 1), 0), {hosts.LEAST_RHO}))) AS rho"""
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d WHERE len(w) >= 5)),
si AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i WHERE len(w) >= 5)),
q AS (SELECT item_id, count(*) AS q FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, q AS item_shingles
FROM ds JOIN si USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 80 * q
""",
    "op5_url_filters": rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p)),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in hosts.RULES)}) v(verdict, rule, rh, rp)),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
u AS (SELECT site, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k, array_to_string(string_split(site, '.')[-2:], '.') AS domain, string_split(site, '.')[-1] AS suffix FROM h LEFT JOIN o USING (page_id) GROUP BY site),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM u GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
t AS (SELECT sum(n) AS n, sum(k) AS k FROM s),
s1 AS (SELECT s.*, ({hosts.MOST_BAD / 2} + t.k - s.k) / (1.0 + t.n - s.n) AS m, 1.0 + t.n - s.n AS held FROM s, t),
s2 AS (SELECT *, least(held, (SELECT {_STRENGTH} FROM s1))) AS z FROM s1),
d1 AS (SELECT d.*, (s2.m * z + s2.k - d.k) / (z + s2.n - d.n) AS m, z + s2.n - d.n AS held FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT *, least(held, (SELECT {_STRENGTH} FROM d1))) AS z FROM d1),
u1 AS (SELECT u.*, (d2.m * z + d2.k - u.k) / (z + d2.n - u.n) AS m, z + d2.n - u.n AS held FROM u JOIN d2 USING (domain)),
u2 AS (SELECT site, n, k, m * z + k AS a, (1 - m) * z + n - k AS b FROM (SELECT *, least(held, (SELECT {_STRENGTH} FROM u1))) AS z FROM u1)),
u3 AS (SELECT site, n, k, 1 - exp(a * ln({hosts.MOST_BAD}) + b * ln(1 - {hosts.MOST_BAD}) + lgamma(a + b) - lgamma(a + 1) - lgamma(b)) * (1 + sum(exp(lgamma(a + 1) + lgamma(a + b + i + 1) - lgamma(a + i + 2) - lgamma(a + b) + (i + 1) * ln({hosts.MOST_BAD})))) AS bad
  FROM u2, range(4000) r(i) GROUP BY site, n, k, a, b)
SELECT page_id, host, path, (SELECT rule FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC LIMIT 1), CASE WHEN bad >= {hosts.SURE} THEN 'block' ELSE 'allow' END) AS verdict, n AS n_labelled, k AS n_bad, round(bad, 4) AS bad
FROM h JOIN u3 USING (site)
""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
SELECT u AS vec_id, (SELECT count(*) FROM l WHERE l.u = c.u) AS n_links, min(v) AS component_id, u = min(v) AS kept FROM c GROUP BY u
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 80 * (a.n + b.n - o)),
c AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
SELECT c.u AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.v) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.u GROUP BY c.u
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
f AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, cut FROM d),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS presented FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
t AS (SELECT 0 AS lvl, g, pos, leaf AS h, n FROM l
  UNION ALL SELECT lvl + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY lvl, g, pos // 3, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, h, n FROM s UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
st AS (SELECT a.lvl, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lh, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rh FROM t a JOIN t b ON a.lvl = b.lvl AND a.g = b.g AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.g, a.pos),
su AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lh, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rh FROM u a JOIN u b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
p AS (SELECT g, pos, 0 AS lvl, pos AS q, '' AS proof, presented AS now FROM l
  UNION ALL SELECT p.g, p.pos, p.lvl + 1, p.q // 3, p.proof || st.lh || st.rh, sha256(st.lh || p.now || st.rh) FROM p JOIN st ON p.g = st.g AND p.lvl = st.lvl AND p.q = st.pos),
pe AS (SELECT p.g, p.pos, p.proof, p.now, s.pos AS spos, s.h AS subroot FROM p JOIN s USING (g) WHERE p.lvl = (SELECT max(lvl) FROM t WHERE t.g = p.g)),
v AS (SELECT g, pos, 0 AS lvl, spos AS q, proof, now, subroot FROM pe
  UNION ALL SELECT v.g, v.pos, v.lvl + 1, v.q // 3, v.proof || su.lh || su.rh, sha256(su.lh || v.now || su.rh), v.subroot FROM v JOIN su ON v.lvl = su.lvl AND v.q = su.pos)
SELECT l.doc_id, l.leaf, v.subroot, r.h AS root, sha256(v.proof) AS proof_sha256, v.now AS folded_root, v.now = r.h AS verified
FROM v JOIN l USING (g, pos), (SELECT h FROM u WHERE n = 1) r WHERE v.lvl = (SELECT max(lvl) FROM u)
""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.total + 2 * v.v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n)::HUGEINT + 2)) // (any_value(t.total) + 2 * any_value(v.v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY lang) t USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr)) WHERE part = 'pair' OR rank <= {divergence.TOP}
""",
}
