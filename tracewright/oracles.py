"""SQL for DuckDB that must give the same rows as the queries of the same names."""

from __future__ import annotations

from functools import reduce

from . import fixtures as X
from .functions import fixed
from .plans import detect
from .plans import patterns as P

V = X.values
#: Foreign keys of the tables made from suppliers and nations.
_MANY = "(SELECT 'S' || s_suppkey AS from_table, 'nation_id' AS from_column, 'N' || s_nationkey AS to_table, 'id' AS to_column, CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'ddl' END AS source FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'region_id', 'R' || n_regionkey, 'id', 'ddl' FROM nation)"
_KEYS = V(X.KEYS, "from_table", "from_column", "to_table", "to_column", "source")
_DDL, _SQL = V(X.DDL, "file", "content"), V(X.SQL, "file", "content")

#: Column types as Spark names them, by those of the files.
_TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"
_STAR = "('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')"
_ALL = "('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')"
_COLUMNS = f"SELECT DISTINCT table_name AS t, column_name AS c, {_TYPE} AS k, ordinal_position - 1 AS o FROM information_schema.columns WHERE table_name IN {{}}"


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{w}%'" for w in words) + ")"


_FIT = "(a.k = b.k OR " + " OR ".join(f"({_like('a.k', w)} AND {_like('b.k', w)})" for w in (fixed.NUMERIC_TYPES, fixed.STRING_TYPES, fixed.DATE_TYPES)) + ")"
_LEV = "1 - levenshtein(a.c, b.c) / greatest(length(a.c), length(b.c))"


def _lev(tables: str, where: str, threshold: float) -> str:
    return f"SELECT a.t AS from_table_name, a.c AS from_column_name, b.t AS to_table_name, b.c AS to_column_name, {_LEV} AS s FROM k a JOIN k b ON {where} AND {_FIT} WHERE {_LEV} >= {threshold}"


_KEY_COLUMNS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("documents", "doc_id"), ("labels", "doc_id")]
_MELT = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in _KEY_COLUMNS)

_VERIFIED = f"""WITH k AS (SELECT * FROM ({_COLUMNS.format("('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'documents', 'labels')")}) WHERE c LIKE '%key' OR c = 'doc_id'),
p AS ({_lev('', 'a.t <> b.t', 0.7)}), m AS ({_MELT}), r AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY v) AS pos FROM m),
x AS (SELECT p.*, r.v, EXISTS (SELECT 1 FROM m WHERE m.t = p.to_table_name AND m.c = p.to_column_name AND m.v = r.v) AS hit FROM p JOIN r ON r.t = p.from_table_name AND r.c = p.from_column_name WHERE r.pos <= 25)"""

_TREES = "t AS (SELECT l_orderkey || '.sql' AS file, CAST(count(*) AS INT) AS m FROM lineitem GROUP BY l_orderkey), c AS (SELECT file, m, CAST(unnest(range(1, m + 1)) AS INT) AS i FROM t)"

_EDGES = "e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"
_CHAIN = "n AS (SELECT *, conv_id || ':' || turn AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)"


def _score(name: str) -> str:
    ps = P.TYPES[name]
    flags = "m" if name == "xml" else "im"
    hits = [f"regexp_matches(content, {X.literal('(?' + flags + ')' + p)})" for p, _ in ps]
    n = " + ".join(f"CAST({h} AS INT)" for h in hits)
    w = " + ".join(f"CASE WHEN {h} THEN CAST({w} AS DOUBLE) ELSE 0 END" for h, (_, w) in zip(hits, ps, strict=True))
    return f"(SELECT CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, (w / n) * least(1.0, n / 3)) END FROM (SELECT {n} AS n, {w} AS w))"


def _words(name: str) -> str:
    ps = P.TYPES[name]
    flags = "m" if name == "xml" else "im"
    each = ", ".join(f"CASE WHEN regexp_matches(content, {X.literal('(?' + flags + ')' + p)}) THEN {X.literal(detect.describe(p))} END" for p, _ in ps)
    return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL)[1:5], ', ')"


def _signs(signs: tuple[str, ...], flags: str) -> str:
    return " + ".join(f"CAST(regexp_matches(content, {X.literal('(?' + flags + ')' + p)}) AS INT)" for p in signs)


def _ends(x: str, tables: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(X.literal, tables)) + ")"


_SQLS = ("oracle_sp", "oracle_ddl", "postgresql_sp", "postgresql_ddl")
_FILES = f"files AS (SELECT 'doc' || doc_id || '.txt' AS file, coalesce(text, '') AS content FROM documents UNION ALL SELECT 'page' || page_id || '.xml', coalesce(html, '') FROM pages UNION ALL SELECT file, content FROM {V(X.FILES, 'file', 'content')})"
_MORE = lambda t, up: f"CASE WHEN {up} THEN least(1.0, {t} + b) ELSE greatest(0.0, {t} - b) END"
_DETECT = f"""WITH {_FILES},
s0 AS (SELECT file, content, CASE WHEN contains(file, '.') THEN lower(regexp_extract(file, '[^.]*$')) ELSE '' END AS ext, {', '.join(f'{_score(t)} AS {t}' for t in P.TYPES)}, {', '.join(f'{_words(t)} AS words_{t}' for t in P.TYPES)},
  {_signs(P.ORACLE_SIGNS, 'i')} AS n_oracle, {_signs(P.POSTGRESQL_SIGNS, 'i')} AS n_pg, {_signs(P.SP_SIGNS, 'im')} AS n_sp, {_signs(P.DDL_SIGNS, 'im')} AS n_ddl, regexp_matches(content, {X.literal('(?i)' + P.BLOCK)}) AS block FROM files),
s1 AS (SELECT * REPLACE (CASE WHEN ext = 'java' THEN least(1.0, java + 0.3) ELSE java END AS java, CASE WHEN ext = 'py' THEN least(1.0, python + 0.3) ELSE python END AS python, CASE WHEN ext = 'xml' THEN least(1.0, xml + 0.3) ELSE xml END AS xml,
  {', '.join(f"CASE WHEN ext IN {_ends('ext', P.SQL_BONUS)} THEN least(1.0, {t} + 0.1) ELSE {t} END AS {t}" for t in _SQLS)}), least(1.0, greatest(n_oracle, n_pg) / 5) * 0.2 AS b FROM s0),
s2 AS (SELECT * REPLACE ({', '.join(f"CASE WHEN n_oracle = n_pg THEN {t} ELSE {_MORE(t, 'n_oracle > n_pg' if t.startswith('oracle') else 'n_pg > n_oracle')} END AS {t}" for t in _SQLS)}) FROM s1),
s3 AS (SELECT * EXCLUDE (b), CASE WHEN greatest({', '.join(_SQLS)}) <= 0.2 THEN 'unknown' WHEN n_ddl > 0 AND NOT block THEN 'ddl' WHEN n_sp > n_ddl THEN 'sp' WHEN n_ddl > n_sp THEN 'ddl' ELSE 'unknown' END AS kind FROM s2),
s4 AS (SELECT *, least(1.0, CASE WHEN kind = 'ddl' THEN n_ddl / 3 ELSE n_sp / 4 END) * 0.3 AS b FROM s3),
s5 AS (SELECT * REPLACE ({', '.join(f"CASE WHEN kind = 'unknown' THEN {t} ELSE {_MORE(t, 'kind = ' + X.literal(t.split('_')[1]))} END AS {t}" for t in _SQLS)}) FROM s4),
s6 AS (SELECT *, greatest({', '.join(P.TYPES)}) AS best, CASE {' '.join(f"WHEN {t} = greatest({', '.join(P.TYPES)}) THEN '{t}'" for t in P.TYPES)} END AS chosen, trim(content, E' \\t\\r\\n\\x0b\\x0c') = '' AS empty FROM s5),
d AS (SELECT file, CASE WHEN empty THEN 'unknown' WHEN best < 0.3 AND ext IN {_ends('ext', P.SQL_GENERIC)} THEN 'sql_generic' WHEN best < 0.3 THEN 'unknown' ELSE chosen END AS file_type,
  CASE WHEN empty THEN 0.0 WHEN best < 0.3 AND ext IN {_ends('ext', P.SQL_GENERIC)} THEN 0.5 ELSE best END AS confidence,
  CASE WHEN empty THEN 'empty file' WHEN best < 0.3 AND ext IN {_ends('ext', P.SQL_GENERIC)} THEN 'SQL of unknown dialect' WHEN best < 0.3 THEN 'no sure pattern, best ' || chosen ELSE CASE chosen {' '.join(f"WHEN '{t}' THEN words_{t}" for t in P.TYPES)} END END AS details FROM s6),
m AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{a}', '{b}')" for t, (a, b) in P.SUGGESTED.items())}) AS v(file_type, suggested_strategy, suggested_target))
"""

_NAME = r"(\w+(?:\.\w+)?)"
_BODY = f"""u AS (SELECT file, regexp_extract(p, '(?i)(?:PROCEDURE|FUNCTION)\\s+(\\w+)', 1) AS etl_name, p AS body FROM (SELECT file, unnest(list_transform(list_filter(string_split(regexp_replace(content, '(?i)CREATE\\s+OR\\s+REPLACE\\s+PROCEDURE', chr(1) || 'PROCEDURE', 'g'), chr(1)), lambda x: x <> ''), lambda x: x)) AS p FROM {_SQL}) WHERE regexp_matches(p, '(?i)^PROCEDURE')
  UNION ALL SELECT file, file, content FROM {_SQL} WHERE NOT regexp_matches(content, '(?i)CREATE\\s+OR\\s+REPLACE\\s+PROCEDURE'))"""


def _found(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(body, '{pattern}', 1), lambda x: upper(x)), lambda x: lower(x) NOT IN ({', '.join(map(X.literal, fixed.SYSTEM_NAMES))}))"


_UNITS = rf"""WITH {_BODY},
f AS (SELECT file, etl_name, {_found('(?i)INSERT\\s+INTO\\s+' + _NAME)} AS i, {_found('(?i)MERGE\\s+INTO\\s+' + _NAME)} AS m, {_found('(?i)UPDATE\\s+' + _NAME + '\\s+SET')} AS u, {_found('(?i)DELETE\\s+FROM\\s+' + _NAME)} AS d,
  list_concat({_found('(?i)FROM\\s+' + _NAME)}, {_found('(?i)JOIN\\s+' + _NAME)}) AS s FROM u),
g AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(i, m), list_concat(u, d)))) AS t FROM f),
h AS (SELECT *, list_sort(list_distinct(list_filter(s, lambda x: NOT list_contains(t, x)))) AS ss FROM g),
l AS (SELECT file, etl_name, ss, t, (len(ss) > 0 AND len(t) > 0) OR len(t) > 1 AS is_etl, CASE WHEN (len(ss) > 0 AND len(t) > 0) OR len(t) > 1 THEN 'ETL' WHEN len(m) > 0 THEN 'MERGE' WHEN len(i) > 0 THEN 'INSERT' WHEN len(u) > 0 THEN 'UPDATE' WHEN len(d) > 0 THEN 'DELETE' ELSE 'ETL' END AS op FROM h WHERE len(ss) > 0 OR len(t) > 0),
x AS (SELECT etl_name AS src, unnest(ss) AS dst, 'ETL_READS' AS type, etl_name AS via_etl, op AS operation, file FROM l WHERE is_etl
  UNION ALL SELECT etl_name, unnest(t), 'ETL_WRITES', etl_name, op, file FROM l WHERE is_etl
  UNION ALL SELECT src, unnest(t), 'DATA_FLOWS_TO', etl_name, op, file FROM (SELECT unnest(ss) AS src, t, etl_name, op, file FROM l WHERE is_etl))
""".replace("\\\\", "\\")
#: What the procedures made from suppliers must give.
_UNITS = _UNITS.rstrip() + """,
p AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier),
px AS (SELECT 'p' || k AS src, e.d AS dst, e.y AS type, 'p' || k AS via_etl, 'ETL' AS operation, 'p' || k || '.sql' AS file FROM (SELECT k, unnest([{'d': 'REF.N' || n, 'y': 'ETL_READS'}, {'d': 'STG.S' || k, 'y': 'ETL_READS'}, {'d': 'DW.F' || k % 7, 'y': 'ETL_WRITES'}, {'d': 'LOG.L' || k % 3, 'y': 'ETL_WRITES'}]) AS e FROM p)
  UNION ALL SELECT s, t, 'DATA_FLOWS_TO', 'p' || k, 'ETL', 'p' || k || '.sql' FROM (SELECT k, s, unnest(['DW.F' || k % 7, 'LOG.L' || k % 3]) AS t FROM (SELECT k, unnest(['REF.N' || n, 'STG.S' || k]) AS s FROM p)))
"""

_TERMS = f"{V(X.TERMS, 'term_id', 'glossary_id', 'name', 'description', 'status')} t"
_LINKS = V(X.LINKS, "term_id", "type", "target")


def _linked(kind: str) -> str:
    return f"coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM {_LINKS} l WHERE l.term_id = t.term_id AND l.type = '{kind}'), '')"


ORACLE_SQL: dict[str, str] = {
    "fk_candidates_levenshtein": f"WITH k AS ({_COLUMNS.format(_STAR)}) SELECT * EXCLUDE (s), round(s, 4) AS similarity FROM ({_lev('', 'a.t < b.t', 0.8)})",
    "fk_verify_ratio": f"{_VERIFIED} SELECT from_table_name, from_column_name, to_table_name, to_column_name, count(*) AS total_samples, count(*) FILTER (hit) AS matched_count, round(count(*) FILTER (hit) / count(*), 4) AS match_ratio FROM x GROUP BY ALL HAVING count(*) FILTER (hit) / count(*) >= 0.8",
    "fk_existing_excluded": f"WITH k AS ({_COLUMNS.format(_STAR)}) SELECT from_table_name, from_column_name, to_table_name, to_column_name FROM ({_lev('', 'a.t <> b.t', 0.8)}) x WHERE NOT EXISTS (SELECT 1 FROM {_KEYS} y WHERE y.from_table = from_table_name AND y.from_column = from_column_name AND y.to_table = to_table_name AND y.to_column = to_column_name)",
    "types_compatible": f"WITH k AS (SELECT DISTINCT k FROM ({_COLUMNS.format(_ALL)})) SELECT a.k AS data_type, b.k AS other, {_FIT} AS compatible FROM k a JOIN k b ON a.k <= b.k",
    "table_list": f"SELECT 'public' AS schema_name, t AS table_name, CAST(NULL AS VARCHAR) AS description, count(*) AS column_count FROM ({_COLUMNS.format(_ALL)}) GROUP BY t UNION ALL SELECT 'public', 'empty', NULL, 0",
    "column_list": f"SELECT t AS table_name, c AS column_name, CAST(o AS INT) AS ordinal FROM ({_COLUMNS.format('(' + repr('orders') + ')')})",
    "table_search": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_type), 'econ') OR contains(lower(p_name), 'bolt') ORDER BY p_name, p_partkey LIMIT 100",
    "relationship_list": f"""WITH a AS (SELECT * FROM {_MANY} UNION ALL SELECT 'S1', 'other_id', 'N7', 'id', 'user' UNION ALL SELECT 'N7', 'region_id', 'R1', 'id', 'user')
SELECT from_table, from_column, to_table, to_column, max(source) AS source FROM a WHERE from_table = 'N7' OR to_table = 'N7' GROUP BY ALL""",
    "description_update": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'set by hand' ELSE n_name END AS description, CASE WHEN n_nationkey = 3 THEN 'user' ELSE 'ddl' END AS description_source FROM nation",
    "tree_closure": f"WITH RECURSIVE {_EDGES}, c AS (SELECT src, dst, 1 AS distance FROM e UNION ALL SELECT c.src, e.dst, distance + 1 FROM c JOIN e ON c.dst = e.src) SELECT * FROM c",
    "next_edges": f"WITH {_CHAIN} SELECT a.node_id AS src, b.node_id AS dst FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.pos = a.pos + 1",
    "tree_depth": f"WITH {_CHAIN} SELECT conv_id, turn, CAST(pos - 1 AS INT) AS depth FROM n",
    "subtree_ok": "SELECT conv_id, turn, bool_and(coalesce(length(text) % 7 <> 0, false)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS subtree_ok FROM conversations",
    "ancestor_budget": f"""WITH {_CHAIN}, p AS (SELECT a.node_id, b.pos, b.text, sum(length(b.text)) OVER (PARTITION BY a.node_id ORDER BY b.pos DESC) AS s FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.pos < a.pos WHERE coalesce(b.text, '') <> '')
SELECT node_id, md5('[CONTEXT]' || chr(10) || string_agg(text, chr(10) || '---' || chr(10) ORDER BY pos) || chr(10) || '[/CONTEXT]' || chr(10)) AS context_md5 FROM p WHERE s <= 300 GROUP BY node_id""",
    "gathered_facts": f"WITH RECURSIVE {_EDGES}, c AS (SELECT 'S' || s_suppkey AS node_id, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS fact FROM supplier UNION SELECT e.src, fact FROM c JOIN e ON e.dst = c.node_id) SELECT * FROM c",
    "qualified_columns": f"SELECT t AS table_name, c AS column_name FROM ({_COLUMNS.format(_ALL)}) WHERE 'public.' || t LIKE '%public.orders'",
    "column_names": f"WITH k AS ({_COLUMNS.format(_ALL)}) SELECT upper(t) AS table_name, c AS column_name FROM k UNION ALL SELECT DISTINCT upper(t), 'Other' FROM k",
    "filled_descriptions": "WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25), c AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 25) "
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::VARCHAR || ' to ' || max({c})::VARCHAR || ', ' || count(DISTINCT {c}) || ' different' AS description, 'sample' AS description_source FROM {a}" for t, a, cs in (("orders", "o", ("o_orderkey", "o_custkey", "o_orderstatus")), ("customer", "c", ("c_custkey", "c_nationkey"))) for c in cs)
    + " UNION ALL SELECT 'customer', 'c_name', 'who', 'ddl'",
    "saved_keys": f"""{_VERIFIED}, n AS (SELECT 'public.' || from_table_name AS src, 'public.' || to_table_name AS dst, from_column_name AS source_column, to_column_name AS target_column, 'sample_data_inference' AS source, round(count(*) FILTER (hit) / count(*), 4) AS match_ratio FROM x GROUP BY ALL HAVING count(*) FILTER (hit) / count(*) >= 0.8),
o AS (SELECT 'public.' || from_table AS src, 'public.' || to_table AS dst, from_column AS source_column, to_column AS target_column, source FROM {_KEYS})
SELECT src, dst, source_column, target_column, CASE WHEN o.source = 'ddl' THEN 'ddl' ELSE coalesce(n.source, o.source) END AS source, match_ratio FROM o FULL JOIN n USING (src, dst, source_column, target_column)""",
    "described_tables": """WITH u AS (SELECT CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS t, n_name, s_suppkey % 2 = 0 AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT t, concat_ws('; ', 'read by ' || string_agg(DISTINCT n_name, ', ' ORDER BY n_name) FILTER (r), 'written by ' || string_agg(DISTINCT n_name, ', ' ORDER BY n_name) FILTER (NOT r)) AS x FROM u GROUP BY t),
k AS (SELECT * FROM (VALUES ('debt', NULL), ('credit', 'known'), ('unused', '')) v(table_name, description))
SELECT table_name, CASE WHEN coalesce(description, '') = '' AND x IS NOT NULL THEN x ELSE description END AS description, CASE WHEN coalesce(description, '') = '' AND x IS NOT NULL THEN 'procedure' END AS description_source, x AS analysed_description FROM k LEFT JOIN d ON t = table_name""",
    "story_rows": """WITH f AS (SELECT DISTINCT s_nationkey AS u, s_acctbal < 0 AS w, 't' || s_suppkey % 5 AS name FROM supplier), r AS (SELECT u, string_agg(name, ', ' ORDER BY name) FILTER (NOT w) AS reads, count(*) FILTER (w) AS n FROM f GROUP BY u),
s AS (SELECT u, name, row_number() OVER (PARTITION BY u ORDER BY name) AS i FROM f WHERE w UNION ALL SELECT u, '', 1 FROM r WHERE n = 0)
SELECT CAST(u AS VARCHAR) AS unit_id, 'US-' || i AS story_id, 'user of ' || n_name AS role, CASE WHEN name = '' THEN 'see ' || reads ELSE 'have ' || name || ' written' END AS goal, CASE WHEN name = '' OR reads IS NULL THEN 'it can be relied on' ELSE 'it follows from ' || reads END AS benefit, 'AC-' || i || '-1' AS criterion_id FROM s JOIN r USING (u) JOIN nation ON n_nationkey = u""",
    "summary_chunks": r"""WITH RECURSIVE t AS (SELECT conv_id % 20 AS unit, role || ': ' || text AS part, conv_id, turn FROM conversations WHERE text IS NOT NULL),
d AS (SELECT *, greatest(1, len(regexp_extract_all(part, '[A-Za-z]{1,6}|[0-9]{1,3}|[^\sA-Za-z0-9]'))) AS k, row_number() OVER (PARTITION BY unit ORDER BY conv_id, turn) AS pos FROM t),
r AS (SELECT unit, part, pos, 1 AS batch, k AS s, k FROM d WHERE pos = 1 UNION ALL SELECT d.unit, d.part, d.pos, CASE WHEN r.s + d.k > 400 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.s + d.k > 400 THEN d.k ELSE r.s + d.k END, d.k FROM r JOIN d ON d.unit = r.unit AND d.pos = r.pos + 1)
SELECT unit, batch, CAST(count(*) AS INT) AS n, CAST(sum(k) AS BIGINT) AS tokens, md5(string_agg(part, chr(10) ORDER BY pos)) AS parts_md5 FROM r GROUP BY unit, batch""",
    "class_relations": f"""SELECT * FROM {V(X.RELATIONS, 'from_class', 'to_class', 'type', 'detail')} UNION ALL SELECT 'S' || k, e.c, e.t, e.d FROM (SELECT k, unnest([{{'c': 'B' || n, 't': 'EXTENDS', 'd': ''}}, {{'c': 'P' || k % 7, 't': 'COMPOSITION', 'd': 'part 1'}}, {{'c': 'Q' || k % 5, 't': 'DEPENDENCY', 'd': 'return'}}, {{'c': 'R' || k % 3, 't': 'DEPENDENCY', 'd': 'parameter'}}, {{'c': 'T' || k % 4, 't': 'DEPENDENCY', 'd': 'local'}}, {{'c': 'P' || k % 7, 't': 'CALLS', 'd': 'run'}}]) AS e FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier))""",
    "temporary_tables": f"""SELECT * FROM {V([('t1', 'WORK', 'TMP_A'), ('t2', '', 'b')], 'unit_id', 'schema_name', 'table_name')}
UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'W' || s_nationkey ELSE '' END, CASE s_suppkey % 3 WHEN 0 THEN 'T' ELSE 't' END || s_suppkey FROM supplier WHERE s_suppkey % 3 < 2""",
    "join_columns": "SELECT 'o' || o_orderkey AS unit_id, 'stg.s' || o_orderkey % 11 AS from_table, 'id' AS from_column, 'stg.c' || o_custkey % 5 AS to_table, 'id' AS to_column FROM orders",
    "column_access": "SELECT 'o' || o_orderkey AS unit_id, 'stg.s' || o_orderkey % 11 AS table_name, 'id' AS column_name FROM orders UNION ALL SELECT 'o' || o_orderkey, 'stg.c' || o_custkey % 5, 'id' FROM orders",
    "ancestor_contexts": """WITH m AS (SELECT l_orderkey AS o, count(*)::INT AS m FROM lineitem GROUP BY 1), b AS (SELECT o, m, unnest(range(1, m + 1))::INT AS i FROM m),
t AS (SELECT *, 'PROCEDURE P' || o || ' 1~' || (6 * m + 4) || ': frame without tables and calls' AS p, 'LOOP 2~' || (6 * m + 3) || ': reads F' || o % 4 AS l, 'IF ' || (6 * i - 3) || '~' || (6 * i + 2) || ': frame without tables and calls' AS f, chr(10) || '---' || chr(10) AS s FROM b),
c AS (SELECT o || '.sql' AS file, unnest([3 * i - 2, 3 * i - 1]) AS node_id, p || s || l || s || f AS c FROM t UNION ALL SELECT o || '.sql', 3 * i, p || s || l FROM t UNION ALL SELECT DISTINCT o || '.sql', 3 * m + 1, p FROM t)
SELECT file, node_id, '[CONTEXT]' || chr(10) || c || chr(10) || '[/CONTEXT]' || chr(10) AS context FROM c""",
    "report_sections": """WITH o AS (SELECT o_custkey % 10 AS u, o_orderkey AS l, o_orderstatus AS k, '&lt;' || o_orderpriority || '&gt;' AS t, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS i FROM orders),
c AS (SELECT u, k, count(*) AS n FROM o GROUP BY u, k)
SELECT 0 AS section, NULL AS unit, '<h1>Analysis</h1>' || chr(10) || '<ul><li>units: ' || count(DISTINCT u) || '</li><li>tables: ' || count(DISTINCT k) || '</li><li>statements: ' || count(*) || '</li><li>tokens: ' || count(*) || '</li></ul>' AS html FROM o
UNION ALL SELECT 1, CAST(u AS VARCHAR), '<h2>' || u || '</h2>' || chr(10) || '<table>' || chr(10) || string_agg('<tr><td>' || u || '</td><td>' || k || '</td><td>r</td><td>' || n || '</td></tr>', chr(10) ORDER BY k) || chr(10) || '</table>' FROM c GROUP BY u
UNION ALL SELECT 2, CAST(u AS VARCHAR), '<h3>' || u || '</h3>' || chr(10) || '<ol>' || chr(10) || string_agg('<li>' || l || ' ' || k || ' ' || t || '</li>', chr(10) ORDER BY i) || chr(10) || '</ol>' FROM o WHERE i <= 3 GROUP BY u""",
    "semantic_text": r"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS table_name, p_name || ' ' || p_type AS description FROM part),
w AS (SELECT *, list_filter(string_split_regex(lower(substr(description, 1, 500)), '[^\pL\pN]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT *, list_concat(words, flatten(list_transform(words, lambda x: list_transform(range(1, greatest(1, len(x) - 2) + 1), lambda i: substr(x, i, 3))))) AS gs FROM w),
h AS (SELECT *, list_transform(gs, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS hs FROM g),
v AS (SELECT *, list_transform(range(0, 64), lambda k: CAST(list_sum(list_transform(hs, lambda y: CASE WHEN y % 64 = k THEN CASE WHEN (y // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 0.0 END)) AS DOUBLE)) AS x FROM h),
s AS (SELECT 'public' AS schema_name, table_name, substr(description, 1, 200) AS description, round(list_cosine_similarity(x, (SELECT x FROM v ORDER BY table_name LIMIT 1)), 4) AS similarity FROM v ORDER BY similarity DESC, table_name LIMIT 5) SELECT * FROM s WHERE similarity >= 0.3""",
    "cyclic_closure": """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst, (CASE WHEN b.i > a.i THEN b.i - a.i ELSE a.n - a.i + b.i END)::INTEGER AS distance FROM c a JOIN c b USING (conv_id)""",
    "references": "SELECT r_name AS unit, 'S' || s_suppkey AS statement, 'FROM' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal < 0",
    "co_referenced": "WITH u AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT CAST(b.l_partkey AS VARCHAR) AS other, count(*) AS n_units FROM u a JOIN u b USING (l_orderkey) WHERE a.l_partkey = 7 AND b.l_partkey <> 7 GROUP BY 1",
    "related_by_key": f"SELECT CASE WHEN from_table = 'N7' THEN to_table ELSE from_table END AS other, CASE WHEN from_table = 'N7' THEN 'out' ELSE 'in' END AS direction, string_agg(DISTINCT from_column || '=' || to_column, ',') AS pairs, min(source) AS source FROM {_MANY} WHERE from_table = 'N7' OR to_table = 'N7' GROUP BY 1, 2",
    "related_tables": f"""WITH f AS (SELECT DISTINCT CASE WHEN from_table = 'N7' THEN to_table ELSE from_table END AS other FROM {_MANY} WHERE from_table = 'N7' OR to_table = 'N7'),
l AS (SELECT l_orderkey AS o, s_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), u AS (SELECT o, 'S' || s_suppkey AS t FROM l UNION SELECT o, 'N' || s_nationkey FROM l)
SELECT other, 'FK' AS kind FROM f UNION SELECT DISTINCT b.t, 'CO_REFERENCED' FROM u a JOIN u b USING (o) WHERE a.t = 'N7' AND b.t <> 'N7' AND b.t NOT IN (SELECT other FROM f)""",
    "importance_rank": f"SELECT t AS table_name, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, round(ln(1 + 2 * sum(i) + sum(o)), 4) AS importance FROM (SELECT from_table AS t, 1 AS o, 0 AS i FROM {_MANY} UNION ALL SELECT to_table, 0, 1 FROM {_MANY}) GROUP BY t",
    "upsert_priority": """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS description, CASE WHEN s_suppkey % 2 = 0 THEN 'ddl' ELSE 'user' END AS source, s_acctbal FROM supplier),
o AS (SELECT * FROM s WHERE s_suppkey % 5 < 3), n AS (SELECT s_suppkey, 'new ' || s_suppkey AS description, 'inferred' AS source, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal + 1 END AS s_acctbal FROM s WHERE s_suppkey % 5 > 1)
SELECT s_suppkey, CASE WHEN coalesce(trim(o.description), '') IN ('', 'N/A') THEN coalesce(n.description, o.description) ELSE o.description END AS description, CASE WHEN o.source = 'ddl' THEN 'ddl' ELSE coalesce(n.source, o.source) END AS source, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM o FULL JOIN n USING (s_suppkey)""",
    "detach_delete": "SELECT (SELECT count(*) FROM customer WHERE NOT coalesce(c_nationkey < 5, false)) AS nodes, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)) AS edges",
    "edges_deleted": "SELECT count(*) AS deleted FROM lineitem WHERE l_quantity > 45",
    "not_linked": "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "files_known": "SELECT DISTINCT source AS directory, lang AS file FROM documents WHERE n_chars > 20000",
    "label_histogram": "SELECT label, count(*) AS n FROM (SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents) GROUP BY label",
    "conditional_counts": "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 50) AS large FROM events GROUP BY user_id",
    "nested_sets": "WITH p AS (SELECT user_id, event_type, coalesce(string_agg(DISTINCT json_extract_string(props, '$.k'), ',' ORDER BY json_extract_string(props, '$.k')), '') AS ks FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || ':' || ks, ';' ORDER BY event_type || ':' || ks) AS sets FROM p GROUP BY user_id",
    "graph_view": "SELECT 'Region' AS label, sha256('Region' || chr(1) || r_regionkey) AS node_id FROM region UNION ALL SELECT 'Nation', sha256('Nation' || chr(1) || n_nationkey) FROM nation",
    "greedy_batches": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS tokens, doc_id % 11 = 0 AS alone, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
r AS (SELECT source, doc_id, pos, 1 AS batch, CASE WHEN alone THEN 5001 ELSE tokens END AS t FROM d WHERE pos = 1
UNION ALL SELECT d.source, d.doc_id, d.pos, CASE WHEN d.alone OR r.t + d.tokens > 5000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN d.alone THEN 5001 WHEN r.t + d.tokens > 5000 THEN d.tokens ELSE r.t + d.tokens END FROM r JOIN d ON d.source = r.source AND d.pos = r.pos + 1)
SELECT source, doc_id, batch FROM r""",
    "batch_summary": """WITH RECURSIVE d AS (SELECT o_custkey % 50 AS unit, o_orderkey, o_orderkey % 400 AS tokens, o_orderstatus = 'F' AS dml, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS pos FROM orders),
r AS (SELECT unit, o_orderkey, pos, 1 AS batch, tokens AS t, tokens, dml FROM d WHERE pos = 1 UNION ALL SELECT d.unit, d.o_orderkey, d.pos, CASE WHEN r.t + d.tokens > 1000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.t + d.tokens > 1000 THEN d.tokens ELSE r.t + d.tokens END, d.tokens, d.dml FROM r JOIN d ON d.unit = r.unit AND d.pos = r.pos + 1)
SELECT unit, batch, CAST(count(*) AS INT) AS n_ranges, CAST(count(*) FILTER (dml) AS INT) AS n_dml, CAST(sum(tokens) AS BIGINT) AS tokens, max(o_orderkey) + 1 AS progress_line FROM r GROUP BY unit, batch""",
    "range_join": "SELECT CAST(band AS INT) AS band, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN (VALUES (1, 1, 10), (2, 5, 25), (3, 24, 50)) v(band, low, high) ON l_quantity BETWEEN low AND high GROUP BY 1, 2",
    "lineage_units": _UNITS + """SELECT file, etl_name, array_to_string(ss, ',') AS sources, array_to_string(t, ',') AS targets, op AS operation_type, is_etl FROM l
UNION ALL SELECT 'p' || k || '.sql', 'p' || k, 'REF.N' || n || ',STG.S' || k, 'DW.F' || k % 7 || ',LOG.L' || k % 3, 'ETL', true FROM p UNION ALL SELECT 'p' || k || '.sql', 'q' || k, '', 'DW.G' || k % 5, 'UPDATE', false FROM p""",
    "lineage_edges": _UNITS + "SELECT * FROM x UNION ALL SELECT * FROM px",
    "lineage_nodes": _UNITS + "SELECT dst AS name, string_agg(DISTINCT CASE type WHEN 'ETL_READS' THEN 'SOURCE' ELSE 'TARGET' END, '+' ORDER BY CASE type WHEN 'ETL_READS' THEN 'SOURCE' ELSE 'TARGET' END) AS node_type FROM (SELECT * FROM x UNION ALL SELECT * FROM px) WHERE type <> 'DATA_FLOWS_TO' GROUP BY dst UNION ALL SELECT DISTINCT src, 'ETL' FROM (SELECT * FROM x UNION ALL SELECT * FROM px) WHERE type <> 'DATA_FLOWS_TO'",
    "lineage_statistics": _UNITS + """SELECT file, count(*) AS lineages, count(*) FILTER (is_etl) AS etl_count, CAST(len(list_distinct(flatten(list(ss)))) AS BIGINT) AS sources, CAST(len(list_distinct(flatten(list(t)))) AS BIGINT) AS targets, CAST(sum(CASE WHEN is_etl THEN len(ss) * len(t) ELSE 0 END) AS BIGINT) AS flows FROM l GROUP BY file
UNION ALL SELECT 'p' || k || '.sql', 2, 1, 2, 3, 4 FROM p""",
    "lineage_of_texts": rf"""WITH c AS (SELECT 'doc' || doc_id AS file, text FROM documents UNION ALL SELECT 'page' || page_id, html FROM pages),
d AS (SELECT file, list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)FROM\s+(\w+(?:\.\w+)?)', 1), regexp_extract_all(text, '(?i)JOIN\s+(\w+(?:\.\w+)?)', 1)), lambda x: upper(x)), lambda x: lower(x) NOT IN ({', '.join(map(X.literal, fixed.SYSTEM_NAMES))})))) AS s FROM c WHERE text IS NOT NULL) SELECT file, array_to_string(s, ',') AS sources FROM d WHERE len(s) > 0""",
    "detect_types": _DETECT + "SELECT file, file_type, round(confidence, 4) AS confidence, details, suggested_strategy, suggested_target FROM d JOIN m USING (file_type)",
    "detect_votes": _DETECT + """, v AS (SELECT 'type' AS kind, file_type AS choice, count(*) AS n, sum(CAST(round(confidence, 4) AS DECIMAL(18,4))) AS w FROM d GROUP BY 2 UNION ALL SELECT 'strategy', suggested_strategy, count(*), sum(CAST(round(confidence, 4) AS DECIMAL(18,4))) FROM d JOIN m USING (file_type) GROUP BY 2 UNION ALL SELECT 'target', suggested_target, count(*), sum(CAST(round(confidence, 4) AS DECIMAL(18,4))) FROM d JOIN m USING (file_type) GROUP BY 2)
SELECT kind, choice, n, CAST(w AS DOUBLE) AS weight, row_number() OVER (PARTITION BY kind ORDER BY w DESC, choice <> 'framework', choice) = 1 AS is_first FROM v""",
    "fqns": "SELECT n_nationkey, lower(r_name || '.' || n_name) AS fqn, trim(regexp_replace(' ' || r_name || '/' || n_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe, '&lt;&amp;&#39;&quot;&gt;' || n_name AS html FROM nation JOIN region ON n_regionkey = r_regionkey",
    "domain_classes": f"""SELECT i, coalesce(name <> '' AND name NOT IN ({', '.join(map(X.literal, dict.fromkeys(fixed.BUILTIN_TYPES + fixed.UTILITY_CLASSES)))}) AND length(name) > 1 AND NOT (regexp_matches(name, '^[a-z]') AND length(name) <= 3) AND NOT (name = lower(name) AND length(name) <= 6), false) AS is_domain FROM {V(list(enumerate(X.CLASS_NAMES)), 'i', 'name')}
UNION ALL SELECT c_custkey + 100, CASE c_custkey % 6 WHEN 0 THEN true WHEN 3 THEN length('order' || c_custkey) > 6 WHEN 4 THEN c_custkey % 100 > 9 ELSE false END FROM customer""",
    "use_summary": """SELECT o_orderpriority AS table_name, o_orderstatus AS column_name, coalesce(string_agg(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_custkey % 4 END, '|' ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_custkey % 4 END), '') AS descriptions, arg_min(CAST(o_orderkey % 10 AS VARCHAR), o_orderkey) FILTER (o_orderkey % 2 = 0) AS dtype, arg_max(o_custkey % 2 = 0, o_orderkey) AS nullable,
array_to_string(list_sort(list_distinct(list(CAST(o_custkey % 9 AS VARCHAR))))[1:5], '|') AS examples FROM orders GROUP BY 1, 2""",
    "semantic_top": """WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 ORDER BY vec_id LIMIT 400), p AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 4) AS similarity FROM c, p ORDER BY similarity DESC, vec_id LIMIT 20) SELECT * FROM s WHERE similarity >= 0.05""",
    "prefix_search": "WITH p AS (SELECT substr('nation_1x9', 1, n) AS p, n FROM range(2, 11) r(n)), h AS (SELECT n_name, max(n) AS n FROM nation JOIN p ON contains(lower(n_name), p) GROUP BY n_name) SELECT DISTINCT n_name AS value, substr('nation_1x9', 1, n) AS used FROM h WHERE n = (SELECT max(n) FROM h) ORDER BY value LIMIT 20",
    "ranked_tables": f"WITH i AS (SELECT t, ln(1 + 2 * sum(i) + sum(o)) AS imp FROM (SELECT from_table AS t, 1 AS o, 0 AS i FROM {_MANY} UNION ALL SELECT to_table, 0, 1 FROM {_MANY}) GROUP BY t), n AS (SELECT DISTINCT from_table AS t FROM {_MANY} UNION SELECT 'alone') SELECT n.t AS table_name, round(2 * (length(n.t) / 10 * coalesce(imp, 0)) / (length(n.t) / 10 + coalesce(imp, 0) + 1e-9), 4) AS score FROM n LEFT JOIN i ON i.t = n.t",
    "past_questions": "WITH c AS (SELECT p_partkey, 0.5::DOUBLE * (p_size / 50) + 0.3::DOUBLE * (p_partkey % 11 / 10) + 0.2::DOUBLE * (p_partkey % 3 / 2) AS s FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 50) SELECT p_partkey, round(s, 4) AS final_score, CAST(rank() OVER (ORDER BY s DESC) AS INT) AS rank, CASE WHEN s > 0.9 THEN 'IMMEDIATE_TEMPLATE_REUSE' WHEN s > 0.7 THEN 'ADAPT_TEMPLATE' ELSE 'GENERATE_NEW' END AS action FROM c",
    "mapped_values": """WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type || 'x' END AS term FROM part), v AS (SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL),
e AS (SELECT term, value, 'EXACT' AS kind FROM t JOIN v ON term = value), n AS (SELECT term, value, 1 - levenshtein(lower(term), lower(value)) / greatest(length(term), length(value)) AS s FROM t, v WHERE term NOT IN (SELECT term FROM e))
SELECT * FROM e UNION ALL SELECT term, min({'s': -s, 'value': value}).value, 'SIMILAR' FROM n WHERE s >= 0.8 GROUP BY term""",
    "glossary_list": "SELECT n_nationkey::INTEGER AS glossary_id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'Technical' ELSE 'Business' END AS type, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS term_count FROM nation",
    "glossary_terms": "SELECT s_suppkey::INTEGER AS term_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'Approved' ELSE 'Draft' END AS status, 'D' || s_suppkey % 5 AS domains, 'O' || s_suppkey % 7 AS owners, CASE WHEN s_suppkey % 2 = 0 THEN 'even,t' || s_suppkey % 3 ELSE '' END AS tags FROM supplier",
    "star_register": f"SELECT 'sales' AS cube_name, from_table, from_column, to_table, to_column FROM {_KEYS}",
    "report_totals": "SELECT count(DISTINCT l_suppkey) AS units, count(DISTINCT l_partkey) AS tables, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS statements, (SELECT CAST(sum(q) AS BIGINT) FROM (SELECT max(trunc(l_quantity)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS tokens FROM lineitem",
    "table_usage": "WITH l AS (SELECT l_suppkey % 10 AS unit, l_linestatus AS table_name, l_returnflag, l_orderkey FROM lineitem) SELECT unit, table_name, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS operations, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(l_orderkey)))[1:5], ',') AS contexts FROM l GROUP BY unit, table_name",
    "progress": "SELECT user_id, event_id, CAST(least(99, floor(50 + 50 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) / count(*) OVER (PARTITION BY user_id))) AS INT) AS progress FROM events",
    "event_ndjson": """SELECT event_id AS seq, '{"type":"message","content":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"line_number":' || user_id ELSE '' END || '}' AS value FROM events""",
    "event_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ddl_tables": f"SELECT schema_name, table_name, description, table_type, s = 1 AS is_stub FROM {V([('SALES', 'ORDERS', 'what was ordered', 'BASE TABLE', 0), ('public', 'items', '', 'BASE TABLE', 0), ('SALES', 'CUSTOMERS', '', 'BASE TABLE', 1)], 'schema_name', 'table_name', 'description', 'table_type', 's')}"
    + """ UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'it''s ' || s_name, 'BASE TABLE', false FROM supplier UNION ALL SELECT DISTINCT 'N' || s_nationkey, 'OTHER' || s_nationkey, '', 'BASE TABLE', true FROM supplier WHERE s_suppkey % 3 = 0""",
    "ddl_columns": f"""SELECT schema_name, table_name, column_name, dtype, nullable = 1 AS nullable, description, pk_constraint, lower(schema_name || '.' || table_name || '.' || column_name) AS fqn FROM {V([('SALES', 'ORDERS', 'ID', 'NUMBER(10,2)', 0, "the id's key", 'ORDERS_pkey'), ('SALES', 'ORDERS', 'CUST_ID', 'INTEGER', 1, '', None), ('SALES', 'ORDERS', 'NOTE', 'VARCHAR(20)', 1, '', None), ('public', 'items', 'order_id', 'integer', 0, '', 'items_pkey'), ('public', 'items', 'line_no', 'int', 0, '', 'items_pkey'), ('public', 'items', 'amount', 'numeric(12,2)', 1, '', None)], 'schema_name', 'table_name', 'column_name', 'dtype', 'nullable', 'description', 'pk_constraint')}"""
    + """ UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, c, CASE c WHEN 'AMOUNT' THEN 'NUMBER(10,' || s_suppkey % 5 || ')' ELSE 'INTEGER' END, c <> 'ID', CASE c WHEN 'AMOUNT' THEN 'amount ' || s_suppkey ELSE '' END, CASE c WHEN 'ID' THEN 'S' || s_suppkey || '_pkey' END, lower('N' || s_nationkey || '.S' || s_suppkey || '.' || c) FROM supplier, (VALUES ('ID'), ('AMOUNT'), ('REF_ID')) v(c)""",
    "ddl_foreign_keys": f"SELECT * FROM {V([('SALES', 'ORDERS', 'CUST_ID', 'SALES', 'CUSTOMERS', 'ID'), ('public', 'items', 'order_id', 'SALES', 'ORDERS', 'ID')], 'schema_name', 'table_name', 'column_name', 'to_schema', 'to_table', 'to_column')}"
    + """ UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'REF_ID', 'N' || s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'OTHER' || s_nationkey ELSE 'S' || s_suppkey END, 'ID' FROM supplier""",
    "ddl_primary_keys": f"SELECT * FROM {V([('SALES', 'ORDERS', 'ID', 0), ('public', 'items', 'order_id', 0), ('public', 'items', 'line_no', 1)], 'schema_name', 'table_name', 'column_name', 'ordinal')}"
    + """ UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'ID', 0 FROM supplier""",
    "ddl_statistics": "SELECT 2 + count(*) AS files, 2 + count(*) AS tables, 6 + 3 * count(*) AS columns, 2 + count(*) AS foreign_keys FROM supplier",
    "tree_edges": f"""WITH {_TREES} SELECT 'f.sql' AS file, * FROM {V([(5, 4, 'CONTAINS'), (4, 1, 'PARENT_OF'), (4, 3, 'PARENT_OF'), (3, 2, 'PARENT_OF'), (1, 3, 'NEXT')], 'src', 'dst', 'type')}
UNION ALL SELECT file, m + 2, m + 1, 'CONTAINS' FROM t UNION ALL SELECT file, m + 1, i, 'PARENT_OF' FROM c UNION ALL SELECT file, i, i + 1, 'NEXT' FROM c WHERE i < m""",
    "tree_nodes": f"""WITH {_TREES} SELECT 'f.sql' AS file, node_id, parent_id, kind, unit_id, depth, a = 1 AS analysable, d = 1 AS is_dml, n = 1 AS needs_context FROM {V([(1, 4, 'DECLARE', 4, 2, 0, 0, 0), (2, 3, 'INSERT', 4, 3, 1, 1, 0), (3, 4, 'IF', 4, 2, 1, 0, 1), (4, 5, 'PROCEDURE', 4, 1, 0, 0, 0), (5, None, 'FILE', None, 0, 0, 0, 0)], 'node_id', 'parent_id', 'kind', 'unit_id', 'depth', 'a', 'd', 'n')}
UNION ALL SELECT file, i, m + 1, CASE WHEN i % 2 = 0 THEN 'IF' ELSE 'UPDATE' END, m + 1, 2, true, i % 2 = 1, false FROM c UNION ALL SELECT file, m + 1, m + 2, 'PROCEDURE', m + 1, 1, false, false, false FROM t UNION ALL SELECT file, m + 2, NULL, 'FILE', NULL, 0, false, false, false FROM t""",
    "tree_code": f"""WITH {_TREES}, x AS (SELECT * FROM {V([
        ('skeleton', 1, '2: v INT;'), ('skeleton', 2, '5: INSERT INTO T'), ('skeleton', 3, '4: IF v>0 THEN|    ....|8: END IF;'), ('skeleton', 4, '1: CREATE PROCEDURE P_LOAD|    ....|9: END;'),
        ('placeholder', 1, '2: v INT;'), ('placeholder', 2, '5: INSERT INTO T'), ('placeholder', 3, '4: IF v>0 THEN|5: ...code...|8: END IF;'), ('placeholder', 4, '1: CREATE PROCEDURE P_LOAD|2: ...code...|4: ...code...|9: END;'),
        ('compact', 1, '2: v INT;'), ('compact', 2, '5: INSERT INTO T'), ('compact', 3, '4: IF v>0 THEN|5: INSERT INTO T|8: END IF;'), ('compact', 4, '1: CREATE PROCEDURE P_LOAD|2: IS v INT;|3: BEGIN|4~8: does 3|9: END;')], 'style', 'node_id', 'code')}),
y AS (SELECT unnest(['skeleton', 'placeholder', 'compact']) AS style)
SELECT style, 'f.sql' AS file, node_id, replace(code, '|', chr(10)) AS code FROM x
UNION ALL SELECT style, file, i, 2 * i || ': UPDATE T' || i || chr(10) || (2 * i + 1) || ': SET x' FROM c, y
UNION ALL SELECT style, file, m + 1, '1: CREATE PROCEDURE P' || chr(10) || CASE style WHEN 'skeleton' THEN '    ....' WHEN 'placeholder' THEN (SELECT string_agg(2 * i || ': ...code...', chr(10) ORDER BY i) FROM range(1, m + 1) r(i))
  ELSE (SELECT string_agg(CASE WHEN i % 3 = 0 THEN 2 * i || '~' || (2 * i + 1) || ': does ' || i ELSE 2 * i || ': UPDATE T' || i || chr(10) || (2 * i + 1) || ': SET x' END, chr(10) ORDER BY i) FROM range(1, m + 1) r(i)) END || chr(10) || (2 * m + 2) || ': END;' FROM t, y""",
    "identifiers": f"""SELECT i, coalesce(s, '') AS schema_name, coalesce(t, '') AS table_name, l AS db_link FROM {V([(0, 'RWIS', 'T', 'L1'), (1, 'a', 'b.c', None), (2, '', 'plain', None), (3, 'dbo', 't', None), (4, 's', 't', None), (5, 'S', 'T', None), (6, '', 'q', None), (7, '', 'x', 'l'), (8, '', '', None), (9, '', '', None)], 'i', 's', 't', 'l')}"""
    + """ UNION ALL SELECT c_custkey + 100, CASE c_custkey % 6 WHEN 1 THEN 'n' || c_nationkey WHEN 5 THEN '' ELSE 'N' || c_nationkey END, CASE c_custkey % 6 WHEN 1 THEN 'c' || c_custkey || '.x' ELSE 'C' || c_custkey END, CASE c_custkey % 6 WHEN 0 THEN 'L' || c_nationkey WHEN 5 THEN 'l' END FROM customer""",
    "default_schemas": f"SELECT * FROM {V([(0, 'Sales'), (1, 'public'), (2, 'y'), (3, 'DW'), (4, 'public'), (5, 'public')], 'i', 'schema_name')}"
    + """ UNION ALL SELECT c_custkey + 100, CASE c_custkey % 4 WHEN 0 THEN 'Sales' WHEN 1 THEN 'DW' WHEN 2 THEN 'y' || c_nationkey ELSE 'Sales' END FROM customer""",
    "procedure_names": f"SELECT * FROM {V([(0, 's', 'pkg.p'), (1, None, 'f'), (2, 'A b', 'c'), (3, None, 't1'), (4, None, None)], 'i', 'schema_name', 'name')}"
    + """ UNION ALL SELECT c_custkey + 100, CASE c_custkey % 4 WHEN 0 THEN 'N' || c_nationkey WHEN 2 THEN 'a' || c_nationkey END, CASE c_custkey % 4 WHEN 0 THEN 'P' || c_custkey WHEN 1 THEN 'f' || c_custkey WHEN 2 THEN 'b.c' || c_custkey END FROM customer""",
    "table_uses": f"SELECT * FROM {V([('s1', 'SALES', 'ORDERS', None, 'FROM'), ('s1', 'public', 'items', None, 'FROM'), ('s1', 'public', 'items', None, 'WRITES'), ('s2', 'x', 'y', 'link', 'DB_LINK'), ('s3', 'public', 'unknown', None, 'FROM')], 'src', 'schema_name', 'table_name', 'db_link', 'type')}"
    + """ UNION ALL SELECT 'u' || s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'far' END, CASE WHEN s_suppkey % 3 = 1 THEN 'DB_LINK' ELSE 'FROM' END FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT 'u' || s_suppkey, 'public', 'ghost' || s_suppkey, NULL, m FROM supplier, (VALUES ('FROM'), ('WRITES')) v(m) WHERE s_suppkey % 3 = 2""",
    "provider_access": f"SELECT * FROM {V([('load.sql', 'dw.fact_sales', 'w'), ('load.sql', 'stg.orders', 'r'), ('load.sql', 'stg.items', 'r'), ('load.sql', 'stg.tmp', 'w'), ('load.sql', 'dw.dim_customer', 'w'), ('load.sql', 'stg.customers', 'r'), ('single.sql', 't', 'w'), ('two.sql', 'a', 'w'), ('two.sql', 'b', 'w'), ('two.sql', 'c', 'w')], 'unit_id', 'name', 'mode')}"
    + """ UNION ALL SELECT 'o' || o_orderkey, 'dw.f' || o_custkey % 7, 'w' FROM orders UNION ALL SELECT 'o' || o_orderkey, 'stg.s' || o_orderkey % 11, 'r' FROM orders UNION ALL SELECT 'o' || o_orderkey, 'stg.c' || o_custkey % 5, 'r' FROM orders""",
    "wave_summaries": """
WITH m AS (SELECT l_orderkey AS o, count(*)::INT AS m FROM lineitem GROUP BY 1), b AS (SELECT o, m, unnest(range(1, m + 1))::INT AS i FROM m),
u AS (SELECT *, '2 lines ' || md5((6 * i - 2) || ': UPDATE T' || (o % 50) || chr(10) || (6 * i - 1) || ': SET x = ' || i) AS us, '2 lines ' || md5((6 * i) || ': SELECT ' || i || chr(10) || (6 * i + 1) || ': FROM S' || (i % 3)) AS ss FROM b),
f AS (SELECT *, '4 lines ' || md5((6 * i - 3) || ': IF ' || i || ' THEN' || chr(10) || (6 * i - 2) || '~' || (6 * i - 1) || ': ' || us || chr(10) || (6 * i) || '~' || (6 * i + 1) || ': ' || ss || chr(10) || (6 * i + 2) || ': END IF;') AS fs FROM u),
l AS (SELECT o, m, (m + 2) || ' lines ' || md5('2: FOR r IN (SELECT * FROM F' || o % 4 || ') LOOP' || chr(10) || string_agg((6 * i - 3) || '~' || (6 * i + 2) || ': ' || fs, chr(10) ORDER BY i) || chr(10) || (6 * m + 3) || ': END LOOP;') AS ls FROM f GROUP BY o, m)
SELECT o || '.sql' AS file, 3 * i - 2 AS node_id, us AS summary, true AS ok FROM f UNION ALL SELECT o || '.sql', 3 * i - 1, ss, true FROM f UNION ALL SELECT o || '.sql', 3 * i, fs, true FROM f UNION ALL SELECT o || '.sql', 3 * m + 1, ls, true FROM l
""",
    "run_stream": """
WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_id AS seq, CASE WHEN event_type = 'error' AND value > 50 THEN 'error' WHEN event_type = 'purchase' AND value > 80 THEN 'complete' WHEN event_type = 'signup' THEN 'phase_event' ELSE 'message' END AS type, event_type AS content, event_type = 'signup' AS asks, epoch_ms(ts) AS ms FROM events),
a AS (SELECT *, CASE WHEN coalesce(bool_or(asks) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 32400 ELSE 21600 END AS own, CASE WHEN bool_or(asks) OVER (PARTITION BY run_id ORDER BY seq) THEN 32400 ELSE 21600 END AS later, lag(ms) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM e),
b AS (SELECT *, coalesce(ms - before > 1000 * own, false) AS slow FROM a),
c AS (SELECT * FROM (SELECT *, coalesce(bool_or(slow OR type IN ('error', 'complete')) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM b) WHERE NOT gone),
p AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS no, seq, type, content FROM c WHERE NOT slow AND type <> 'complete'),
l AS (SELECT run_id, max_by(type, seq) AS type, max_by(slow, seq) AS slow, max_by(own, seq) AS own, max_by(later, seq) AS later, max(ms) AS ms, count(*) FILTER (NOT slow AND type <> 'complete') AS n FROM c GROUP BY run_id),
d AS (SELECT *, CASE WHEN slow THEN own WHEN type NOT IN ('error', 'complete') AND ms + 1000 * later < (SELECT max(ms) - 3600000 FROM e) THEN later END AS idle FROM l)
SELECT run_id, no, seq, type, content FROM p UNION ALL SELECT run_id, n + 1, NULL, 'error', 'TimeoutError: ' || idle || ' s' FROM d WHERE idle IS NOT NULL
UNION ALL SELECT run_id, n + CASE WHEN idle IS NULL THEN 1 ELSE 2 END, NULL, 'complete', NULL FROM d WHERE idle IS NOT NULL OR type IN ('error', 'complete')
""",
    "recalled_questions": """
WITH e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT q.key AS question_id, s.key, round(list_cosine_similarity(q.v, s.v), 9) AS similarity FROM e q JOIN e s ON q.key % 100 = 0 AND s.key % 100 <> 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, key) AS r FROM n) WHERE r <= 10),
f AS (SELECT question_id, key, round(0.5::DOUBLE * similarity + 0.3::DOUBLE * (key % 11 / 10) + 0.2::DOUBLE * (key % 3 / 2), 9) AS final_score FROM t)
SELECT question_id, key, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, key)::INTEGER AS rank, CASE WHEN final_score > 0.9 THEN 'IMMEDIATE_TEMPLATE_REUSE' WHEN final_score > 0.7 THEN 'ADAPT_TEMPLATE' ELSE 'GENERATE_NEW' END AS action FROM f
""",
    "class_summaries": """WITH k AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT 'OrderService' AS name, 'fields count, customers, store' || chr(10) || 'bill takes Customer, int; returns Invoice; calls store.save' AS summary
UNION ALL SELECT unnest(['BaseService', 'OrderStore', 'Auditable', 'Customer', 'Invoice']), 'class without fields and methods'
UNION ALL SELECT 'S' || k, 'fields part' || chr(10) || 'make takes R' || k % 3 || ', int; returns Q' || k % 5 || '; calls part.run; makes T' || k % 4 FROM k
UNION ALL SELECT DISTINCT unnest(['B' || n, 'P' || k % 7, 'Q' || k % 5, 'R' || k % 3, 'T' || k % 4]), 'class without fields and methods' FROM k""",
    "class_stories": """SELECT c AS name, 'US-1' AS story_id, 'user of ' || c AS role, m AS goal, 'get ' || r AS benefit, 'AC-1-1' AS criterion_id, c || '.' || m AS title FROM (SELECT 'OrderService' AS c, 'bill' AS m, 'Invoice' AS r UNION ALL SELECT 'S' || s_suppkey, 'make', 'Q' || s_suppkey % 5 FROM supplier)""",
    "class_contexts": """SELECT f AS file, m AS name, '[CONTEXT]' || chr(10) || 'CLASS ' || c || ' 1~' || e || ': ' || s || chr(10) || '[/CONTEXT]' || chr(10) AS context
FROM (SELECT 'A.java' AS f, 'bill' AS m, 'OrderService' AS c, 12 AS e, 'fields count, customers, store' || chr(10) || 'bill takes Customer, int; returns Invoice; calls store.save' AS s
  UNION ALL SELECT 'S' || s_suppkey || '.java', 'make', 'S' || s_suppkey, 8, 'fields part' || chr(10) || 'make takes R' || s_suppkey % 3 || ', int; returns Q' || s_suppkey % 5 || '; calls part.run; makes T' || s_suppkey % 4 FROM supplier)""",
    "store_merge": """WITH s AS (SELECT s_suppkey AS k, sha256('Supplier' || chr(1) || s_suppkey) AS id FROM supplier)
SELECT 'node' AS kind, id AS node_id, CASE WHEN k % 5 < 2 THEN '{"k":' || k || ',"n":"old"}' ELSE '{"d":' || k % 7 || ',"k":' || k || ',"n":"new"}' END AS props, NULL AS holder FROM s
UNION ALL SELECT 'rejected', 'second-' || k, '{"k":' || k || '}', id FROM s WHERE k % 10 = 0""",
    "ledger_state": """SELECT o_orderstatus AS directory, o_orderkey::VARCHAR AS file, CASE WHEN o_orderkey % 5 = 3 THEN 'PH2_OK' WHEN o_orderkey % 15 = 4 THEN 'PH2_FAIL' WHEN o_orderkey % 5 > 1 OR o_orderkey % 10 = 0 THEN 'PH1_OK' WHEN o_orderkey % 5 = 0 THEN 'PH1_FAIL' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderkey % 15 = 4 THEN 'later' WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'broken' END AS message, o_orderkey % 5 IN (2, 4) OR o_orderkey % 10 = 0 AS pending FROM orders""",
    "tree_heights": "SELECT conv_id, turn, (count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS height FROM conversations",
    "node_names": """WITH m AS (SELECT l_orderkey AS o, count(*)::INT AS m FROM lineitem GROUP BY 1), b AS (SELECT o, unnest(range(1, m + 1))::INT AS i FROM m)
SELECT o || '.sql' AS file, unnest([3 * i - 2, 3 * i - 1, 3 * i]) AS node_id, unnest(['UPDATE[' || (6 * i - 2) || ']', 'SELECT[' || (6 * i) || ']', 'IF[' || (6 * i - 3) || ']']) AS name FROM b
UNION ALL SELECT o || '.sql', unnest([3 * m + 1, 3 * m + 2, 3 * m + 3]), unnest(['LOOP[2]', 'P' || o, o || '.sql']) FROM m""",
    "first_of_each": """SELECT s_nationkey, arg_min(s_suppkey, {'b': s_acctbal, 'k': s_suppkey}) AS s_suppkey, array_to_string(list_sort(list(s_name))[:2], ', ') || CASE WHEN count(*) > 2 THEN ' … ' || (count(*) - 2) || ' more' ELSE '' END AS preview FROM supplier GROUP BY s_nationkey""",
    "provided_vectors": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE concat_ws(',', length(p_name), length(p_name) - length(regexp_replace(p_name, '[aeiou]', '', 'g')), length(p_name) - length(regexp_replace(p_name, '[0-9]', '', 'g'))) END AS vector FROM part",
}
