"""Queries of metadata analytics: the catalog of the given tables against one that differs from it by rules, routines and
objects derived from events, graphs of rows, and tables that stand in for job histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graphs as G
from tidemark.operators import metadata as M
from tidemark.operators import validation as V
from tidemark.plans.queries_data import CATALOG_SQL, TABLES
from tidemark.plans.registry import register
from tidemark.sources import scans
from tidemark.sources.scans import table

col, lit = F.col, F.lit

# --- the catalog and its counterpart ------------------------------------------------------------

SOURCE_SQL = f"(SELECT table_name, ordinal, column_name, data_type, ordinal > 0 AS nullable FROM ({CATALOG_SQL}))"
#: The target has lost columns whose names' lengths are multiples of 7 and the table ``pages``, has other types and nullability by place, names in upper case, and a column more in each table.
TARGET_SQL = f"""(SELECT upper(table_name) AS table_name, ordinal, column_name, CASE WHEN data_type = 'bigint' AND ordinal % 3 = 1 THEN 'int' ELSE data_type END AS data_type, ordinal % 4 = 1 AS nullable FROM {SOURCE_SQL} WHERE length(column_name) % 7 <> 0 AND table_name <> 'pages'
UNION ALL SELECT DISTINCT upper(table_name), 99, 'loaded_at', 'timestamp', true FROM {SOURCE_SQL} WHERE table_name <> 'pages')"""
DIGITS_SQL = "CASE data_type WHEN 'bigint' THEN 19 WHEN 'int' THEN 10 WHEN 'double' THEN 53 END"


def source_catalog(spark, d) -> DataFrame:
    return scans.discover(spark, {t: table(spark, d, t) for t in TABLES}).withColumn("nullable", col("ordinal") > 0)


def target_catalog(spark, d) -> DataFrame:
    kept = source_catalog(spark, d).where((F.length("column_name") % 7 != 0) & (col("table_name") != "pages"))
    kind = F.when((col("data_type") == "bigint") & (col("ordinal") % 3 == 1), "int").otherwise(col("data_type"))
    more = source_catalog(spark, d).where("table_name <> 'pages'").select(F.upper("table_name").alias("table_name")).distinct()
    return kept.select(F.upper("table_name").alias("table_name"), "ordinal", "column_name", kind.alias("data_type"), (col("ordinal") % 4 == 1).alias("nullable")).unionByName(more.select("table_name", lit(99).alias("ordinal"), lit("loaded_at").alias("column_name"), lit("timestamp").alias("data_type"), lit(True).alias("nullable")))


def objects_of(catalog: DataFrame) -> DataFrame:
    one = F.concat(col("column_name"), lit(" "), col("data_type"))
    return catalog.groupBy(col("table_name").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("text")))), lambda c: c["text"]), ", ").alias("definition"))


OBJECTS_OF = "(SELECT table_name AS name, string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal) AS definition FROM {} GROUP BY table_name)"


@register("diff_objects", f"SELECT coalesce(lower(s.name), lower(t.name)) AS name, CASE WHEN t.name IS NULL THEN 'source_only' WHEN s.name IS NULL THEN 'target_only' WHEN s.definition = t.definition THEN 'exact' ELSE 'partial' END AS state FROM {OBJECTS_OF.format(SOURCE_SQL)} s FULL JOIN {OBJECTS_OF.format(TARGET_SQL)} t ON lower(s.name) = lower(t.name)")
def diff_objects(spark, d):
    return M.diff_objects(objects_of(source_catalog(spark, d)), objects_of(target_catalog(spark, d)))


COLUMNS_OF = "(SELECT lower(table_name) || '.' || column_name AS name, data_type AS type, " + DIGITS_SQL + " AS precision, nullable, CASE WHEN ordinal % 5 = 2 THEN {} END AS default_value FROM {})"


def columns_of(catalog: DataFrame, default: str) -> DataFrame:
    digits = F.when(col("data_type") == "bigint", 19).when(col("data_type") == "int", 10).when(col("data_type") == "double", 53)
    return catalog.select(F.concat(F.lower("table_name"), lit("."), "column_name").alias("name"), col("data_type").alias("type"), digits.alias("precision"), "nullable", F.when(col("ordinal") % 5 == 2, default).alias("default_value"))


@register("diff_columns", f"""WITH j AS (SELECT coalesce(s.name, t.name) AS name, s.name IS NULL OR t.name IS NULL AS alone, s.type IS DISTINCT FROM t.type AS a, s.precision IS DISTINCT FROM t.precision AS b, s.nullable IS DISTINCT FROM t.nullable AS c, s.default_value IS DISTINCT FROM t.default_value AS e FROM {COLUMNS_OF.format("'0'", SOURCE_SQL)} s FULL JOIN {COLUMNS_OF.format("'1'", TARGET_SQL)} t ON s.name = t.name)
SELECT name, 'existence' AS property, 'blocker' AS severity FROM j WHERE alone UNION ALL SELECT name, 'type', 'blocker' FROM j WHERE NOT alone AND a UNION ALL SELECT name, 'precision', 'info' FROM j WHERE NOT alone AND b UNION ALL SELECT name, 'nullable', 'warning' FROM j WHERE NOT alone AND c UNION ALL SELECT name, 'default_value', 'info' FROM j WHERE NOT alone AND e""")
def diff_columns(spark, d):
    return M.diff_columns(columns_of(source_catalog(spark, d), "0"), columns_of(target_catalog(spark, d), "1"))


#: Indexes on columns of these tables, unique as far as the table's rows are.
INDEXED = (("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey"), ("supplier", "s_suppkey"), ("events", "event_id"), ("events", "user_id"), ("pages", "url"), ("labels", "doc_id"))
MEASURED_SQL = "(" + " UNION ALL ".join(f"SELECT 'ix_{c}' AS name, '{c}' AS columns, count(*) = count(DISTINCT {c}) AS is_unique FROM {t}" for t, c in INDEXED) + ")"


def measured_indexes(spark, d) -> DataFrame:
    """Uniqueness as found in the tables' rows."""
    parts = [table(spark, d, t).select(c).where(col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), lit(1)).alias("most")).select(lit(f"ix_{c}").alias("name"), lit(c).alias("columns"), (col("most") == 1).alias("is_unique")) for t, c in INDEXED]
    return reduce(DataFrame.unionByName, parts)


@register("diff_indexes", f"SELECT * FROM (SELECT coalesce(s.name, lower(t.name)) AS name, CASE WHEN t.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'extra' WHEN s.columns <> t.columns THEN 'key_columns' WHEN s.is_unique AND NOT t.is_unique THEN 'uniqueness_lost' END AS issue FROM {MEASURED_SQL} s FULL JOIN (SELECT upper(name) || CASE WHEN length(name) % 5 = 0 THEN '_new' ELSE '' END AS name, CASE WHEN length(name) % 4 = 0 THEN columns || ',x' ELSE columns END AS columns, false AS is_unique FROM {MEASURED_SQL}) t ON lower(t.name) = s.name) WHERE issue IS NOT NULL")
def diff_indexes(spark, d):
    """Against indexes that are unique no more, on more columns or under other names, by the lengths of their names."""
    source, n = measured_indexes(spark, d), F.length("name")
    target = source.select(F.concat(F.upper("name"), F.when(n % 5 == 0, "_new").otherwise("")).alias("name"), F.when(n % 4 == 0, F.concat("columns", lit(",x"))).otherwise(col("columns")).alias("columns"), lit(False).alias("is_unique"))
    return M.diff_indexes(source, target)


CONSTRAINTS_SQL = f"(SELECT CASE WHEN is_unique THEN 'uq_' ELSE 'fk_' END || columns AS name, CASE WHEN is_unique THEN 'unique' ELSE 'foreign_key' END AS kind FROM {MEASURED_SQL})"


def measured_constraints(spark, d) -> DataFrame:
    return measured_indexes(spark, d).select(F.concat(F.when(col("is_unique"), "uq_").otherwise("fk_"), "columns").alias("name"), F.when(col("is_unique"), "unique").otherwise("foreign_key").alias("kind"))


@register("diff_constraints", f"SELECT * FROM (SELECT coalesce(lower(s.name), lower(t.name)) AS name, CASE WHEN t.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'extra' WHEN s.kind <> t.kind THEN 'kind_changed' END AS issue FROM {CONSTRAINTS_SQL} s FULL JOIN (SELECT upper(name) AS name, CASE WHEN length(name) % 2 = 0 THEN 'primary_key' ELSE kind END AS kind FROM {CONSTRAINTS_SQL} WHERE name NOT LIKE '%\\_n%' ESCAPE '\\') t ON lower(s.name) = lower(t.name)) WHERE issue IS NOT NULL")
def diff_constraints(spark, d):
    source = measured_constraints(spark, d)
    target = source.where(~col("name").contains("_n")).select(F.upper("name").alias("name"), F.when(F.length("name") % 2 == 0, "primary_key").otherwise(col("kind")).alias("kind"))
    return M.diff_constraints(source, target)


@register("val_constraint_plan", f"SELECT name, CASE kind WHEN 'foreign_key' THEN 'disable' ELSE 'keep' END AS action FROM {CONSTRAINTS_SQL} UNION ALL SELECT name, 'drop_and_rebuild' FROM {MEASURED_SQL}")
def val_constraint_plan(spark, d):
    """Constraints and indexes as measured in the tables."""
    return M.constraint_plan(measured_constraints(spark, d).unionByName(measured_indexes(spark, d).select("name", lit("INDEX").alias("kind"))))


KEYED_SQL = "(SELECT lower(table_name) AS table_name, lower(column_name) AS column_name, {} AS is_key FROM {})"


@register("diff_drift", f"""WITH s AS {KEYED_SQL.format('ordinal = 0', SOURCE_SQL)}, t AS {KEYED_SQL.format('ordinal = 0 AND length(table_name) % 2 = 0', TARGET_SQL)}, there AS (SELECT DISTINCT table_name FROM t)
SELECT DISTINCT table_name, NULL AS column_name, 'missing_table' AS concern, 'blocker' AS severity FROM s WHERE table_name NOT IN (SELECT * FROM there) UNION ALL
SELECT table_name, column_name, concern, CASE concern WHEN 'extra_column' THEN 'info' ELSE 'warning' END FROM (SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.column_name, t.column_name) AS column_name, CASE WHEN t.is_key IS NULL THEN 'missing_column' WHEN s.is_key IS NULL THEN 'extra_column' WHEN s.is_key <> t.is_key THEN 'key_mismatch' END AS concern FROM s FULL JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name) WHERE concern IS NOT NULL AND table_name IN (SELECT * FROM there)""")
def diff_drift(spark, d):
    source = source_catalog(spark, d).select("table_name", "column_name", (col("ordinal") == 0).alias("is_key"))
    target = target_catalog(spark, d).select("table_name", "column_name", ((col("ordinal") == 0) & (F.length("table_name") % 2 == 0)).alias("is_key"))
    return M.schema_drift(source, target)


@register("diff_transfer_preflight", f"""SELECT lower(s.table_name) || '.' || s.column_name AS name, CASE WHEN t.data_type IS NULL THEN 'blocker:missing' WHEN s.nullable AND NOT t.nullable THEN 'blocker:nulls' WHEN s.data_type = 'alias_type' THEN 'warning:alias' ELSE 'ok' END AS verdict
FROM (SELECT table_name, column_name, nullable, CASE WHEN data_type LIKE 'array%' THEN 'alias_type' ELSE data_type END AS data_type FROM {SOURCE_SQL}) s LEFT JOIN {TARGET_SQL} t ON lower(t.table_name) = s.table_name AND t.column_name = s.column_name""")
def diff_transfer_preflight(spark, d):
    s = source_catalog(spark, d).select("table_name", "column_name", F.when(col("data_type").startswith("array"), "alias_type").otherwise(col("data_type")).alias("type"), "nullable")
    t = target_catalog(spark, d).select(F.lower("table_name").alias("table_name"), "column_name", col("data_type").alias("target_type"), col("nullable").alias("target_nullable"))
    return M.transfer_preflight(s.join(t, ["table_name", "column_name"], "left").select(F.concat("table_name", lit("."), "column_name").alias("name"), "type", "nullable", "target_type", "target_nullable"))


# A tree of rows: the database, regions, nations, customers and their orders, which have the severities.
ORDER_SEVERITY = "CASE WHEN o_totalprice > 499000 THEN 'blocker' WHEN o_orderstatus = 'P' AND o_totalprice > 480000 THEN 'warning' WHEN o_totalprice > 400000 THEN 'info' ELSE 'match' END"
TREE_SQL = f"(SELECT 'db' AS id, NULL AS parent, 'match' AS severity UNION ALL SELECT 'r' || r_regionkey, 'db', 'match' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'match' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'match' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, {ORDER_SEVERITY} FROM orders)"


@register("diff_tree_rollup", f"WITH RECURSIVE u AS (SELECT id AS node, severity FROM {TREE_SQL} UNION SELECT n.parent, u.severity FROM u JOIN {TREE_SQL} n ON n.id = u.node WHERE n.parent IS NOT NULL) SELECT node AS id, ['match', 'info', 'warning', 'blocker'][max(CASE severity WHEN 'blocker' THEN 4 WHEN 'warning' THEN 3 WHEN 'info' THEN 2 ELSE 1 END)] AS worst FROM u GROUP BY node")
def diff_tree_rollup(spark, d):
    node = lambda t, letter, key, up, parent, severity="'match'": table(spark, d, t).select(F.concat(lit(letter), col(key)).alias("id"), F.concat(lit(up), col(parent)).alias("parent"), F.expr(severity).alias("severity"))
    top = table(spark, d, "region").select(F.concat(lit("r"), "r_regionkey").alias("id"), lit("db").alias("parent"), lit("match").alias("severity"))
    return G.worst_below(top.unionByName(node("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(node("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(node("orders", "o", "o_orderkey", "c", "o_custkey", ORDER_SEVERITY)))


# --- readiness ----------------------------------------------------------------------------------

#: The catalog in another system's types: texts without end, a type that has no counterpart, collations and a computed column.
LONG_TEXTS = ("text", "html", "props")
ASSESSED_SQL = f"(SELECT table_name, column_name, CASE WHEN data_type = 'string' THEN 'nvarchar' WHEN data_type LIKE 'array%' THEN 'sql_variant' ELSE data_type END AS type, CASE WHEN column_name IN {LONG_TEXTS} THEN -1 ELSE 100 END AS max_length, CASE WHEN data_type = 'string' AND ordinal % 2 = 0 THEN 'Latin1_General_CI_AS' END AS collation_name, column_name = 'n_chars' AS is_computed FROM {SOURCE_SQL})"
KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id"), ("labels", "doc_id"), ("conversations", "conv_id"))
ASSESSED_TABLES_SQL = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{t}' = 'events' AS is_temporal, '{t}' = 'region' AS in_memory, count(*) * 100 AS row_count, count(*) = count(DISTINCT {k}) AS has_key FROM {t}" for t, k in KEYS) + ")"


def assessed(spark, d) -> DataFrame:
    """The given tables with a hundred times their rows; a first column that repeats is no key."""
    parts = [table(spark, d, t).groupBy(k).agg(F.count("*").alias("n")).agg((F.coalesce(F.sum("n"), lit(0)) * 100).alias("row_count"), (F.coalesce(F.max("n"), lit(1)) == 1).alias("has_key")).select(lit(t).alias("table_name"), lit(t == "events").alias("is_temporal"), lit(t == "region").alias("in_memory"), "row_count", "has_key") for t, k in KEYS]
    c = source_catalog(spark, d)
    kind = F.when(col("data_type") == "string", "nvarchar").when(col("data_type").startswith("array"), "sql_variant").otherwise(col("data_type"))
    columns = c.select("table_name", "column_name", kind.alias("type"), F.when(col("column_name").isin(*LONG_TEXTS), -1).otherwise(100).alias("max_length"), F.when((col("data_type") == "string") & (col("ordinal") % 2 == 0), "Latin1_General_CI_AS").alias("collation_name"), (col("column_name") == "n_chars").alias("is_computed"))
    return M.assess_tables(reduce(DataFrame.unionByName, parts), columns)


SENSITIVE = " OR ".join(f"regexp_matches(column_name, '{p}')" for p, _, _ in M.CLASSES)
ASSESS_SQL = f"""(SELECT table_name, least(100, points)::INT AS score, blockers::INT AS blockers, warnings::INT AS warnings, floor(greatest(0.1::DOUBLE, row_count::DOUBLE / CASE WHEN l > 0 THEN 5000 ELSE 60000 END) * 100 + 0.5) / 100 AS minutes, CASE WHEN blockers > 0 OR least(100, points) >= 80 THEN 'BLOCKER' WHEN warnings > 0 OR points >= 30 THEN 'WARNING' ELSE 'SAFE' END AS tier
FROM (SELECT t.*, l, 40 * b + 8 * l + 5 * ci + 5 * cc + least(15, 3 * s) + CASE WHEN has_key THEN 0 ELSE 50 END + CASE WHEN is_temporal THEN 20 ELSE 0 END + CASE WHEN in_memory THEN 15 ELSE 0 END + CASE WHEN row_count > 1000000 THEN 10 ELSE 0 END + CASE WHEN row_count > 100000000 THEN 10 ELSE 0 END AS points,
b + CASE WHEN has_key THEN 0 ELSE 1 END AS blockers, cc + (l > 0)::INT + (ci > 0)::INT + (s > 0)::INT + is_temporal::INT + in_memory::INT + (row_count > 100000000)::INT AS warnings FROM {ASSESSED_TABLES_SQL} t JOIN
(SELECT table_name, count(*) FILTER (WHERE type IN ('hierarchyid', 'geography', 'geometry', 'sql_variant')) AS b, count(*) FILTER (WHERE type IN ('text', 'ntext', 'image', 'xml') OR (type IN ('varchar', 'nvarchar', 'varbinary') AND max_length = -1)) AS l, count(*) FILTER (WHERE collation_name LIKE '%\\_CI\\_%' ESCAPE '\\') AS ci, count(*) FILTER (WHERE is_computed) AS cc, count(*) FILTER (WHERE {SENSITIVE}) AS s FROM {ASSESSED_SQL} GROUP BY table_name) c USING (table_name)))"""


@register("assess_table", f"SELECT * FROM {ASSESS_SQL}")
def assess_table(spark, d):
    return assessed(spark, d)


@register("assess_database", f"SELECT count(*) AS tables, count(*) FILTER (WHERE tier = 'SAFE') AS safe, count(*) FILTER (WHERE tier = 'WARNING') AS warned, count(*) FILTER (WHERE tier = 'BLOCKER') AS blocked, CASE WHEN bool_or(tier = 'BLOCKER') THEN 'BLOCKER' WHEN bool_or(tier = 'WARNING') THEN 'WARNING' ELSE 'SAFE' END AS worst FROM {ASSESS_SQL}")
def assess_database(spark, d):
    n = lambda t: F.count(F.when(col("tier") == t, 1))
    return assessed(spark, d).agg(F.count("*").alias("tables"), n("SAFE").alias("safe"), n("WARNING").alias("warned"), n("BLOCKER").alias("blocked"), F.when(n("BLOCKER") > 0, "BLOCKER").when(n("WARNING") > 0, "WARNING").otherwise("SAFE").alias("worst"))


@register("val_premigration", f"SELECT table_name, 'unsupported_type' AS issue FROM {ASSESSED_SQL} WHERE type = 'sql_variant' UNION ALL SELECT table_name, 'no_primary_key' FROM {ASSESSED_TABLES_SQL} WHERE NOT has_key UNION ALL SELECT table_name, 'active_triggers' FROM {ASSESSED_TABLES_SQL} WHERE row_count // 100 % 2 = 1")
def val_premigration(spark, d):
    """Types from the catalog, keys as found in the rows; tables of an odd number of rows have triggers."""
    c = source_catalog(spark, d)
    columns = c.select("table_name", F.when(col("data_type").startswith("array"), "SQL_VARIANT").otherwise(col("data_type")).alias("type"))
    parts = [table(spark, d, t).groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), lit(0)).alias("rows"), (F.coalesce(F.max("n"), lit(1)) == 1).alias("has_key")).select(lit(t).alias("table_name"), "has_key", (col("rows") % 2).cast("int").alias("triggers")) for t, k in KEYS]
    return M.premigration_issues(columns, reduce(DataFrame.unionByName, parts))


#: Texts of routines: each event has one of these, and its type at the end.
BODIES = (
    "SELECT 1 FROM t -- ", "DECLARE c CURSOR FOR SELECT x FROM t; FETCH NEXT FROM c -- ", "EXEC sp_executesql @q -- ", "MERGE INTO t USING s ON t.k = s.k -- ", "BEGIN TRY SELECT 1 END TRY -- ",
    "SELECT ''CURSOR'' AS word, ''a''''MERGE'' AS b -- ", "EXECUTE dbo.next_step -- ", "CREATE ASSEMBLY a -- ", "SELECT a INTO #t FROM b; WAITFOR DELAY x -- ", "SELECT x FROM t FOR XML PATH -- ", "UPDATE t SET a = 1 OUTPUT inserted.a -- ",
    "SELECT * FROM OPENQUERY(far, q) -- ", "SELECT GETDATE(), ISNULL(a, 0) FROM LINKED_SERVER.t -- ",
)
BODY_SQL = "[" + ", ".join(f"'{b}'" for b in BODIES) + f"][event_id % {len(BODIES) + 1} + 1] || event_type"
ROUTINES_SQL = f"(SELECT event_id AS name, {BODY_SQL} AS body, user_id % 2 = 1 AS is_function FROM events)"


def routines(spark, d) -> DataFrame:
    """A routine an event; every fourteenth has no text."""
    body = F.concat(F.get(F.array(*[lit(b.replace("''", "'")) for b in BODIES]), (col("event_id") % (len(BODIES) + 1)).cast("int")), "event_type")
    return table(spark, d, "events").select(col("event_id").alias("name"), body.alias("body"), (col("user_id") % 2 == 1).alias("is_function"))


_HITS = [(f"regexp_matches(x, '{p}')", level) for _, p, level in M.ROUTINE_PATTERNS]
ROUTINE_SQL = f"""(SELECT name, CASE WHEN read THEN ['simple', 'moderate', 'complex', 'extreme'][level + 1] ELSE 'extreme' END AS difficulty, score, CASE WHEN read THEN [2.0, 5.0, 15.0, 30.0][level + 1]::DOUBLE ELSE 0.0::DOUBLE END AS minutes, blockers, CASE WHEN blockers > 0 OR score >= 80 THEN 'BLOCKER' WHEN found OR is_function OR score >= 30 THEN 'WARNING' ELSE 'SAFE' END AS tier
FROM (SELECT *, CASE WHEN read THEN least(100, [10, 35, 55, 85][level + 1] + 15 * b)::INT ELSE 100 END AS score, CASE WHEN read THEN b ELSE 1 END::INT AS blockers FROM (SELECT *, {' + '.join(f"(upper(coalesce(body, '')) LIKE '%{m.replace('_', '!_')}%' ESCAPE '!')::INT" for m in M.ROUTINE_BLOCKERS)} + (level = 3)::INT AS b
FROM (SELECT *, coalesce(trim(body), '') <> '' AS read, greatest(0, {', '.join(f'CASE WHEN {h} THEN {v} ELSE 0 END' for h, v in _HITS if v)}) AS level, {' OR '.join(h for h, _ in _HITS)} AS found FROM (SELECT *, lower(regexp_replace(coalesce(body, ''), '''(''''|[^''])*''', '''''', 'g')) AS x FROM {ROUTINES_SQL})))))"""


@register("assess_routine", f"SELECT * FROM {ROUTINE_SQL}")
def assess_routine(spark, d):
    return M.assess_routines(routines(spark, d))


NAMES = (*TABLES, "gone", "lost")


@register("assess_routine_deps", f"SELECT name, (used NOT IN {TABLES})::INT AS missing, CASE WHEN used NOT IN {TABLES} THEN 'BLOCKER' ELSE tier END AS tier FROM {ROUTINE_SQL} JOIN (SELECT event_id AS name, {list(NAMES)}[event_id % {len(NAMES)} + 1] AS used FROM events) USING (name)")
def assess_routine_deps(spark, d):
    """Each routine uses a table, some of them tables that aren't there."""
    used = F.get(F.array(*[lit(n.upper()) for n in NAMES]), (col("event_id") % len(NAMES)).cast("int"))
    uses = table(spark, d, "events").select(col("event_id").alias("name"), used.alias("used"))
    return M.routine_dependencies(M.assess_routines(routines(spark, d)), uses, source_catalog(spark, d).select("table_name").distinct())


COMPAT_SQL = f"""(SELECT name, issues, CASE WHEN u > 0 THEN 'unsupported' WHEN m > 0 THEN 'partial' WHEN r > 0 THEN 'risky' WHEN s > 0 THEN 'performance_risk' ELSE 'auto_convertible' END AS status, greatest(0.0, 100.0 - 10.0 * issues)::DOUBLE AS auto_percent FROM (SELECT *, (u + m + r + s + (kind = 'procedure')::INT)::INT AS issues FROM
(SELECT name, kind, {' + '.join(f"contains(x, '{f}')::INT" for f in M.UNSUPPORTED_FEATURES)} AS u, {' + '.join(f"contains(x, '{f}')::INT" for f in M.MANUAL_FEATURES)} + (kind = 'trigger')::INT AS m, (name % 5 = 0)::INT + (name % 15 = 0)::INT AS r, (name % 3 = 1)::INT AS s FROM (SELECT name, upper(coalesce(body, '')) AS x, ['procedure', 'trigger', 'view', 'table'][name % 4 + 1] AS kind FROM {ROUTINES_SQL}))))"""


def compatibility(spark, d) -> DataFrame:
    kind = F.get(F.array(*map(lit, ("procedure", "trigger", "view", "table"))), (col("name") % 4).cast("int"))
    types = F.when(col("name") % 15 == 0, F.array(lit("geometry"), lit("int"), lit("TIMESTAMP"))).when(col("name") % 5 == 0, F.array(lit("rowversion"))).otherwise(F.array(lit("int")))
    return M.analyze_compatibility(routines(spark, d).select("name", kind.alias("kind"), col("body").alias("definition"), types.alias("types"), (col("name") % 3 == 1).alias("slow")))


@register("compat_analyze", f"SELECT * FROM {COMPAT_SQL}")
def compat_analyze(spark, d):
    """The routines' texts as objects of four kinds, some with columns of risky types, some slow."""
    return compatibility(spark, d)


COUNTS = f"(SELECT count(*) AS total, count(*) FILTER (WHERE status = 'auto_convertible') AS auto, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE status = 'risky') AS risky, count(*) FILTER (WHERE status = 'performance_risk') AS performance_risk FROM {COMPAT_SQL})"


@register("report_migration", f"SELECT *, round(100.0 * auto / total, 1)::DOUBLE AS auto_percent, round(auto * 0.1 + partial * 2.0 + unsupported * 4.0 + risky, 1)::DOUBLE AS effort_hours, least(total * 2, 480)::BIGINT AS downtime_minutes FROM {COUNTS}")
def report_migration(spark, d):
    return M.migration_report(compatibility(spark, d))


EXECUTIVE_SQL = f"(SELECT p AS auto_percent, days AS person_days, least(100, floor(unsupported * 8 + partial * 3 + risky * 5 + 10 + greatest(0, 100 - p)))::INT AS risk, greatest(2, least(24, floor(days / 5) + 1))::INT AS weeks FROM (SELECT *, round(100.0 * auto / total, 1)::DOUBLE AS p, round((auto * 0.1 + partial * 2.0 + unsupported * 8.0 + risky * 4.0) / 8, 1)::DOUBLE AS days FROM {COUNTS}))"


@register("report_executive", f"SELECT * FROM {EXECUTIVE_SQL}")
def report_executive(spark, d):
    return M.executive_report(compatibility(spark, d), blockers=1)


@register("report_phases", f"SELECT v.phase, v.name, CASE v.phase WHEN 1 THEN greatest(1, weeks // 4) WHEN 2 THEN greatest(2, weeks // 2) WHEN 3 THEN greatest(1, weeks // 4) ELSE 2 END::INT AS weeks FROM {EXECUTIVE_SQL}, (VALUES (1, 'Assess & Plan'), (2, 'Migrate Waves'), (3, 'Validate & Cutover'), (4, 'Stabilize')) v(phase, name)")
def report_phases(spark, d):
    return M.phases(M.executive_report(compatibility(spark, d), blockers=1))


@register("val_rollup", f"SELECT count(*) AS checks, count(*) FILTER (WHERE tier = 'SAFE') AS passed, count(*) FILTER (WHERE tier = 'BLOCKER') AS failed, count(*) FILTER (WHERE tier = 'WARNING') AS warned, CASE WHEN bool_or(tier = 'BLOCKER') THEN 'FAILED' WHEN bool_or(tier = 'WARNING') THEN 'WARNING' ELSE 'PASSED' END AS status FROM {ASSESS_SQL}")
def val_rollup(spark, d):
    """The tables' tiers as results of checks."""
    status = F.when(col("tier") == "BLOCKER", "FAILED").when(col("tier") == "WARNING", "WARNING").otherwise("PASSED")
    return V.rollup(assessed(spark, d).select(status.alias("status")))


@register("report_job", "SELECT o_orderpriority AS job, count(*) AS tables, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, sum(o_custkey)::BIGINT AS rows FROM orders GROUP BY 1")
def report_job(spark, d):
    """Orders stand in for the tables of jobs."""
    return table(spark, d, "orders").groupBy(col("o_orderpriority").alias("job")).agg(F.count("*").alias("tables"), F.count(F.when(col("o_orderstatus") == "F", 1)).alias("passed"), F.sum("o_custkey").alias("rows"))


@register("report_metrics", "SELECT unnest(['# TYPE events_' || event_type || ' counter', 'events_' || event_type || ' ' || n]) AS line FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def report_metrics(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value")).select(F.concat(lit("events_"), "event_type").alias("name"), lit("counter").alias("kind"), "value")
    return M.metrics_text(counted)

# --- graphs -------------------------------------------------------------------------------------

#: Rows that refer to each other: regions, nations, customers, suppliers, orders, and lines that need an order, a part and a supplier.
REFERENCES = (("nation", "'r' || n_regionkey", "'n' || n_nationkey"), ("customer", "'n' || c_nationkey", "'c' || c_custkey"), ("supplier", "'n' || s_nationkey", "'s' || s_suppkey"), ("orders", "'c' || o_custkey", "'o' || o_orderkey"))
LINES = (("lineitem", "'o' || l_orderkey", "'l' || l_orderkey || '.' || l_linenumber"), ("lineitem", "'p' || l_partkey", "'l' || l_orderkey || '.' || l_linenumber"), ("lineitem", "'s' || l_suppkey", "'l' || l_orderkey || '.' || l_linenumber"))
edges_sql = lambda of: "(SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {s} AS src, {t} AS dst FROM {n}" for n, s, t in of) + "))"
FEW_SQL, EDGES_SQL = edges_sql(REFERENCES), edges_sql((*REFERENCES, *LINES))


def references_of(spark, d, of) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, n).select(F.expr(s).alias("src"), F.expr(t).alias("dst")) for n, s, t in of])


def edges_of(spark, d, of) -> DataFrame:
    return references_of(spark, d, of).distinct()


def nodes_of(df):
    return df.select(col("src").alias("node")).union(df.select("dst")).distinct()


@register("lineage_closure", f"WITH RECURSIVE c AS (SELECT src AS ancestor, dst AS descendant FROM {FEW_SQL} UNION SELECT c.ancestor, e.dst FROM c JOIN {FEW_SQL} e ON e.src = c.descendant) SELECT * FROM c")
def lineage_closure(spark, d):
    """All that regions, nations and customers lead to: three pairs an order at most."""
    return G.closure(edges_of(spark, d, REFERENCES))


LEVELS_SQL = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES_SQL}), l AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY node"


@register("lineage_levels", LEVELS_SQL)
def lineage_levels(spark, d):
    e = references_of(spark, d, (*REFERENCES, *LINES))
    return G.levels(nodes_of(e), e)


@register("lineage_toposort", f"SELECT node, (row_number() OVER (ORDER BY level, node))::INT AS position FROM ({LEVELS_SQL})")
def lineage_toposort(spark, d):
    e = references_of(spark, d, (*REFERENCES, *LINES))
    return G.topological_order(nodes_of(e), e).select("node", "position")


#: Lines of an order follow each other; in every third order the last leads back to the first.
RING_SQL = "(SELECT DISTINCT l_orderkey * 1000 + l_linenumber AS n, l_orderkey AS o FROM lineitem)"
RINGS_SQL = f"(SELECT n AS src, lead(n) OVER (PARTITION BY o ORDER BY n) AS dst FROM {RING_SQL} UNION ALL SELECT max(n), min(n) FROM {RING_SQL} WHERE o % 3 = 0 GROUP BY o)"


def rings(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select((col("l_orderkey") * 1000 + col("l_linenumber")).alias("n"), col("l_orderkey").alias("o")).distinct()
    told = lines.groupBy("o").agg(F.array_sort(F.collect_list("n")).alias("own"))
    ahead = told.select(F.inline(F.arrays_zip(col("own").alias("src"), F.slice("own", 2, F.size("own")).alias("dst")))).where("dst IS NOT NULL")
    return ahead.unionByName(told.where("o % 3 = 0").select(F.element_at("own", -1).alias("src"), F.element_at("own", 1).alias("dst")))


@register("lineage_cycles", f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {RINGS_SQL} WHERE dst IS NOT NULL AND src <> dst), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b) SELECT x.a AS member, least(min(x.b), x.a) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a")
def lineage_cycles(spark, d):
    return G.cycles(rings(spark, d))


@register("lineage_metadata", f"SELECT count(DISTINCT n) AS nodes, (SELECT count(*) FROM {EDGES_SQL}) AS edges, (SELECT count(DISTINCT src) FROM {EDGES_SQL}) AS sources FROM (SELECT src AS n FROM {EDGES_SQL} UNION SELECT dst FROM {EDGES_SQL})")
def lineage_metadata(spark, d):
    e = edges_of(spark, d, (*REFERENCES, *LINES))
    return nodes_of(e).agg(F.count("*").alias("nodes")).join(F.broadcast(e.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))))


# --- operations ---------------------------------------------------------------------------------

JOBS_SQL = "(SELECT event_id AS job_id, user_id % 3 AS project, ts AS ended, event_id % 6 AS retries, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'RUNNING' ELSE 'CANCELLED' END AS status FROM events)"


def jobs(spark, d):
    """Events stand in for jobs."""
    status = F.when(col("event_id") % 4 == 0, "FAILED").when(col("event_id") % 4 == 1, "COMPLETED").when(col("event_id") % 4 == 2, "RUNNING").otherwise("CANCELLED")
    return table(spark, d, "events").select(col("event_id").alias("job_id"), (col("user_id") % 3).alias("project"), col("ts").alias("ended"), (col("event_id") % 6).alias("retries"), status.alias("status"))


@register("ops_alerts", f"SELECT CASE WHEN retries > 3 THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n FROM {JOBS_SQL} WHERE status = 'FAILED' AND ended >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR GROUP BY 1")
def ops_alerts(spark, d):
    last = table(spark, d, "events").agg(F.max("ts").alias("now"))
    return M.alerts(jobs(spark, d).join(F.broadcast(last)), col("now"))


@register("ops_retention", f"SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ended DESC, job_id) AS r FROM {JOBS_SQL}) WHERE status NOT IN ('RUNNING', 'FAILED') AND r > 20 AND (SELECT max(ts)::DATE FROM events) - ended::DATE >= 5")
def ops_retention(spark, d):
    last = table(spark, d, "events").agg(F.max("ts").cast("date").alias("today"))
    return M.expired(jobs(spark, d).join(F.broadcast(last)), col("today"), 5, 20).select("job_id")


@register("ops_dry_run", "SELECT 'orders' AS table_name, count(*) AS row_count, ceil(count(*) / 400.0)::BIGINT AS chunks, true AS reachable FROM orders UNION ALL SELECT 'gone', 0, 0, false")
def ops_dry_run(spark, d):
    told = table(spark, d, "orders").agg(F.count("*").alias("row_count")).select(lit("orders").alias("table_name"), "row_count")
    return M.dry_run(told.unionByName(told.select(lit("gone").alias("table_name"), lit(None).cast("long").alias("row_count"))), 400)


DDL_SQL = "SELECT '{t}' AS table_name, 'CREATE TABLE \"{t}\" (' || string_agg('\"' || column_name || '\" ' || CASE column_type WHEN 'VARCHAR' THEN 'TEXT' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' ELSE column_type END || CASE WHEN column_name = '{k}' THEN ' NOT NULL' ELSE '' END, ', ' ORDER BY n) || ', PRIMARY KEY ({k}))' AS ddl FROM (SELECT *, row_number() OVER () AS n FROM (DESCRIBE {t}))"


@register("ddl_generate", DDL_SQL.format(t="orders", k="o_orderkey") + " UNION ALL " + DDL_SQL.format(t="nation", k="n_nationkey"))
def ddl_generate(spark, d):
    rows = [(t, M.create_table(t, table(spark, d, t), k)) for t, k in (("orders", ("o_orderkey",)), ("nation", ("n_nationkey",)))]
    return spark.createDataFrame(rows, "table_name string, ddl string")

