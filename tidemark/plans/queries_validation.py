"""Queries that validate a copy of a table with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relational, validation
from tidemark.plans.queries_data import CATALOG_SQL, TABLES
from tidemark.plans.queries_relational import COPY_SQL, faulty_copy
from tidemark.plans.registry import register
from tidemark.sources import scans
from tidemark.sources.scans import table

col, lit = F.col, F.lit
T = f"WITH t AS ({COPY_SQL})"
LINES = "SELECT l_orderkey, l_quantity, CASE WHEN l_orderkey % 89 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS l_extendedprice FROM lineitem WHERE l_orderkey % 97 <> 0"


def faulty_lines(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return line.where("l_orderkey % 97 <> 0").withColumn("l_extendedprice", F.when(col("l_orderkey") % 89 == 0, col("l_extendedprice") + 1).otherwise(col("l_extendedprice")))


@register("val_l1_count", f"{T} SELECT s.n AS source_rows, t.n AS target_rows, CASE WHEN s.n = t.n THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT count(*) AS n FROM orders) s, (SELECT count(*) AS n FROM t) t")
def val_l1_count(spark, d):
    return validation.count_level(table(spark, d, "orders"), faulty_copy(spark, d))


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(s.a, 2) AS source_sum, round(t.a, 2) AS target_sum, CASE WHEN abs(s.a - t.a) <= greatest(1e-6 * greatest(abs(s.a), abs(t.a)), 1e-4) AND abs(s.b - t.b) <= greatest(1e-6 * greatest(abs(s.b), abs(t.b)), 1e-4) AND abs(s.lo - t.lo) <= 1e-6 AND abs(s.hi - t.hi) <= 1e-6 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT sum({c}::DOUBLE) AS a, avg({c}::DOUBLE) AS b, min({c}) AS lo, max({c}) AS hi FROM orders) s, (SELECT sum({c}::DOUBLE) AS a, avg({c}::DOUBLE) AS b, min({c}) AS lo, max({c}) AS hi FROM t) t" for c in ("o_totalprice", "o_custkey"))


@register("val_l2_aggregates", f"{T} {PROFILE}")
def val_l2_aggregates(spark, d):
    return validation.aggregate_level(table(spark, d, "orders"), faulty_copy(spark, d), ["o_totalprice", "o_custkey"])


@register("val_l3_chunk", f"""WITH t AS ({LINES}), s AS (SELECT l_orderkey // 200 AS chunk, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi, sum(l_quantity::DECIMAL(18,4)) AS q, sum(l_extendedprice::DECIMAL(18,4)) AS p FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey // 200 AS chunk, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi, sum(l_quantity::DECIMAL(18,4)) AS q, sum(l_extendedprice::DECIMAL(18,4)) AS p FROM t GROUP BY 1)
SELECT chunk, coalesce(s.n, 0) AS source_rows, coalesce(u.n, 0) AS target_rows, s.q::DOUBLE AS source_l_quantity, u.q::DOUBLE AS target_l_quantity, s.p::DOUBLE AS source_l_extendedprice, u.p::DOUBLE AS target_l_extendedprice,
CASE WHEN s.n = u.n AND s.lo = u.lo AND s.hi = u.hi AND abs(s.q - u.q)::DOUBLE <= 1e-9 * greatest(abs(s.q), abs(u.q))::DOUBLE AND abs(s.p - u.p)::DOUBLE <= 1e-9 * greatest(abs(s.p), abs(u.p))::DOUBLE THEN 'PASSED' ELSE 'FAILED' END AS status FROM s FULL JOIN u USING (chunk)""")
def val_l3_chunk(spark, d):
    return validation.range_level(table(spark, d, "lineitem"), faulty_lines(spark, d), "l_orderkey", 200, ["l_quantity", "l_extendedprice"])


@register("val_l4_sample", f"{T} SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_custkey = t.o_custkey AND abs(s.o_totalprice - t.o_totalprice) <= 1e-9 * s.o_totalprice THEN 'match' ELSE 'mismatch' END AS state FROM orders s LEFT JOIN t USING (o_orderkey) WHERE s.o_orderkey % 5 = 0")
def val_l4_sample(spark, d):
    return validation.sample_level(table(spark, d, "orders"), faulty_copy(spark, d), "o_orderkey", 5, ["o_custkey", "o_totalprice"], ["o_totalprice"])


@register("val_row_hash", f"{T}, s AS (SELECT o_orderkey AS k, md5(concat_ws('|', o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2))) AS h FROM orders), u AS (SELECT o_orderkey AS k, md5(concat_ws('|', o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2))) AS h FROM t) SELECT CASE WHEN u.h IS NULL THEN 'missing_in_target' WHEN s.h IS NULL THEN 'missing_in_source' WHEN s.h = u.h THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n FROM s FULL JOIN u USING (k) GROUP BY 1")
def val_row_hash(spark, d):
    return validation.hash_level(table(spark, d, "orders"), faulty_copy(spark, d), "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"], {"o_totalprice": "decimal(18,2)"})


@register("val_sample_cells", f"{T} SELECT s.o_orderkey, 'o_totalprice' AS column_name, s.o_totalprice::DECIMAL(18,2)::VARCHAR AS source_value, t.o_totalprice::DECIMAL(18,2)::VARCHAR AS target_value FROM orders s JOIN t USING (o_orderkey) WHERE s.o_totalprice <> t.o_totalprice")
def val_sample_cells(spark, d):
    fixed = lambda df: df.withColumn("o_totalprice", col("o_totalprice").cast("decimal(18,2)"))
    return validation.cell_differences(fixed(table(spark, d, "orders")), fixed(faulty_copy(spark, d)), "o_orderkey", ["o_custkey", "o_totalprice"])


def by_status(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@register("val_query_result", f"{T}, s AS (SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1), u AS (SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM t GROUP BY 1) SELECT o_orderstatus, s.n AS source_n, u.n AS target_n, coalesce(s.n = u.n AND s.keys = u.keys, false) AS same FROM s FULL JOIN u USING (o_orderstatus)")
def val_query_result(spark, d):
    """Two queries' results compared row by row, those of one side included."""
    found = validation.result_issues(by_status(table(spark, d, "orders")), by_status(faulty_copy(spark, d)), ["o_orderstatus"], ["n", "keys"])
    return found.select("o_orderstatus", col("source.n").alias("source_n"), col("target.n").alias("target_n"), (col("state") == "match").alias("same"))


@register("val_query_issues", f"""{T}, s AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL), u AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM t WHERE o_custkey % 3 < 2 GROUP BY ALL)
SELECT o_custkey, o_orderstatus, CASE WHEN u.n IS NULL THEN 'missing_in_target' WHEN s.n IS NULL THEN 'missing_in_source' ELSE 'mismatch' END AS state FROM s FULL JOIN u USING (o_custkey, o_orderstatus) WHERE s.n IS DISTINCT FROM u.n""")
def val_query_issues(spark, d):
    """Issues between two results of which each lacks groups of the other."""
    of = lambda df, keep: df.where(keep).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    found = validation.result_issues(of(table(spark, d, "orders"), "o_custkey % 3 > 0"), of(faulty_copy(spark, d), "o_custkey % 3 < 2"), ["o_custkey", "o_orderstatus"], ["n"])
    return found.where("state <> 'match'").select("o_custkey", "o_orderstatus", "state")


@register("val_l4_keys", f"""{T}, s AS (SELECT *, left(md5(length(o_custkey::VARCHAR) || ':' || o_custkey || '|' || length(o_orderkey::VARCHAR) || ':' || o_orderkey), 6) AS h FROM orders), u AS (SELECT *, left(md5(length(o_custkey::VARCHAR) || ':' || o_custkey || '|' || length(o_orderkey::VARCHAR) || ':' || o_orderkey), 6) AS h FROM t)
SELECT coalesce(s.o_custkey, u.o_custkey) AS o_custkey, coalesce(s.o_orderkey, u.o_orderkey) AS o_orderkey, CASE WHEN u.h IS NULL THEN 'missing_in_target' WHEN s.h IS NULL THEN 'missing_in_source' WHEN abs(s.o_totalprice - u.o_totalprice) > 1e-9 * greatest(abs(s.o_totalprice), abs(u.o_totalprice)) THEN 'mismatch' ELSE 'match' END AS state,
CASE WHEN abs(s.o_totalprice - u.o_totalprice) > 1e-9 * greatest(abs(s.o_totalprice), abs(u.o_totalprice)) THEN 'o_totalprice' ELSE '' END AS columns FROM (SELECT * FROM s WHERE h < '333333') s FULL JOIN (SELECT * FROM u WHERE h < '333333') u ON s.o_custkey = u.o_custkey AND s.o_orderkey = u.o_orderkey""")
def val_l4_keys(spark, d):
    """A fifth of composite keys, by a hash of them, with the columns that differ and rows of either side."""
    return validation.key_sample(table(spark, d, "orders"), faulty_copy(spark, d), ["o_custkey", "o_orderkey"], 0.2, ["o_orderstatus", "o_totalprice"], ["o_totalprice"])


@register("val_row_hash_nulls", """SELECT CASE WHEN c_custkey % 4 < 3 THEN 'mismatch' ELSE 'match' END AS state, count(*) AS n FROM customer GROUP BY 1""")
def val_row_hash_nulls(spark, d):
    """Customers under keys that are null in part: null against empty, moved separators and moved lengths don't match; equal rows do."""
    k, seg = col("c_custkey"), col("c_mktsegment")
    side = lambda a, b: table(spark, d, "customer").select(F.when(k % 5 != 0, k).alias("k"), k.alias("g"), a.alias("a"), b.alias("b"))
    none = lit(None).cast("string")
    s = side(F.when(k % 4 == 0, none).when(k % 4 == 1, F.concat(seg, lit("|x"))).when(k % 4 == 2, F.concat(lit("1:"), seg)), F.when(k % 4 == 1, "c").when(k % 4 == 3, seg))
    t = side(F.when(k % 4 == 0, "").when(k % 4 == 1, seg).when(k % 4 == 2, "1"), F.when(k % 4 == 1, "x|c").when(k % 4 == 2, F.concat(lit(":"), seg)).when(k % 4 == 3, seg))
    return validation.hash_level(s, t, ["k", "g"], ["a", "b"])


@register("val_query_equiv", f"{T}, a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM t GROUP BY ALL) SELECT o_custkey, o_orderstatus, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b USING (o_custkey, o_orderstatus) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def val_query_equiv(spark, d):
    columns = ["o_custkey", "o_orderstatus"]
    return validation.result_difference(table(spark, d, "orders").select(columns), faulty_copy(spark, d).select(columns))


@register("val_stream_compare", f"{T} SELECT min(k) AS first_difference, count(*) AS differences FROM (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS k FROM orders s FULL JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_totalprice <> t.o_totalprice OR s.o_custkey <> t.o_custkey)")
def val_stream_compare(spark, d):
    """By digests of key ranges: only rows of ranges that differ are joined."""
    found = validation.compare_by_digests(table(spark, d, "orders"), faulty_copy(spark, d), ["o_orderkey"], ["o_custkey", "o_totalprice"], 500)
    return found.select(col("first_o_orderkey").alias("first_difference"), col("differences").alias("differences"))


_DIGEST = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}, '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "cents"))
_LEAVES = "(SELECT floor(o_orderkey / 5000.0)::BIGINT AS node, sha256(count(*) || ':' || sum(('0x' || left(md5(" + _DIGEST + "), 15))::BIGINT)) AS digest, count(*) AS rows FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM {}) GROUP BY 1)"
_ROOT = "(SELECT sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest, sum(rows)::BIGINT AS rows FROM {})"
NEAR_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey IN (17, 4999) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey <> 23)"


@register("val_stream_digest", f"""WITH a AS (SELECT * FROM {_LEAVES.format("orders")}), b AS (SELECT * FROM {_LEAVES.format(NEAR_SQL)}), x AS (SELECT * FROM {_ROOT.format("a")}), y AS (SELECT * FROM {_ROOT.format("b")}),
n AS (SELECT coalesce(a.node, b.node) AS node, coalesce(a.rows, 0) + coalesce(b.rows, 0) AS rows FROM a FULL JOIN b ON a.node = b.node WHERE a.digest IS DISTINCT FROM b.digest),
k AS (SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' ELSE 'changed' END AS state FROM orders s LEFT JOIN {NEAR_SQL} t USING (o_orderkey) WHERE t.o_orderkey IS NULL OR s.o_totalprice <> t.o_totalprice)
SELECT CASE WHEN x.digest = y.digest THEN 'PASSED' ELSE 'FAILED' END AS status, x.digest AS source_digest, x.rows AS source_rows, y.digest AS target_digest, y.rows AS target_rows, (SELECT count(*) FROM n) AS differing_ranges, (SELECT sum(rows)::BIGINT FROM n) AS rows_compared,
(SELECT count(*) FROM k) AS differences, (SELECT min(o_orderkey) FROM k) AS first_o_orderkey, (SELECT arg_min(state, o_orderkey) FROM k) AS first_state, 'cents' AS first_columns FROM x, y""")
def val_stream_digest(spark, d):
    """Orders against a copy with three faults: both digests, the ranges that differ, and the first difference."""
    cents = lambda df: df.withColumn("cents", F.round(col("o_totalprice") * 100).cast("long"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    near = o.where("o_orderkey <> 23").withColumn("o_totalprice", F.when(col("o_orderkey").isin(17, 4999), col("o_totalprice") + 1).otherwise(col("o_totalprice")))
    return validation.compare_by_digests(cents(o), cents(near), ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"], 5000)


EQUIVALENT = [("bigint", "int8"), ("int", "int4"), ("string", "text"), ("double", "float8"), ("timestamp_ntz", "timestamp")]
#: The target's types by another system's names, but for every eleventh column, without every thirteenth, and with a column more.
TARGET_TYPES = f"SELECT name, CASE WHEN length(name) % 11 = 0 THEN 'other' ELSE CASE type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EQUIVALENT)} ELSE type END END AS type FROM (SELECT upper(table_name || '.' || column_name) AS name, data_type AS type FROM ({CATALOG_SQL})) WHERE length(name) % 13 <> 0 UNION ALL SELECT 'LOADS.ID', 'int8'"


@register("val_schema", f"""SELECT coalesce(s.name, lower(t.name)) AS name, CASE WHEN t.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'extra' WHEN NOT (s.type = t.type OR {' OR '.join(f"(s.type = '{a}' AND t.type = '{b}')" for a, b in EQUIVALENT)}) THEN 'type_mismatch' ELSE 'ok' END AS issue FROM (SELECT table_name || '.' || column_name AS name, data_type AS type FROM ({CATALOG_SQL})) s FULL JOIN ({TARGET_TYPES}) t ON lower(t.name) = s.name""")
def val_schema(spark, d):
    source = scans.discover(spark, {t: table(spark, d, t) for t in TABLES}).select(F.concat("table_name", lit("."), "column_name").alias("name"), col("data_type").alias("type"))
    theirs = F.coalesce(*[F.when(col("type") == a, b) for a, b in EQUIVALENT], col("type"))
    target = source.where(F.length("name") % 13 != 0).select(F.upper("name").alias("name"), F.when(F.length("name") % 11 == 0, "other").otherwise(theirs).alias("type"))
    return validation.schema_level(source, target.unionByName(spark.createDataFrame([("LOADS.ID", "int8")], target.schema)), EQUIVALENT)


@register("val_fk", f"{T} SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM t) GROUP BY l_orderkey")
def val_fk(spark, d):
    """Lines whose order the copy has lost."""
    return validation.orphans(table(spark, d, "lineitem"), "l_orderkey", faulty_copy(spark, d), "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("val_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def val_unique(spark, d):
    return validation.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("val_check", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0)")
def val_check(spark, d):
    return validation.check_violations(table(spark, d, "customer"), col("c_acctbal") >= 0).select("c_custkey")


@register("val_type_cast", "SELECT event_id FROM events WHERE event_id % 17 = 0")
def val_type_cast(spark, d):
    """Texts that are no numbers, planted at every seventeenth row."""
    e = table(spark, d, "events").withColumn("amount", F.when(col("event_id") % 17 == 0, "n/a").otherwise(col("event_id").cast("string")))
    return validation.cast_failures(e, "amount", "bigint").select("event_id")


@register("val_identity", "SELECT max(o_orderkey) + 1 AS next_value FROM orders")
def val_identity(spark, d):
    return table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("next_value"))


