"""Queries of the relational surface: predicates, joins, aggregates, windows, ordering, sets, pivots, DML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import loads, relational
from tidemark.plans.registry import register
from tidemark.sources.scans import table

col, lit = F.col, F.lit


def money(c: str = "o_totalprice"):
    return F.round(F.sum(col(c).cast("decimal(18,2)")), 2).cast("double")


def day(c: str, fmt: str = "yyyy-MM-dd"):
    return F.date_format(c, fmt)


# --- predicates and subqueries ------------------------------------------------------------------


@register("filter_compare_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%-%' AND o_custkey IS NOT NULL AND o_orderkey <> 7")
def filter_compare_between(spark, d):
    o = table(spark, d, "orders")
    return o.where(col("o_totalprice").between(1000, 200000) & col("o_orderstatus").isin("O", "F") & col("o_orderpriority").like("%-%") & col("o_custkey").isNotNull() & (col("o_orderkey") != 7)).select("o_orderkey", "o_totalprice")


@register("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 100000) OR (o_orderstatus = 'F' AND NOT (o_totalprice > 50000 OR o_custkey < 10))")
def filter_and_or(spark, d):
    o = table(spark, d, "orders")
    return o.where(((col("o_orderstatus") == "O") & (col("o_totalprice") > 100000)) | ((col("o_orderstatus") == "F") & ~((col("o_totalprice") > 50000) | (col("o_custkey") < 10)))).select("o_orderkey")


@register("filter_in_subquery", """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS in_any, c_acctbal > (SELECT min(s_acctbal) FROM supplier) AS over_some
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def filter_in_subquery(spark, d):
    """IN and = ANY as a semi join, > SOME as > MIN, NOT IN as an anti join that minds nulls."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    least = table(spark, d, "supplier").agg(F.min("s_acctbal").alias("least"))
    done = o.where("o_orderstatus = 'F'").select(col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", lit(True))
    kept = relational.not_in(c, "c_custkey", o.where("o_orderstatus = 'P'").select("o_custkey"))
    return kept.join(done, "c_custkey", "left").join(F.broadcast(least)).select("c_custkey", F.coalesce("hit", lit(False)).alias("in_any"), (col("c_acctbal") > col("least")).alias("over_some"))


NOT_IN = "SELECT {0} AS case_no, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) WHERE k NOT IN (SELECT CASE WHEN o_custkey % 4 = 0 THEN {1} ELSE o_custkey END FROM orders WHERE {2})"


@register("filter_not_in_nulls", " UNION ALL ".join(NOT_IN.format(*x) for x in ((0, "NULL", "o_custkey % 2 = 0"), (1, "o_custkey", "o_custkey % 2 = 0"), (2, "o_custkey", "false"))))
def filter_not_in_nulls(spark, d):
    """NOT IN over values with a null, without one, and over none, for keys of which some are null."""
    k = table(spark, d, "customer").select(F.when(col("c_custkey") % 10 != 0, col("c_custkey")).alias("k"))
    o = table(spark, d, "orders").where("o_custkey % 2 = 0").select("o_custkey")
    cases = (o.select(F.when(col("o_custkey") % 4 != 0, col("o_custkey")).alias("v")), o, o.where("false"))
    counts = [relational.not_in(k, "k", v).agg(lit(i).alias("case_no"), F.count("*").alias("n")) for i, v in enumerate(cases)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("filter_exists", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) THEN 1 ELSE 0 END AS has_large
FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def filter_exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = col("c_custkey") == col("o_custkey")
    large = o.where("o_totalprice > 250000").select(col("o_custkey").alias("k")).distinct()
    kept = c.join(o, on, "left_semi").join(o.where("o_orderstatus = 'P'"), on, "left_anti")
    return kept.join(large, col("c_custkey") == col("k"), "left").select("c_custkey", F.when(col("k").isNotNull(), 1).otherwise(0).alias("has_large"))


@register("scalar_subquery", """SELECT o_orderkey, (SELECT max(o_totalprice) FROM orders) AS most, (SELECT min(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AS own_least, o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) + 0.001 AS over_own FROM orders o""")
def scalar_subquery(spark, d):
    """Uncorrelated: one row, broadcast. Correlated: an aggregate by the outer key, joined."""
    o = table(spark, d, "orders")
    whole, own = o.agg(F.max("o_totalprice").alias("most")), o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("own_least"), F.avg("o_totalprice").alias("own_mean"))
    return o.join(own, "o_custkey").join(F.broadcast(whole)).select("o_orderkey", "most", "own_least", (col("o_totalprice") > col("own_mean") + 0.001).alias("over_own"))


@register("derived_table", "SELECT s.o_orderstatus, max(s.n) AS most FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) s GROUP BY s.o_orderstatus")
def derived_table(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n")).groupBy("o_orderstatus").agg(F.max("n").alias("most"))


# --- projections ------------------------------------------------------------------------------


@register("project_rename", "SELECT o_orderkey AS id, o_custkey AS customer FROM orders")
def project_rename(spark, d):
    """Names by a map of tables, then of schemas, then as they are; keys in any case."""
    name = relational.target_name("dbo", "Orders", {"dbo.orders": "sales.orders_new"}, {"dbo": "public"})
    table(spark, d, "orders").select("o_orderkey", "o_custkey").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "customer"}).createOrReplaceTempView(name.replace(".", "_"))
    return spark.table("sales_orders_new")


@register("project_computed", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_returnflag || '-' || l_linestatus AS code FROM lineitem")
def project_computed(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (col("l_quantity") * 2).alias("twice"), F.concat("l_returnflag", lit("-"), "l_linestatus").alias("code"))


@register("project_override_cast", "SELECT event_id, value::DECIMAL(18,2)::VARCHAR AS value, json_extract_string(props, '$.k')::INT AS k FROM events")
def project_override_cast(spark, d):
    """Casts by column, as overrides of a type map."""
    k = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    overrides = {"value": "decimal(18,2)", "k": "int"}
    return k.select("event_id", *[col(c).cast(kind).alias(c) for c, kind in overrides.items()]).withColumn("value", col("value").cast("string"))


@register("project_quoted_alias", "SELECT o_orderkey AS \"order no\", o_totalprice AS \"Total (all)\" FROM orders")
def project_quoted_alias(spark, d):
    return table(spark, d, "orders").select(col("o_orderkey").alias("order no"), col("o_totalprice").alias("Total (all)"))


# --- joins --------------------------------------------------------------------------------------

JOIN_COLUMNS = "c_custkey, o_orderkey"


def join_query(how: str, hint: str | None = None):
    """customer and orders: customers with a positive balance, orders over 100000, so each side has rows of its own."""

    def run(spark, d) -> DataFrame:
        c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
        o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey", "o_orderkey")
        o = o.hint(hint) if hint else o
        out = c.join(o, col("c_custkey") == col("o_custkey"), how)
        return out.select("c_custkey") if how in ("left_semi", "left_anti") else out.select("c_custkey", "o_orderkey")

    return run


_SIDES = "(SELECT c_custkey FROM customer WHERE c_acctbal > 0) c {} (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey"
for _name, _how, _hint, _sql in (
    ("inner", "inner", None, "JOIN"), ("left", "left", None, "LEFT JOIN"), ("right", "right", None, "RIGHT JOIN"), ("full", "full", None, "FULL JOIN"), ("semi", "left_semi", None, "SEMI JOIN"), ("anti", "left_anti", None, "ANTI JOIN"),
    ("hint_hash", "inner", "shuffle_hash", "JOIN"), ("hint_merge", "inner", "merge", "JOIN"),
):
    register(f"join_{_name}", f"SELECT {'c_custkey' if _name in ('semi', 'anti') else JOIN_COLUMNS} FROM {_SIDES.format(_sql)}")(join_query(_how, _hint))


@register("join_hint_loop", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_hint_loop(spark, d):
    """The loop hint goes to the side of 25 nations at any scale."""
    return table(spark, d, "supplier").join(table(spark, d, "nation").hint("broadcast"), col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "n_name")


@register("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    """Two tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@register("join_cross_apply", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
def join_cross_apply(spark, d):
    """TOP 1 for each outer row: the best order of each customer first, then one join."""
    best = relational.top_per_group(table(spark, d, "orders"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")])
    return table(spark, d, "customer").join(best, col("c_custkey") == col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@register("join_outer_apply", "SELECT c_custkey, t.n, t.total FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS total FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' HAVING count(*) > 0) t ON true")
def join_outer_apply(spark, d):
    sums = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), money().alias("total"))
    return table(spark, d, "customer").join(sums, col("c_custkey") == col("o_custkey"), "left").select("c_custkey", "n", "total")


COPY_SQL = "SELECT CASE WHEN copied THEN -(o_orderkey + 1) ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN NOT copied AND o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders, (VALUES (false), (true)) v(copied) WHERE CASE WHEN copied THEN o_orderkey % 83 = 0 ELSE o_orderkey % 97 <> 0 END"


def faulty_copy(spark, d) -> DataFrame:
    """Orders with planted faults: some rows missing, some values changed, some rows more."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    kept = o.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(col("o_orderkey") % 89 == 0, col("o_totalprice") + 1).otherwise(col("o_totalprice")))
    return kept.unionByName(o.where("o_orderkey % 83 = 0").withColumn("o_orderkey", -(col("o_orderkey") + 1)))


@register("join_recon_full", f"""WITH t AS ({COPY_SQL}) SELECT state, count(*) AS n FROM (SELECT CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' WHEN s.o_orderkey IS NULL THEN 'missing_in_source'
WHEN s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.o_custkey IS NOT DISTINCT FROM t.o_custkey THEN 'match' ELSE 'changed' END AS state FROM orders s FULL JOIN t USING (o_orderkey)) GROUP BY state""")
def join_recon_full(spark, d):
    return relational.keyed_difference(table(spark, d, "orders"), faulty_copy(spark, d), ["o_orderkey"], ["o_custkey", "o_totalprice"]).groupBy("state").agg(F.count("*").alias("n"))


# --- aggregates ---------------------------------------------------------------------------------


@register("agg_basic", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus")
def agg_basic(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), money().alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@register("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@register("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, d):
    sets = [[col("o_orderstatus")], [col("o_orderpriority")], []]
    return table(spark, d, "orders").groupingSets(sets, col("o_orderstatus"), col("o_orderpriority")).agg(F.count("*").alias("n"))


@register("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("agg_grouping_fn", "SELECT o_orderstatus, grouping(o_orderstatus)::INT AS is_total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def agg_grouping_fn(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus").agg(F.grouping("o_orderstatus").cast("int").alias("is_total"), F.count("*").alias("n"))


@register("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, (SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FROM customer) AS segments FROM nation GROUP BY n_regionkey")
def agg_string_agg(spark, d):
    segments = table(spark, d, "customer").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"))
    names = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))
    return names.join(F.broadcast(segments))


@register("agg_for_xml_concat", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_for_xml_concat(spark, d):
    """STUFF over FOR XML PATH: a comma before each name, the first one cut off."""
    led = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(lit(","), x)), "")
    return table(spark, d, "region").join(F.broadcast(table(spark, d, "nation")), col("n_regionkey") == col("r_regionkey")).groupBy("r_name").agg(F.substring(led, 2, 1 << 30).alias("nations"))


@register("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct(F.to_date("l_shipdate")).alias("days"))


@register("agg_filtered", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, coalesce(sum(o_custkey) FILTER (WHERE o_orderstatus = 'X'), 0)::BIGINT AS other FROM orders")
def agg_filtered(spark, d):
    s = col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count(F.when(s == "F", 1)).alias("done"), F.count(F.when(s == "O", 1)).alias("open"), F.coalesce(F.sum(F.when(s == "X", col("o_custkey"))), lit(0)).alias("other"))


@register("agg_column_profile", " UNION ALL ".join(f"SELECT count(*) AS rows, '{c}' AS column_name, round(min({c}::DOUBLE), 6) AS min_value, round(max({c}::DOUBLE), 6) AS max_value, round(sum({c}::DOUBLE), 2) AS sum_value, round(avg({c}::DOUBLE), 6) AS avg_value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_suppkey")))
def agg_column_profile(spark, d):
    return relational.column_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_suppkey"]).withColumn("sum_value", F.round("sum_value", 2))


CHECKED = ("o_orderkey", "o_custkey", "o_orderstatus", "cents")
CHECKED_SQL = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}, '-')" for c in CHECKED)


@register("agg_checksum", f"SELECT count(*) AS rows, sum(('0x' || left(md5({CHECKED_SQL}), 15))::BIGINT)::VARCHAR AS checksum FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders)")
def agg_checksum(spark, d):
    """Amounts go in as whole cents, which every engine writes alike."""
    o = table(spark, d, "orders").withColumn("cents", F.round(col("o_totalprice") * 100).cast("long"))
    return relational.checksum(o, CHECKED).withColumn("checksum", col("checksum").cast("string"))


_STREAMED = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}, '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus"))
STREAM_HASH = f"SELECT o_orderkey // 10000 AS b, sha256(count(*) || ':' || sum(('0x' || left(md5({_STREAMED}), 15))::BIGINT)) AS x FROM orders GROUP BY 1"
for _ in range(4):
    STREAM_HASH = f"SELECT b // 10000 AS b, sha256(string_agg(b || ':' || x, chr(10) ORDER BY b::VARCHAR)) AS x FROM ({STREAM_HASH}) GROUP BY 1"


@register("agg_stream_hash", f"SELECT sha256(string_agg(x, chr(10) ORDER BY b)) AS digest FROM ({STREAM_HASH})")
def agg_stream_hash(spark, d):
    return relational.stream_hash(table(spark, d, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@register("agg_duration_stats", "WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean, v[1] AS least, v[-1] AS most, v[floor(len(v) * 0.95)::INT + 1] AS p95 FROM v")
def agg_duration_stats(spark, d):
    """p95 is the value at place floor(0.95 n) of the sorted values, by exact ranks within ranges of them."""
    e = table(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return n.join(relational.values_at(e, "event_type", "value", p95=F.floor(col("n") * 0.95)), "event_type")


@register("agg_usage_meter", "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, coalesce(sum(event_id), 0)::BIGINT AS units FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def agg_usage_meter(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("since"))
    return e.join(F.broadcast(last), col("ts") >= col("since")).groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.coalesce(F.sum("event_id"), lit(0)).alias("units"))


@register("agg_stream_kpi", "SELECT user_id % 5 AS stream, count(*) AS captured, count(*) FILTER (WHERE event_id % 10 <> 0) AS applied, greatest(0, count(*) - count(*) FILTER (WHERE event_id % 10 <> 0)) AS lag FROM events GROUP BY user_id % 5")
def agg_stream_kpi(spark, d):
    applied = F.count(F.when(col("event_id") % 10 != 0, 1))
    return table(spark, d, "events").groupBy((col("user_id") % 5).alias("stream")).agg(F.count("*").alias("captured"), applied.alias("applied"), F.greatest(lit(0), F.count("*") - applied).alias("lag"))


@register("agg_progress", "SELECT coalesce(o_orderpriority, 'all') AS part, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'O') AS done, round(100.0 * count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 2)::DOUBLE AS percent FROM orders GROUP BY ROLLUP (o_orderpriority)")
def agg_progress(spark, d):
    done = F.count(F.when(col("o_orderstatus") != "O", 1))
    return table(spark, d, "orders").rollup("o_orderpriority").agg(F.count("*").alias("total"), done.alias("done"), F.round(lit(100.0) * done / F.count("*"), 2).alias("percent")).select(F.coalesce("o_orderpriority", lit("all")).alias("part"), "total", "done", "percent")


@register("agg_percentile", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS quarter FROM orders GROUP BY o_orderstatus")
def agg_percentile(spark, d):
    """By exact ranks within ranges of the values, so that no group's values meet in one task."""
    half = (col("n") - 1) * 0.5
    found = relational.values_at(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", low=F.floor(half), high=F.ceil(half), quarter=F.ceil(col("n") * 0.25) - 1)
    return found.select("o_orderstatus", F.round((col("low") + col("high")) / 2, 4).alias("median"), "quarter")


# --- windows ------------------------------------------------------------------------------------

def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def by_date():
    return Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"))


OVER, TIED = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey", "OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE)"

for _name, _value, _sql in (
    ("row_number", lambda: F.row_number().over(by_customer()), f"row_number() {OVER})::INT"),
    ("rank", lambda: F.rank().over(by_date()), f"rank() {TIED}::INT"),
    ("dense_rank", lambda: F.dense_rank().over(by_date()), f"dense_rank() {TIED}::INT"),
    ("ntile", lambda: F.ntile(4).over(by_customer()), f"ntile(4) {OVER})::INT"),
    ("lead", lambda: F.lead("o_orderkey", 2, -1).over(by_customer()), f"lead(o_orderkey, 2, -1) {OVER})"),
    ("lag", lambda: F.lag("o_orderkey", 1, -1).over(by_customer()), f"lag(o_orderkey, 1, -1) {OVER})"),
    ("first_value", lambda: F.first_value("o_orderkey").over(by_customer()), f"first_value(o_orderkey) {OVER})"),
    ("last_value", lambda: F.last_value("o_orderkey").over(by_customer().rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)), f"last_value(o_orderkey) {OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("cume_dist", lambda: F.round(F.cume_dist().over(by_customer()), 8), f"round(cume_dist() {OVER}), 8)"),
    ("percent_rank", lambda: F.round(F.percent_rank().over(by_customer()), 8), f"round(percent_rank() {OVER}), 8)"),
    ("rows_frame", lambda: F.sum("o_orderkey").over(by_customer().rowsBetween(-1, 1)), f"(sum(o_orderkey) {OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT"),
    ("rows_unbounded", lambda: F.sum("o_orderkey").over(by_customer().rowsBetween(Window.unboundedPreceding, 0)), f"(sum(o_orderkey) {OVER} ROWS UNBOUNDED PRECEDING))::BIGINT"),
):
    register(f"win_{_name}", f"SELECT o_orderkey, {_sql} AS v FROM orders")(lambda spark, d, v=_value: table(spark, d, "orders").select("o_orderkey", v().alias("v")))


@register("win_agg_over", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, (sum(o_orderkey) OVER (PARTITION BY o_custkey))::BIGINT AS own, count(*) OVER () AS everything FROM orders")
def win_agg_over(spark, d):
    """An empty OVER () is an aggregate joined to all rows, not a window on one task."""
    o = table(spark, d, "orders")
    return o.join(F.broadcast(o.agg(F.count("*").alias("everything")))).select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), F.sum("o_orderkey").over(Window.partitionBy("o_custkey")).alias("own"), "everything")


@register("win_ntile_ranges", "SELECT bucket, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS rows FROM (SELECT o_orderkey, (ntile(8) OVER (ORDER BY o_orderkey))::INT AS bucket FROM orders) GROUP BY bucket")
def win_ntile_ranges(spark, d):
    """Equal-count ranges by exact ranks, counted within ranges of the key: no sort on one task."""
    return relational.equal_ranges(table(spark, d, "orders"), "o_orderkey", 8, unique=True)


# --- order, limits, paging, sampling ------------------------------------------------------------


@register("sort", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC NULLS LAST, o_orderkey NULLS FIRST")
def sort(spark, d):
    return relational.sort_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ("o_custkey", False), ("o_orderkey", True))


@register("limit_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(10)


@register("top_with_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 10")
def top_with_ties(spark, d):
    return relational.top_with_ties(table(spark, d, "lineitem"), 10, col("l_quantity")).select("l_orderkey", "l_linenumber", "l_quantity")


@register("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 20")
def offset_fetch(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(15)


@register("top_per_group", "SELECT o_custkey, o_orderkey, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def top_per_group(spark, d):
    return relational.top_per_group(table(spark, d, "orders"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rn")


@register("row_sample_topn", f"WITH t AS ({COPY_SQL}) SELECT 'source' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20) UNION ALL SELECT 'target', o_orderkey FROM (SELECT o_orderkey FROM t ORDER BY 1 LIMIT 20)")
def row_sample_topn(spark, d):
    first = lambda df, side: df.select(lit(side).alias("side"), "o_orderkey").orderBy("o_orderkey").limit(20)
    return first(table(spark, d, "orders"), "source").unionByName(first(faulty_copy(spark, d), "target"))


@register("sample_random", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':7') LIMIT (SELECT greatest(100, count(*) // 100) FROM orders)")
def sample_random(spark, d):
    """max(100, 1 %) keys by the order of their hashes, which a seed makes another sample."""
    o = table(spark, d, "orders").select("o_orderkey")
    total = o.count()
    return relational.hash_sample(o, "o_orderkey", max(100, total // 100), total)


@register("tablesample")
def tablesample(spark, d):
    return table(spark, d, "lineitem").sample(fraction=0.1, seed=7).select("l_orderkey", "l_linenumber")


# --- sets, common tables, pivots ----------------------------------------------------------------


@register("set_union_all", "SELECT o_orderkey, 'old' AS part FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def set_union_all(spark, d):
    o, cut = table(spark, d, "orders"), lit("1996-01-01").cast("timestamp_ntz")
    return o.where(col("o_orderdate") < cut).select("o_orderkey", lit("old").alias("part")).unionAll(o.where(col("o_orderdate") >= cut).select("o_orderkey", lit("new").alias("part")))


@register("set_union_intersect_except", "(SELECT c_nationkey AS k, 'union' AS op FROM customer UNION SELECT s_nationkey, 'union' FROM supplier) UNION ALL (SELECT c_nationkey, 'intersect' FROM customer INTERSECT SELECT s_nationkey, 'intersect' FROM supplier) UNION ALL (SELECT c_nationkey, 'except' FROM customer EXCEPT SELECT s_nationkey, 'except' FROM supplier)")
def set_union_intersect_except(spark, d):
    c, s = table(spark, d, "customer").select(col("c_nationkey").alias("k")), table(spark, d, "supplier").select(col("s_nationkey").alias("k"))
    named = lambda df, op: df.select("k", lit(op).alias("op"))
    return named(c.union(s).distinct(), "union").unionAll(named(c.intersect(s), "intersect")).unionAll(named(c.subtract(s), "except"))


@register("cte", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey, sum(n)::BIGINT AS n FROM a JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey) SELECT n_name, n FROM b JOIN nation ON n_nationkey = c_nationkey")
def cte(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = a.join(table(spark, d, "customer"), col("o_custkey") == col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return b.join(F.broadcast(table(spark, d, "nation")), col("c_nationkey") == col("n_nationkey")).select("n_name", "n")


@register("cte_recursive", "WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS child, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), t AS (SELECT child, 0 AS level, child AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.level + 1, t.path || '/' || e.child FROM e JOIN t ON e.parent = t.child) SELECT child, level, path FROM t")
def cte_recursive(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    edges = region.select(F.concat(lit("R"), "r_regionkey").alias("child"), lit(None).cast("string").alias("parent")).unionByName(nation.select(F.concat(lit("N"), "n_nationkey").alias("child"), F.concat(lit("R"), "n_regionkey").alias("parent")))
    return spark.sql("WITH RECURSIVE t AS (SELECT child, 0 AS level, child AS path FROM {e} WHERE parent IS NULL UNION ALL SELECT e.child, t.level + 1, concat(t.path, '/', e.child) FROM {e} e JOIN t ON e.parent = t.child) SELECT child, level, path FROM t", e=edges)


PIVOT_SQL = "SELECT o_orderpriority, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 0)::BIGINT AS F, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey END), 0)::BIGINT AS O, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_custkey END), 0)::BIGINT AS P FROM orders GROUP BY o_orderpriority"


@register("pivot_static", PIVOT_SQL)
def pivot_static(spark, d):
    return relational.pivot_fixed(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.sum("o_custkey"))


@register("pivot_dynamic", PIVOT_SQL)
def pivot_dynamic(spark, d):
    return relational.pivot_found(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", F.sum("o_custkey"))


@register("pivot_map", "SELECT l_returnflag, l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY ALL")
def pivot_map(spark, d):
    """A map of as many suppliers as there are, read back as rows."""
    wide = relational.pivot_map(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", F.count("*"))
    return wide.select("l_returnflag", F.explode("values").alias("supplier", "n"))


@register("unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem) UNPIVOT (amount FOR measure IN (l_quantity, l_discount))")
def unpivot(spark, d):
    return relational.unpivot_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount"], "measure", "amount")


@register("select_into", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'P'")
def select_into(spark, d):
    """The session's temporary table, read back by name."""
    table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (col("o_totalprice") * 2).alias("doubled")).createOrReplaceTempView("tidemark_into")
    return spark.table("tidemark_into")


# --- DML over DataFrames ------------------------------------------------------------------------

STAGED_SQL = "SELECT c_custkey, c_name, c_acctbal + 10 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -(c_custkey + 1), c_name, 0.0 FROM customer WHERE c_custkey % 50 = 0"


def staged_customers(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 10 = 0").withColumn("c_acctbal", col("c_acctbal") + 10).unionByName(c.where("c_custkey % 50 = 0").select((-(col("c_custkey") + 1)).alias("c_custkey"), "c_name", lit(0.0).alias("c_acctbal")))


@register("dml_merge", f"WITH s AS ({STAGED_SQL}) SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal FROM customer t FULL JOIN s ON t.c_custkey = s.c_custkey")
def dml_merge(spark, d):
    return loads.merge(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), staged_customers(spark, d), ["c_custkey"], ["c_acctbal"])


@register("dml_output", f"WITH s AS ({STAGED_SQL}) SELECT CASE WHEN t.c_custkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action, s.c_custkey, t.c_acctbal AS old_value, s.c_acctbal AS new_value FROM s LEFT JOIN customer t ON t.c_custkey = s.c_custkey")
def dml_output(spark, d):
    return loads.merge_output(table(spark, d, "customer"), staged_customers(spark, d), ["c_custkey"], "c_acctbal")


@register("dml_insert_update_delete", f"""WITH s AS ({STAGED_SQL}), i AS (SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM s WHERE c_custkey < 0),
u AS (SELECT i.c_custkey, i.c_name, coalesce(s.c_acctbal, i.c_acctbal) AS c_acctbal FROM i LEFT JOIN s ON s.c_custkey = i.c_custkey) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = u.c_custkey AND o_orderstatus = 'P')""")
def dml_insert_update_delete(spark, d):
    """INSERT SELECT, then UPDATE FROM, then DELETE with a join, each as a new version of the rows."""
    s = staged_customers(spark, d)
    inserted = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").unionByName(s.where("c_custkey < 0"))
    updated = inserted.join(s.select("c_custkey", col("c_acctbal").alias("new")), "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("new", "c_acctbal").alias("c_acctbal"))
    return updated.join(table(spark, d, "orders").where("o_orderstatus = 'P'"), col("c_custkey") == col("o_custkey"), "left_anti")


@register("udf_scalar", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def udf_scalar(spark, d):
    """A SQL function: its body is inlined into the plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_size(x DOUBLE) RETURNS STRING RETURN CASE WHEN x >= 200000 THEN 'large' WHEN x >= 50000 THEN 'middle' ELSE 'small' END")
    return table(spark, d, "orders").select("o_orderkey", F.expr("tidemark_size(o_totalprice)").alias("size"))


def sql_function(spark, d, text: str) -> None:
    """A SQL function of the session; ``{orders}`` in its body reads that table's files."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + text.replace("{orders}", f"parquet.`{d}/orders.parquet`"))


@register("udtf_inline", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def udtf_inline(spark, d):
    """A table function whose body is one query: its parameters become predicates of the scan."""
    sql_function(spark, d, "tidemark_orders_of(customer BIGINT, least DOUBLE) RETURNS TABLE(o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = customer AND o_totalprice > least")
    return spark.sql("SELECT * FROM tidemark_orders_of(7, 1000)")


@register("udtf_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal")
def udtf_lateral(spark, d):
    """The table function called once a row of ``customer``: Spark turns the calls into one join."""
    sql_function(spark, d, "tidemark_orders_of(customer BIGINT, least DOUBLE) RETURNS TABLE(o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = customer AND o_totalprice > least")
    return spark.sql("SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM {c}, LATERAL tidemark_orders_of(c_custkey, 40 * c_acctbal) o", c=table(spark, d, "customer"))


@register("udtf_multi", "SELECT o_orderkey FROM orders WHERE o_custkey = -5 UNION ALL SELECT -1 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = -5)")
def udtf_multi(spark, d):
    """A table function of several statements: rows of a customer, or a default row when there are none."""
    sql_function(spark, d, """tidemark_orders_or_none(customer BIGINT) RETURNS TABLE(o_orderkey BIGINT) RETURN WITH found AS (SELECT o_orderkey FROM {orders} WHERE o_custkey = customer)
        SELECT o_orderkey FROM found UNION ALL SELECT -1L FROM (SELECT count(*) AS n FROM found) WHERE n = 0""")
    return spark.sql("SELECT * FROM tidemark_orders_or_none(-5)")


@register("udtf_multi_lateral", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(spent, 0.0) AS spent, CASE WHEN n IS NULL THEN 'none' WHEN spent > 1000000 THEN 'large' ELSE 'some' END AS class FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def udtf_multi_lateral(spark, d):
    """A table function of an aggregate, a class of it and a default, once a row of ``customer``."""
    sql_function(spark, d, """tidemark_summary(customer BIGINT) RETURNS TABLE(n BIGINT, spent DOUBLE, class STRING) RETURN WITH own AS (SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM {orders} WHERE o_custkey = customer)
        SELECT n, spent, CASE WHEN n = 0 THEN 'none' WHEN spent > 1000000 THEN 'large' ELSE 'some' END FROM own""")
    return spark.sql("SELECT c_custkey, s.n, s.spent, s.class FROM {c}, LATERAL tidemark_summary(c_custkey) s", c=table(spark, d, "customer"))


@register("tvp", "SELECT o_orderkey, v.tag FROM orders JOIN (VALUES (1, 'a'), (2, 'b'), (3, 'c')) v(k, tag) ON o_custkey = v.k")
def tvp(spark, d):
    """A table-valued parameter: rows of the caller, broadcast as they are few."""
    given = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, tag string")
    return table(spark, d, "orders").join(F.broadcast(given), col("o_custkey") == col("k")).select("o_orderkey", "tag")


@register("proc_dynamic_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def proc_dynamic_sql(spark, d):
    """Text put together at run time; values go in as parameters."""
    return spark.sql(f"SELECT o_orderkey, o_totalprice FROM {{o}} WHERE {' AND '.join(f'{c} {op} :{p}' for c, op, p in (('o_orderstatus', '=', 'status'), ('o_totalprice', '>', 'least')))}", args={"status": "F", "least": 150000}, o=table(spark, d, "orders"))
