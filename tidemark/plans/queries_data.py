"""Queries of scans, loads, chunk plans and change data capture."""

from __future__ import annotations

import contextlib
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import chunking, loads
from tidemark.plans.queries_relational import COPY_SQL, STAGED_SQL, faulty_copy, staged_customers
from tidemark.plans.registry import register
from tidemark.sources import files, scans
from tidemark.sources.scratch import new_folder, remove_at_end
from tidemark.sources.scans import table
from tidemark.streaming import cdc
from tidemark.streaming.poll import pages_of, poll, poll_into
from tidemark.streaming.store import StoredTable, take_snapshot

col, lit = F.col, F.lit
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# --- scans --------------------------------------------------------------------------------------


@register("scan_full", "SELECT o_orderkey, o_custkey FROM orders")
def scan_full(spark, d):
    return scans.scan_full(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@register("scan_key_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderstatus = 'O'")
def scan_key_range(spark, d):
    return scans.scan_key_range(table(spark, d, "orders"), "o_orderkey", 100, 900, ["o_orderkey", "o_custkey"], col("o_orderstatus") == "O")


@register("scan_integer_range", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 50 AND 120")
def scan_integer_range(spark, d):
    return scans.scan_key_range(table(spark, d, "part"), "p_partkey", 50, 120, ["p_partkey", "p_name"])


@register("scan_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def scan_keyset(spark, d):
    return scans.scan_keyset(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 100)


@register("scan_delta", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 700)")
def scan_delta(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return scans.scan_delta(o, o.where("o_orderkey < 700"), "o_orderkey")


@register("scan_bounds", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def scan_bounds(spark, d):
    return scans.scan_bounds(table(spark, d, "orders"), "o_orderkey")


@register("scan_lob_chunks", "SELECT doc_id, text FROM documents")
def scan_lob_chunks(spark, d):
    pieces = scans.in_pieces(table(spark, d, "documents").select("doc_id", "text"), "text", 1000)
    return pieces.select("doc_id", F.array_join("pieces", "").alias("text"))


@register("scan_lob_pieces", "SELECT doc_id, (p - 1)::INT AS piece, substring(text, ((p - 1) * 1000 + 1)::INT, 1000) AS part FROM documents, unnest(range(1, greatest(1, ceil(length(text) / 1000.0)::BIGINT) + 1)) t(p)")
def scan_lob_pieces(spark, d):
    """Pieces as rows of their own, for a target that takes them one at a time."""
    return scans.read_in_pieces(table(spark, d, "documents"), "doc_id", "text", 1000)


@register("row_count_estimate", "SELECT count(*) AS n FROM lineitem")
def row_count_estimate(spark, d):
    """A count that reads no column: Parquet footers only."""
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@register("row_count_catalog", "SELECT 'analysed' AS name, count(*) AS n, true AS estimated FROM orders UNION ALL SELECT 'plain', count(*), false FROM orders")
def row_count_catalog(spark, d):
    """Rows by a table's statistics; a table without any is counted."""
    out = []
    for name in ("analysed", "plain"):
        to = own_table(spark, name)
        table(spark, d, "orders").select("o_orderkey").write.saveAsTable(to)
        if name == "analysed":
            spark.sql(f"ANALYZE TABLE {to} COMPUTE STATISTICS")
        out.append((name, *scans.estimated_rows(spark, to)))
    return spark.createDataFrame(out, "name string, n long, estimated boolean")


@register("table_size_estimate")
def table_size_estimate(spark, d):
    return scans.table_size_mb(spark, f"{d}/orders.parquet")


#: The catalog as DuckDB describes it, with types under their Spark names.
CATALOG_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (row_number() OVER () - 1)::INT AS ordinal, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS data_type, true AS nullable FROM (DESCRIBE {t})" for t in TABLES)


@register("catalog_discover", CATALOG_SQL)
def catalog_discover(spark, d):
    return scans.discover(spark, {t: table(spark, d, t) for t in TABLES})


@register("catalog_cdc_status", "SELECT * FROM (VALUES ('orders', true), ('lineitem', true), ('missing_one', false)) v(table_name, tracked)")
def catalog_cdc_status(spark, d):
    """Requested names against the tables that are there; the others are refused."""
    asked = spark.createDataFrame([("orders",), ("lineitem",), ("missing_one",)], "table_name string")
    there = scans.discover(spark, {t: table(spark, d, t) for t in TABLES}).select("table_name").distinct().withColumn("found", lit(True))
    return asked.join(there, "table_name", "left").select("table_name", F.coalesce("found", lit(False)).alias("tracked"))


@register("catalog_detail", f"SELECT table_name, count(*) AS columns, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS types FROM ({CATALOG_SQL}) GROUP BY table_name")
def catalog_detail(spark, d):
    return scans.discover(spark, {t: table(spark, d, t) for t in TABLES}).groupBy("table_name").agg(F.count("*").alias("columns"), F.array_join(F.array_sort(F.collect_set("data_type")), ",").alias("types"))


CHANGES_SQL = """SELECT o_orderkey, o_totalprice + v.add AS o_totalprice, operation, lpad(printf('%x', o_orderkey), 20, '0') AS lsn, seq::BIGINT AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS table_name
FROM orders, (VALUES (2, 1, 0.0::DOUBLE), (3, 2, 0.0::DOUBLE), (4, 3, 5.0::DOUBLE), (1, 4, 0.0::DOUBLE)) v(operation, seq, add), unnest(range(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END)) t(i)
WHERE operation = 2 OR (operation IN (3, 4) AND o_orderkey % 3 = 0) OR (operation = 1 AND o_orderkey % 7 = 0)"""


@register("scan_change_table", f"SELECT * FROM ({CHANGES_SQL}) WHERE lsn > '000000000000000001f4' ORDER BY lsn, seq")
def scan_change_table(spark, d):
    """All rows of the change table after a position, in order."""
    return cdc.in_order(changes(spark, d).where(col("lsn") > "0" * 17 + "1f4"))


@register("scan_watermark", "SELECT event_id FROM events WHERE ts > (SELECT min(ts) + INTERVAL 2 DAY FROM events) ORDER BY ts, event_id LIMIT 100")
def scan_watermark(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.min("ts") + F.expr("INTERVAL 2 DAY")).alias("last")).first()["last"]
    return scans.scan_watermark(e.select("event_id", "ts"), "ts", last, 100, "event_id").select("event_id")


@register("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(k, tag)")
def scan_values(spark, d):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, tag string")


# --- loads --------------------------------------------------------------------------------------


def own_table(spark, name: str) -> str:
    """The name of a managed table of this application, which leftovers of others can't meet."""
    own = "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId)
    spark.sql(f"DROP TABLE IF EXISTS tidemark_{name}_{own}")
    remove_at_end(spark, "table", f"tidemark_{name}_{own}")
    return f"tidemark_{name}_{own}"


def into_table(name: str, *parts: DataFrame) -> DataFrame:
    """Append parts to a new managed table of the warehouse and read it back."""
    spark = parts[0].sparkSession
    to = own_table(spark, name)
    for part in parts:
        part.write.mode("append").format("parquet").saveAsTable(to)
    return spark.table(to)


@register("sink_copy", "SELECT o_orderkey, o_custkey FROM orders")
def sink_copy(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return into_table("copy", o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 <> 0"))


@register("sink_insert_select", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 10 AND 400")
def sink_insert_select(spark, d):
    return into_table("insert_select", scans.scan_key_range(table(spark, d, "orders"), "o_orderkey", 10, 400, ["o_orderkey", "o_custkey"]))


@register("sink_file_offload", "SELECT p_partkey, p_name FROM part")
def sink_file_offload(spark, d):
    """Above a size, files are handed over; Spark writes them either way."""
    return into_table("offload", table(spark, d, "part").select("p_partkey", "p_name"))


@register("sink_offload_plan", "SELECT t AS table_name, CASE WHEN t <> 'part' AND n >= 5000 THEN 'files' ELSE 'copy' END AS mode FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) * 100 FROM part UNION ALL SELECT 'region', count(*) FROM region)")
def sink_offload_plan(spark, d):
    """Tables by their rows: large ones go by files, unless source and target are one server."""
    n = lambda t, times=1: table(spark, d, t).agg((F.count("*") * times).alias("rows")).select(lit(t).alias("table_name"), "rows", lit(0.0).alias("mb"), lit(t == "part").alias("same_server"))
    return loads.offload_plan(n("orders").unionByName(n("lineitem")).unionByName(n("part", 100)).unionByName(n("region")), 5000)


@register("sink_report_csv", "SELECT c_custkey || ',' || CASE WHEN c_custkey % 3 = 0 THEN '\"a \"\"b\"\", ' || c_custkey || '\"' ELSE c_mktsegment END || ',' AS line FROM customer")
def sink_report_csv(spark, d):
    c = table(spark, d, "customer")
    note = F.when(col("c_custkey") % 3 == 0, F.concat(lit('a "b", '), col("c_custkey").cast("string"))).otherwise(col("c_mktsegment"))
    return loads.as_csv_lines(c.select("c_custkey", note.alias("note"), lit(None).cast("string").alias("empty")))


@register("sink_report_html", "SELECT '<tr><td>' || c_custkey || '</td><td>&lt;' || replace(c_mktsegment, '&', '&amp;') || '&gt; &amp; &quot;x&quot;</td><td></td></tr>' AS line FROM customer")
def sink_report_html(spark, d):
    c = table(spark, d, "customer")
    return loads.as_html_rows(c.select("c_custkey", F.concat(lit("<"), "c_mktsegment", lit('> & "x"')).alias("note"), lit(None).cast("string").alias("empty")))


@register("copy_matrix", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def copy_matrix(spark, d):
    """One reader and one writer, whatever the formats."""
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    to = own_table(spark, "matrix")
    joined.write.format("json").saveAsTable(to)
    return spark.table(to)


@register("sink_provision", "SELECT r_regionkey, r_name FROM region")
def sink_provision(spark, d):
    """Policies for an existing table: ignore keeps it, overwrite replaces it."""
    r, to = table(spark, d, "region").select("r_regionkey", "r_name"), own_table(spark, "provision")
    r.limit(1).write.mode("overwrite").saveAsTable(to)
    r.limit(2).write.mode("ignore").saveAsTable(to)
    r.write.mode("overwrite").saveAsTable(to)
    return spark.table(to)


@register("sink_reports", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def sink_reports(spark, d):
    return loads.as_json_lines(table(spark, d, "region").select("r_regionkey", "r_name"))


@register("sink_upsert", f"WITH s AS ({STAGED_SQL}) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def sink_upsert(spark, d):
    return loads.upsert(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), staged_customers(spark, d), ["c_custkey"])


@register("sink_delete_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 200 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def sink_delete_range(spark, d):
    """A range that was loaded in part is loaded again whole."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    partly = o.where("NOT (o_orderkey BETWEEN 150 AND 200)")
    return loads.reload_range(partly, "o_orderkey", 100, 200, o.where("o_orderkey BETWEEN 100 AND 200"))


@register("sink_reload_range", "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 100 AND 900 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 900 AND o_orderkey % 9 = 0)")
def sink_reload_range(spark, d):
    """A range whose rows have changed and gone at the source: twice reloaded, as if the first load had been lost."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    now = o.where("o_orderkey BETWEEN 100 AND 900 AND o_orderkey % 9 <> 0").withColumn("o_totalprice", col("o_totalprice") + 1)
    return loads.reload_range(loads.reload_range(o, "o_orderkey", 100, 900, now), "o_orderkey", 100, 900, now)


@register("sink_quarantine", "SELECT o_orderkey // 500 AS chunk_id, min(o_orderkey) AS key_start, max(o_orderkey) AS key_end, count(*) AS bad_rows, 'cast' AS cause FROM orders WHERE o_orderkey % 61 = 0 GROUP BY 1")
def sink_quarantine(spark, d):
    o = table(spark, d, "orders").withColumn("amount", F.when(col("o_orderkey") % 61 == 0, "n/a").otherwise(col("o_totalprice").cast("string")))
    return loads.quarantine(o, col("amount").isNotNull() & col("amount").try_cast("double").isNull(), "o_orderkey", 500, "cast")


# --- chunk plans --------------------------------------------------------------------------------

INT_CHUNKS = "SELECT i::INT AS chunk_id, lo + i * 400 AS start, least(lo + i * 400 + 399, hi) AS \"end\" FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), unnest(range(0, (hi - lo) // 400 + 1)) t(i)"


@register("chunk_int", INT_CHUNKS)
def chunk_int(spark, d):
    return chunking.int_chunks(table(spark, d, "orders"), "o_orderkey", 400)


@register("chunk_date", "SELECT i::INT AS chunk_id, strftime(lo + (i * 30)::INT, '%Y-%m-%d') AS start, strftime(least(lo + (i * 30 + 30)::INT, hi + 1), '%Y-%m-%d') AS \"end\" FROM (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), unnest(range(0, (hi - lo) // 30 + 1)) t(i)")
def chunk_date(spark, d):
    c = chunking.date_chunks(table(spark, d, "orders"), "o_orderdate", 30)
    return c.select("chunk_id", col("start").cast("string").alias("start"), col("end").cast("string").alias("end"))


@register("chunk_datetime_adaptive", "SELECT n AS rows, least(greatest(floor(500 / (n / greatest(days, 1))), 1), 365)::INT AS step_days FROM (SELECT count(*) AS n, max(o_orderdate)::DATE - min(o_orderdate)::DATE + 1 AS days FROM orders)")
def chunk_datetime_adaptive(spark, d):
    return chunking.adaptive_days(table(spark, d, "orders"), "o_orderdate", 500)


@register("chunk_uuid", "SELECT left(u, 1) AS band, min(u) AS start, max(u) AS \"end\", count(*) AS rows FROM (SELECT md5(o_orderkey::VARCHAR) AS u FROM orders) GROUP BY 1")
def chunk_uuid(spark, d):
    return chunking.uuid_chunks(table(spark, d, "orders").select(F.md5(col("o_orderkey").cast("string")).alias("u")), "u")


@register("chunk_string", "SELECT 0 AS chunk_id, min(c_name) AS start, max(c_name) AS \"end\" FROM customer")
def chunk_string(spark, d):
    return chunking.string_chunk(table(spark, d, "customer"), "c_name")


@register("chunk_composite", "SELECT i::INT AS chunk_id, lo + i * 900 AS start, least(lo + i * 900 + 899, hi) AS \"end\" FROM (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem), unnest(range(0, (hi - lo) // 900 + 1)) t(i)")
def chunk_composite(spark, d):
    """By the first column of a key of several."""
    return chunking.int_chunks(table(spark, d, "lineitem"), "l_orderkey", 900)


@register("chunk_key_select", "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'integer'), ('pages', 'url', 'uuid'), ('events', 'ts', 'datetime'), ('embeddings', 'vec_id', 'integer')) v(table_name, column_name, kind)")
def chunk_key_select(spark, d):
    rows = [(t, *chunking.choose_key(table(spark, d, t), k)) for t, k in (("orders", ["o_orderkey"]), ("pages", ["url"]), ("events", []), ("embeddings", ["vec_id"]))]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")


@register("chunk_hash", f"SELECT chunk_id, sha256('dbo.orders:' || start || ':' || \"end\") AS digest FROM ({INT_CHUNKS})")
def chunk_hash(spark, d):
    return chunking.int_chunks(table(spark, d, "orders"), "o_orderkey", 400).select("chunk_id", chunking.chunk_digest("dbo", "orders", col("start"), col("end")).alias("digest"))


SKEWED_SQL = "(SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey // 50 ELSE l_orderkey END AS k FROM lineitem)"


def skewed_lines(spark, d) -> DataFrame:
    """Lines whose keys lie dense at the low end: half of them in a fiftieth of the range."""
    k = col("l_orderkey")
    return table(spark, d, "lineitem").select(F.when(k % 2 == 0, F.call_function("div", k, lit(50))).otherwise(k).alias("k"))


@register("chunk_split_skew", f"""WITH b AS (SELECT min(k) AS lo, max(k) AS hi FROM {SKEWED_SQL}), c AS (SELECT i::INT AS chunk_id, lo + i * 400 AS s, least(lo + i * 400 + 399, hi) AS e FROM b, unnest(range(0, (hi - lo) // 400 + 1)) t(i)),
n AS (SELECT chunk_id, s, e, (SELECT count(*) FROM {SKEWED_SQL} WHERE k BETWEEN s AND e) AS rows FROM c)
SELECT chunk_id, CASE h WHEN 0 THEN s ELSE s + (e - s) // 2 + 1 END AS start, CASE WHEN h = 0 AND rows > 1500 AND e > s THEN s + (e - s) // 2 ELSE e END AS "end" FROM n, (VALUES (0), (1)) v(h) WHERE h = 0 OR (rows > 1500 AND e > s)""")
def chunk_split_skew(spark, d):
    """Chunks of 400 keys with their rows as measured; those of more than 1,500 in two."""
    lines = skewed_lines(spark, d)
    chunks = chunking.measured(chunking.int_chunks(lines, "k", 400), lines, "k", 400)
    return chunking.split_skewed(chunks, col("rows"), 1500)


@register("chunk_weighted", "SELECT 24 AS chunks, count(*) AS rows, min(k) AS low, max(k) AS high, true AS tiles, true AS balanced FROM " + SKEWED_SQL)
def chunk_weighted(spark, d):
    """Ranges of about as many rows each, cut at quantiles of a sketch: that they tile the keys, and that none has over 1.25 times its share beyond one key's rows."""
    lines = skewed_lines(spark, d)
    chunks = chunking.rows_by_chunk(chunking.weighted_chunks(lines, "k", 24), lines, "k")
    most = lines.groupBy("k").count().agg(F.max("count").alias("most"))
    told = chunks.agg(F.count("*").cast("int").alias("chunks"), F.sum("rows").alias("rows"), F.min("start").alias("low"), F.max("end").alias("high"), F.sum(col("end") - col("start") + 1).alias("span"), F.max("rows").alias("largest"))
    return told.join(F.broadcast(most)).select("chunks", "rows", "low", "high", (col("span") == col("high") - col("low") + 1).alias("tiles"), (col("largest") <= 1.25 * col("rows") / 24 + col("most")).alias("balanced"))


@register("chunk_adaptive_size", """SELECT event_id, size, ms, failed, least(greatest(floor(CASE WHEN failed THEN size / 2.0 WHEN ms < 1000 THEN size * 1.5::DOUBLE WHEN ms > 3000 THEN size * 0.7::DOUBLE ELSE size END), 1000), 100000)::INT AS next_size
FROM (SELECT event_id, (1000 + event_id * 137 % 99000)::INT AS size, (event_id * 61 % 5000)::INT AS ms, event_type = 'error' AS failed FROM events)""")
def chunk_adaptive_size(spark, d):
    """Events as chunks that took a time of their own, errors as failures."""
    k = col("event_id")
    told = table(spark, d, "events").select("event_id", (1000 + k * 137 % 99_000).cast("int").alias("size"), (k * 61 % 5000).cast("int").alias("ms"), (col("event_type") == "error").alias("failed"))
    return told.withColumn("next_size", chunking.next_size(col("size"), col("ms"), col("failed")))


@register("chunk_group", f"SELECT chunk_id, (chunk_id // ceil(count(*) OVER () / 4.0)::INT)::INT AS worker FROM ({INT_CHUNKS})")
def chunk_group(spark, d):
    return chunking.grouped(chunking.int_chunks(table(spark, d, "orders"), "o_orderkey", 400), 4)


@register("chunk_id_ranges", "SELECT i * 1000 AS start, (i + 1) * 1000 AS \"end\" FROM (SELECT count(*) AS n FROM orders), unnest(range(0, greatest(1, ceil(n / 1000.0)::BIGINT))) t(i)")
def chunk_id_ranges(spark, d):
    return chunking.id_ranges(spark, table(spark, d, "orders").count(), 1000)


# --- change data capture ------------------------------------------------------------------------


def changes(spark, d) -> DataFrame:
    """A change table made of orders: an insert of each, an update (with the row before) of every third, a delete of every seventh; some twice."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ops = F.array(*[F.struct(lit(code).alias("operation"), lit(seq).cast("long").alias("seq"), lit(add).alias("add")) for code, seq, add in ((2, 1, 0.0), (3, 2, 0.0), (4, 3, 5.0), (1, 4, 0.0))])
    rows = o.select("o_orderkey", "o_totalprice", F.explode(ops).alias("op"))
    kept = rows.where((col("op.operation") == 2) | (col("op.operation").isin(3, 4) & (col("o_orderkey") % 3 == 0)) | ((col("op.operation") == 1) & (col("o_orderkey") % 7 == 0)))
    out = kept.select("o_orderkey", (col("o_totalprice") + col("op.add")).alias("o_totalprice"), col("op.operation").alias("operation"), F.lower(F.lpad(F.hex("o_orderkey"), 20, "0")).alias("lsn"), col("op.seq").alias("seq"), F.when(col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("table_name"))
    return out.unionByName(out.where("o_orderkey % 11 = 0"))


EVENTS_SQL = """e AS (SELECT DISTINCT o_orderkey, o_totalprice + v.add AS o_totalprice, op, lpad(printf('%x', o_orderkey), 20, '0') AS lsn, seq, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS table_name
FROM orders, (VALUES ('INSERT', 1, 0.0::DOUBLE), ('UPDATE', 3, 5.0::DOUBLE), ('DELETE', 4, 0.0::DOUBLE)) v(op, seq, add) WHERE op = 'INSERT' OR (op = 'UPDATE' AND o_orderkey % 3 = 0) OR (op = 'DELETE' AND o_orderkey % 7 = 0))"""


def events(spark, d) -> DataFrame:
    return cdc.deduplicate(cdc.decode(changes(spark, d)))


@register("cdc_decode", f"WITH {EVENTS_SQL} SELECT op, count(*) + count(*) FILTER (WHERE o_orderkey % 11 = 0) AS n FROM e GROUP BY op")
def cdc_decode(spark, d):
    return cdc.decode(changes(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@register("cdc_order", f"WITH {EVENTS_SQL} SELECT lsn, seq::BIGINT AS seq, op FROM e ORDER BY lsn, seq")
def cdc_order(spark, d):
    """All events of the change table in order."""
    return cdc.in_order(events(spark, d).select("lsn", "seq", "op"))


@register("cdc_order_all", f"WITH {EVENTS_SQL} SELECT lsn, seq::BIGINT AS seq, op FROM e ORDER BY lsn, seq")
def cdc_order_all(spark, d):
    """All events of the change table in order."""
    return cdc.in_order(events(spark, d).select("lsn", "seq", "op"))


@register("cdc_lsn_codec", "SELECT o_orderkey, lpad(printf('%x', o_orderkey), 8, '0') || '000000ff' || '0001' AS hexed, '0x' || lpad(printf('%x', o_orderkey), 8, '0') || ':000000ff:0001' AS again FROM orders")
def cdc_lsn_codec(spark, d):
    hexed = cdc.lsn_hex(F.concat(lit("0x"), F.hex("o_orderkey"), lit(":FF:1")))
    return table(spark, d, "orders").select("o_orderkey", hexed.alias("hexed"), cdc.lsn_text(hexed).alias("again"))


APPLIED_SQL = f"WITH {EVENTS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lsn DESC, seq DESC) AS r FROM e) SELECT o_orderkey, o_totalprice FROM l WHERE r = 1 AND op <> 'DELETE'"


@register("cdc_apply_upsert", APPLIED_SQL)
def cdc_apply_upsert(spark, d):
    empty = spark.createDataFrame([], "o_orderkey long, o_totalprice double")
    # The last event of each key absorbs repeats, so they need no shuffle of their own.
    return cdc.apply_changes(empty, cdc.decode(changes(spark, d)), ["o_orderkey"], ["o_totalprice"])


def stored(spark, name: str, buckets: int = 16) -> StoredTable:
    return StoredTable(spark, new_folder(spark, name), "o_orderkey long, o_totalprice double", ["o_orderkey"], buckets)


@register("cdc_batch_txn", APPLIED_SQL)
def cdc_batch_txn(spark, d):
    """Batches on a stored target: the first twice, the second broken off before its commit and run again."""
    e, target = events(spark, d), stored(spark, "batches")

    def broken() -> None:
        raise OSError("lost before the commit")

    target.apply(e.where("seq <= 1"), batch=0)
    target.apply(e.where("seq <= 1"), batch=0)
    with contextlib.suppress(OSError):
        target.apply(e.where("seq > 1"), batch=1, before_commit=broken)
    target.apply(e.where("seq > 1"), batch=1)
    return target.rows()


@register("sink_upsert_stored", f"WITH s AS ({STAGED_SQL}) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s")
def sink_upsert_stored(spark, d):
    """A load and an upsert into a stored table: the second rewrites the buckets of its keys alone."""
    target = StoredTable(spark, new_folder(spark, "customers"), "c_custkey long, c_name string, c_acctbal double", ["c_custkey"], 64)
    for at, rows in enumerate((table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), staged_customers(spark, d))):
        target.apply(rows.select("*", F.lpad(lit(str(at)), 20, "0").alias("lsn"), lit(0).cast("long").alias("seq"), lit("INSERT").alias("op"), lit("customer").alias("table_name")), batch=at)
    return target.rows()


def captured_in_bands(spark, d, bands: int = 6) -> tuple[str, str]:
    """Decoded changes as files in order of commit time, a band of time a file; repeats come a band later. Path and schema."""
    path = new_folder(spark, "captured")
    at = table(spark, d, "orders").select(col("o_orderkey").alias("k"), col("o_orderdate").cast("timestamp").alias("ts"))
    e = cdc.decode(changes(spark, d)).join(at, col("o_orderkey") == col("k")).drop("k")
    low, high = at.agg(F.min("ts"), F.max("ts")).first()
    share = (F.unix_micros("ts") - int(low.timestamp() * 1e6)) / max(1, int((high - low).total_seconds() * 1e6))
    band = F.least(F.floor(share * bands), lit(bands - 1)).cast("int")
    twice = e.where("o_orderkey % 11 = 0").dropDuplicates(["table_name", "lsn", "seq", "op"])
    dealt = e.dropDuplicates(["table_name", "lsn", "seq", "op"]).withColumn("band", band).unionByName(twice.withColumn("band", band + 1))
    # Made once; each band is then copied to its file in turn, as a stream takes files by their age.
    staged = new_folder(spark, "staged")
    dealt.write.partitionBy("band").parquet(staged)
    found = spark.read.schema(dealt.schema).parquet(staged)
    for i in range(bands + 1):
        found.where(col("band") == i).drop("band").coalesce(1).write.parquet(f"{path}/band={i}")
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.drop("band").schema)


@register("cdc_dedup", f"WITH {EVENTS_SQL} SELECT o_orderkey, op, seq::BIGINT AS seq FROM e")
def cdc_dedup(spark, d):
    """A stream of change files, a band of time a batch, whose repeats come in the band after: state keeps two bands' identities."""
    path, schema = captured_in_bands(spark, d)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/band=*")
    once = cdc.drop_repeats(stream, "ts", "900 days").select("o_orderkey", "op", "seq")
    to = new_folder(spark, "once")
    with cdc.state_on_disk(spark):
        query = once.writeStream.format("parquet").option("path", to).option("checkpointLocation", new_folder(spark, "points")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("o_orderkey long, op string, seq long").parquet(to)


LATE_SQL = """d AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN band + 2 ELSE band END AS batch FROM (SELECT event_id, ts, least(5, (6 * (epoch_us(ts) - lo)) // greatest(1, hi - lo)) AS band FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events))),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM d GROUP BY batch)"""


@register("late_data", f"WITH {LATE_SQL} SELECT event_id, coalesce(ts < mark, false) AS late FROM d JOIN m USING (batch)")
def late_data(spark, d):
    """Events in bands of time, a band a batch and some of them two bands late, with a delay of two days: none is lost."""
    path, to = new_folder(spark, "bands"), new_folder(spark, "late")
    e = table(spark, d, "events").select("event_id", "ts")
    bounds = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    us = lambda c: F.unix_micros(col(c).cast("timestamp"))
    band = F.least(lit(5), F.call_function("div", 6 * (us("ts") - us("lo")), F.greatest(lit(1), us("hi") - us("lo"))))
    dealt = e.join(F.broadcast(bounds)).select("event_id", "ts", (band + F.when(col("event_id") % 13 == 0, 2).otherwise(0)).alias("band"))
    for i in range(8):
        dealt.where(col("band") == i).drop("band").coalesce(1).write.parquet(f"{path}/band={i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/band=*")
    cdc.keep_late(stream, "ts", timedelta(days=2), to, new_folder(spark, "points")).awaitTermination()
    read = lambda name: spark.read.schema(e.schema).parquet(f"{to}/{name}/batch=*").select("event_id", lit(name == "late").alias("late"))
    return read("on_time").unionByName(read("late"))


@register("cdc_dedup_tables", "SELECT t AS table_name, o_orderkey FROM orders, (VALUES ('orders'), ('lines')) v(t)")
def cdc_dedup_tables(spark, d):
    """Two tables that change at the same positions, each event twice: one of each stays."""
    e = table(spark, d, "orders").select("o_orderkey", F.lower(F.lpad(F.hex("o_orderkey"), 20, "0")).alias("lsn"), lit(1).cast("long").alias("seq"), lit("INSERT").alias("op"))
    both = e.withColumn("table_name", F.explode(F.array(lit("orders"), lit("lines"), lit("orders"), lit("lines"))))
    return cdc.deduplicate(both).select("table_name", "o_orderkey")


@register("cdc_checkpoint", f"WITH {EVENTS_SQL} SELECT table_name, max(lsn) AS last_lsn, (max(lsn || seq)[21:])::BIGINT AS last_seq, count(*) AS rows_applied FROM e GROUP BY table_name")
def cdc_checkpoint(spark, d):
    """Positions stored with each of three batches, the second of which fails between its rows and its position and is read again from the stored one."""
    e, target = events(spark, d), stored(spark, "positions")
    bound = lambda share: e.agg(F.percentile_approx(F.conv("lsn", 16, 10).cast("long"), share)).first()[0]
    cuts = [f"{bound(s) or 0:020x}" for s in (0.3, 0.6)]

    def broken() -> None:
        raise OSError("lost between rows and position")

    target.apply(e.where(col("lsn") <= cuts[0]), ordered=True)
    with contextlib.suppress(OSError):
        target.apply(e.where(col("lsn") <= cuts[1]), ordered=True, before_commit=broken)
    target.apply(e.where(col("lsn") <= cuts[1]), ordered=True)
    target.apply(e, ordered=True)
    return target.positions()


@register("cdc_watermark_events", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'DELETE' ELSE 'INSERT' END AS op FROM events WHERE event_id > 300")
def cdc_watermark_events(spark, d):
    return cdc.watermark_events(table(spark, d, "events"), "event_id", 300, col("event_id") % 13 == 0).select("event_id", "op")


@register("cdc_snapshot", "SELECT c_custkey, 'INSERT' AS op, '00000000000000000000' AS lsn FROM customer")
def cdc_snapshot(spark, d):
    return cdc.snapshot_events(table(spark, d, "customer").select("c_custkey"), "customer").select("c_custkey", "op", "lsn")


@register("cdc_snapshot_log", APPLIED_SQL)
def cdc_snapshot_log(spark, d):
    """Orders loaded in four key ranges while the log runs on: each range is read when a third of its own keys has changed and another third changes around the read."""
    e, target = events(spark, d), stored(spark, "snapshot")
    low, high = table(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    step = (high - low) // 4 + 1
    chunks = [(low + i * step, low + (i + 1) * step - 1) for i in range(4)]
    hexed = lambda key: f"{key:020x}"
    # The log's clock: the position before and after each read, and that of the state which is read.
    clock = iter([(hexed(a + (b - a) * part // 3), 9) for a, b in chunks for part in (1, 2)])

    def read(a, b):
        """The range as it is halfway between the two positions."""
        past = e.where(col("o_orderkey").between(a, b) & ((col("op") == "INSERT") | (col("lsn") <= hexed(a + (b - a) // 2))))
        return cdc.latest(past, ["o_orderkey"]).where("op <> 'DELETE'").select("o_orderkey", "o_totalprice")

    def log(after, until):
        place = F.struct("lsn", "seq")
        return e.where((col("op") != "INSERT") & (place > F.struct(lit(after[0]), lit(after[1]).cast("long"))) & (place <= F.struct(lit(until[0]), lit(until[1]).cast("long"))))

    take_snapshot(target, "orders", chunks, read, lambda: next(clock), log)
    end = (hexed(chunks[-1][0] + (chunks[-1][1] - chunks[-1][0]) * 2 // 3), 9)
    target.apply(log(end, ("f" * 20, 9)))
    return target.rows()


@register("cdc_retention_clamp", f"WITH {EVENTS_SQL}, p AS (SELECT table_name, max(lsn) AS last_lsn FROM e GROUP BY table_name), m AS (SELECT * FROM (VALUES ('even', repeat('0', 20)), ('odd', repeat('f', 20))) v(table_name, min_lsn)) SELECT table_name, greatest(last_lsn, min_lsn) AS from_lsn, last_lsn < min_lsn AS restarted FROM p JOIN m USING (table_name)")
def cdc_retention_clamp(spark, d):
    least = spark.createDataFrame([("even", "0" * 20), ("odd", "f" * 20)], "table_name string, min_lsn string")
    return cdc.clamp_to_retention(cdc.checkpoints(events(spark, d)), least)


@register("cdc_lag", f"WITH {EVENTS_SQL} SELECT table_name, count(*) AS captured, count(*) FILTER (WHERE seq = 1) AS applied, count(*) - count(*) FILTER (WHERE seq = 1) AS lag, max(lsn) AS max_lsn FROM e GROUP BY table_name")
def cdc_lag(spark, d):
    e = events(spark, d)
    return cdc.stream_lag(e, e.where("seq = 1"))


@register("cdc_fsm", "SELECT * FROM (VALUES (0, 'IDLE', 'START', 'STARTING'), (1, 'STARTING', 'SNAPSHOT_BEGIN', 'SNAPSHOTTING'), (2, 'SNAPSHOTTING', 'SNAPSHOT_DONE', 'CDC_CATCHUP'), (3, 'CDC_CATCHUP', 'PAUSE', 'PAUSED'), (4, 'PAUSED', 'RESUME', 'CDC_CATCHUP'), (5, 'CDC_CATCHUP', 'CATCHUP_DONE', 'CDC_STREAMING'), (6, 'CDC_STREAMING', 'STOP', 'STOPPING'), (7, 'STOPPING', 'COMPLETE', 'COMPLETED')) v(step, from_state, event, to_state)")
def cdc_fsm(spark, d):
    return spark.createDataFrame(cdc.run_states(["START", "SNAPSHOT_BEGIN", "SNAPSHOT_DONE", "PAUSE", "RESUME", "CATCHUP_DONE", "STOP", "COMPLETE"]), "step int, from_state string, event string, to_state string")


#: Bytes of a row group of a polled log, so that the driver reads the positions of few events where a batch ends.
GROUP = 4 << 20


@register("cdc_poll_loop", f"WITH {EVENTS_SQL}, p AS (SELECT table_name, ((row_number() OVER (PARTITION BY table_name ORDER BY lsn, seq) - 1) // 500)::INT AS page FROM e) SELECT table_name, page, count(*) AS rows, count(*) < 500 AS streaming FROM p GROUP BY table_name, page")
def cdc_poll_loop(spark, d):
    """A stream source that polls 500 events by (lsn, seq), for two tables at once: a poll that isn't full ends the catch-up.

    A batch takes up to 4,000 polls that are there.
    """
    log, to = new_folder(spark, "log"), new_folder(spark, "polls")
    events(spark, d).repartitionByRange("lsn").sortWithinPartitions("table_name", "lsn", "seq").write.partitionBy("table_name").option("parquet.block.size", GROUP).parquet(log)
    names = ("even", "odd")
    running = [pages_of(spark, poll(spark, f"{log}/table_name={t}", 500, "o_orderkey long, op string, lsn string, seq long", polls=4000, splits=32), f"{to}/{t}", new_folder(spark, "points"), 500) for t in names]
    for stream in running:
        stream.processAllAvailable()
        stream.stop()
    polled = [spark.read.schema("o_orderkey long, page int").parquet(f"{to}/{t}/poll=*").withColumn("table_name", lit(t)) for t in names]
    return polled[0].unionByName(polled[1]).groupBy("table_name", "page").agg(F.count("*").alias("rows")).withColumn("streaming", col("rows") < 500)


@register("cdc_poll_pages", f"WITH {EVENTS_SQL}, p AS (SELECT table_name, ((row_number() OVER (PARTITION BY table_name ORDER BY lsn, seq) - 1) // 500)::INT AS page FROM e) SELECT table_name, page, count(*) AS rows, count(*) < 500 AS streaming FROM p GROUP BY table_name, page")
def cdc_poll_pages(spark, d):
    """The same polls of a change table that is read as a batch."""
    return cdc.pages(events(spark, d), 500).groupBy("table_name", "page").agg(F.count("*").alias("rows")).withColumn("streaming", col("rows") < 500)


@register("cdc_poll_apply", APPLIED_SQL)
def cdc_poll_apply(spark, d):
    """Polls of 5,000 events of a change table applied in order to a stored one, with their positions; up to 2,000 polls that are there at a time."""
    log, target = new_folder(spark, "log"), stored(spark, "polled")
    events(spark, d).repartitionByRange("lsn").sortWithinPartitions("lsn", "seq").write.option("parquet.block.size", GROUP).parquet(log)
    changed = poll(spark, log, 5000, "o_orderkey long, o_totalprice double, op string, lsn string, seq long, table_name string", polls=2000, splits=64)
    stream = poll_into(target, changed, new_folder(spark, "points"), 5000)
    stream.processAllAvailable()
    stream.stop()
    return target.rows()


@register("cdc_stream_apply", APPLIED_SQL)
def cdc_stream_apply(spark, d):
    """The change table as files in no order, a stream that applies them to a stored table in four batches, and its rows.

    Changes are dealt by a hash of event and part, so that repeats fall in different files, to as many files a batch as
    there are cores.
    """
    source, target = new_folder(spark, "changes"), stored(spark, "applied")
    captured, width = changes(spark, d), spark.sparkContext.defaultParallelism
    captured.repartition(4 * width, F.xxhash64("lsn", "seq", F.spark_partition_id())).write.parquet(source)
    written = sum(n.endswith(".parquet") for n in files.names(spark, source))
    cdc.apply_files(spark, source, captured.schema.simpleString()[len("struct<") : -1].replace(":", " "), target, new_folder(spark, "points"), files_per_batch=-(-written // 4)).awaitTermination()
    return target.rows()


@register("cdc_bus", f"WITH {EVENTS_SQL} SELECT o_orderkey, op, lsn FROM e")
def cdc_bus(spark, d):
    """Envelopes as JSON and back."""
    sent = events(spark, d).select(F.to_json(F.struct("o_orderkey", "op", "lsn")).alias("envelope"))
    return sent.select(F.inline(F.array(F.from_json("envelope", "o_orderkey long, op string, lsn string"))))
