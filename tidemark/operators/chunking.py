"""Chunk plans over key ranges, as DataFrames: each plan tiles its keys without gap or overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """(chunk_id, start, end): closed ranges of ``size`` keys from the least key on, the last cut at the greatest."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    ids = df.sparkSession.range(0 if lo is None else (hi - lo) // size + 1)
    start = F.lit(lo or 0).cast("long") + F.col("id") * size
    # Compared before the end is added up, which could pass the greatest long.
    end = F.when(start > F.lit(hi or 0) - size, F.lit(hi or 0)).otherwise(start + (size - 1))
    return ids.select(F.col("id").cast("int").alias("chunk_id"), start.alias("start"), end.cast("long").alias("end"))


def date_chunks(df: DataFrame, key: str, days: int) -> DataFrame:
    """Half-open ranges of ``days`` days, so that no time of day is lost between two of them."""
    bounds = df.agg(F.to_date(F.min(key)).alias("lo"), F.to_date(F.max(key)).alias("hi")).where("lo IS NOT NULL")
    starts = bounds.select("hi", F.posexplode(F.sequence("lo", "hi", F.make_dt_interval(F.lit(days)))).alias("chunk_id", "start"))
    return starts.select("chunk_id", F.col("start").cast("date").alias("start"), F.least(F.date_add(F.col("start").cast("date"), days), F.date_add("hi", 1)).alias("end"))


def adaptive_days(df: DataFrame, key: str, target: int) -> DataFrame:
    """Days a chunk for about ``target`` rows: target over rows a day, between 1 and 365."""
    seen = df.agg(F.count("*").alias("rows"), F.min(F.to_date(key)).alias("lo"), F.max(F.to_date(key)).alias("hi"))
    per_day = F.col("rows") / F.greatest(F.date_diff("hi", "lo") + 1, F.lit(1))
    return seen.select("rows", F.least(F.greatest(F.floor(F.lit(target) / per_day), F.lit(1)), F.lit(365)).cast("int").alias("step_days"))


def uuid_chunks(df: DataFrame, key: str) -> DataFrame:
    """Sixteen bands by the first hex digit, cut to the least and greatest value, and bands ``other`` and ``null``; empty bands go."""
    x = F.lower(F.col(key))
    first = F.substring(x, 1, 1)
    band = F.when(x.isNull(), "null").when(first.rlike("^[0-9a-f]$"), first).otherwise("other")
    return df.groupBy(band.alias("band")).agg(F.min(x).alias("start"), F.max(x).alias("end"), F.count("*").alias("rows"))


def string_chunk(df: DataFrame, key: str) -> DataFrame:
    """One closed range of all texts."""
    return df.agg(F.lit(0).alias("chunk_id"), F.min(key).alias("start"), F.max(key).alias("end"))


def chunk_digest(schema: str, table: str, start: Column, end: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{schema}.{table}:"), start.cast("string"), F.lit(":"), end.cast("string")), 256)


def split_skewed(chunks: DataFrame, rows: Column, most: int) -> DataFrame:
    """Chunks of more than ``most`` rows in two, at the middle of their range."""
    middle = F.col("start") + F.call_function("div", F.col("end") - F.col("start"), F.lit(2))
    whole = F.array(F.struct(F.col("start"), F.col("end")))
    halves = F.array(F.struct(F.col("start"), middle.alias("end")), F.struct((middle + 1).alias("start"), F.col("end")))
    return chunks.select("chunk_id", F.inline(F.when((rows > most) & (F.col("end") > F.col("start")), halves).otherwise(whole)))


def measured(chunks: DataFrame, df: DataFrame, key: str, size: int) -> DataFrame:
    """``int_chunks`` of ``size`` keys with the rows that each has: one count a chunk, added up before the shuffle."""
    least = df.agg(F.min(key).alias("_least"))
    at = F.call_function("div", F.col(key) - F.col("_least"), F.lit(size)).cast("int")
    held = df.where(F.col(key).isNotNull()).join(F.broadcast(least)).groupBy(at.alias("chunk_id")).agg(F.count("*").alias("rows"))
    return chunks.join(held, "chunk_id", "left").select("chunk_id", "start", "end", F.coalesce("rows", F.lit(0)).alias("rows"))


def weighted_chunks(df: DataFrame, key: str, chunks: int, k: int = 1600) -> DataFrame:
    """(chunk_id, start, end): closed ranges of keys that tile the table, with about as many rows each, wherever its keys lie.

    A quantile sketch of the keys, merged from those of all tasks, tells the cuts: ``k`` bounds its size and its error,
    some 0.2 % of the rows at 1600, whatever the table's. Keys that repeat beyond a chunk's share have one of their own;
    null keys lie in none.
    """
    cuts = [i / chunks for i in range(1, chunks)]
    sketch = df.agg(F.kll_sketch_agg_bigint(F.col(key).cast("long"), k).alias("sketch"), F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi")).where("lo IS NOT NULL")
    inner = F.array(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # A cut is the last key of its chunk; the last chunk ends with the greatest key.
    ends = F.array_sort(F.array_distinct(F.concat(F.filter(inner, lambda c: c < F.col("hi")), F.array("hi"))))
    told = sketch.select("lo", ends.alias("ends"))
    one = F.transform("ends", lambda e, i: F.struct(i.cast("int").alias("chunk_id"), F.when(i == 0, F.col("lo")).otherwise(F.get("ends", i - 1) + 1).alias("start"), e.alias("end")))
    return told.select(F.inline(one))


def rows_by_chunk(chunks: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``chunks`` with the rows that each has; the plan is small and goes to the rows."""
    ends = chunks.agg(F.array_sort(F.collect_list(F.struct("end", "chunk_id"))).alias("_ends"))
    # The chunk of a key is the first whose end isn't before it.
    at = F.get(F.filter("_ends", lambda e: e["end"] >= F.col(key).cast("long")), F.lit(0))["chunk_id"]
    held = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.count("*").alias("_n")).join(F.broadcast(ends)).groupBy(at.alias("chunk_id")).agg(F.sum("_n").alias("rows"))
    return chunks.join(held, "chunk_id", "left").select("chunk_id", "start", "end", F.coalesce("rows", F.lit(0)).alias("rows"))


def next_size(size: Column, ms: Column, failed: Column, target: int = 2000, least: int = 1000, most: int = 100_000) -> Column:
    """Half after a failure, 1.5 times when fast, 0.7 times when slow; within limits."""
    grown = F.when(failed, size / 2).when(ms < 0.5 * target, size * 1.5).when(ms > 1.5 * target, size * 0.7).otherwise(size)
    return F.least(F.greatest(F.floor(grown), F.lit(least)), F.lit(most)).cast("int")


def grouped(chunks: DataFrame, workers: int) -> DataFrame:
    """Contiguous groups of ceil(n / workers) chunks."""
    n = chunks.agg(F.count("*").alias("n"))
    return chunks.join(F.broadcast(n)).select("chunk_id", F.floor(F.col("chunk_id") / F.greatest(F.ceil(F.col("n") / workers), F.lit(1))).cast("int").alias("worker"))


def id_ranges(spark: SparkSession, rows: int, size: int) -> DataFrame:
    """(start, end): half-open ranges for an estimate of rows."""
    return spark.range(max(1, -(-rows // size))).select((F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("end"))


def choose_key(df: DataFrame, keys: list[str], identity: str | None = None) -> tuple[str, str]:
    """(column, kind) to chunk by: identity, then an integer key, then a uuid-like text key, a time, any integer, else hashes."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = (T.LongType, T.IntegerType, T.ShortType)
    if identity in kinds:
        return identity, "identity"
    for wanted, kind in ((whole, "integer"), (T.StringType, "uuid")):
        for k in keys:
            if isinstance(kinds[k], wanted):
                return k, kind
    for wanted, kind in (((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime"), (whole, "integer")):
        for name, t in kinds.items():
            if isinstance(t, wanted):
                return name, kind
    return ",".join(keys or list(kinds)), "synthetic"
