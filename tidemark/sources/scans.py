"""Reading tables: whole, by key range, by pages of keys, after a watermark, and large values in pieces."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_full(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def scan_key_range(df: DataFrame, key: str, low: object, high: object, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows with ``low <= key <= high``, optionally filtered further; both predicates reach the scan."""
    found = df.where(F.col(key).between(low, high))
    found = found.where(where) if where is not None else found
    return found.select(*columns) if columns else found


def scan_keyset(df: DataFrame, key: str, last: object | None, rows: int) -> DataFrame:
    """The next page of ``rows`` rows by key after ``last``."""
    found = df if last is None else df.where(F.col(key) > F.lit(last))
    return found.orderBy(F.col(key).asc_nulls_first()).limit(rows)


def scan_delta(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` after the target's highest key; all of them for an empty target."""
    high = target.agg(F.max(key).alias("_high"))
    return source.join(F.broadcast(high), F.col("_high").isNull() | (F.col(key) > F.col("_high"))).drop("_high")


def scan_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"))


def in_pieces(df: DataFrame, column: str, length: int, name: str = "pieces") -> DataFrame:
    """``df`` with a long text as an array of pieces of ``length`` characters, which stay in their row: nothing is shuffled to put them together."""
    count = F.greatest(F.ceil(F.length(column) / length).cast("int"), F.lit(1))
    return df.withColumn(name, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(column), i * length + 1, F.lit(length))))


def estimated_rows(spark: SparkSession, name: str) -> tuple[int, bool]:
    """A table's rows by its catalog statistics and True; where it has none, as counted and False."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    found = re.search(r"(\d+) rows", told.get("Statistics") or "")
    return (int(found[1]), True) if found else (spark.table(name).count(), False)


def read_in_pieces(df: DataFrame, key: str, column: str, length: int) -> DataFrame:
    """(key, piece, part): a long text in pieces of ``length`` characters, numbered from 0."""
    pieces = F.greatest(F.ceil(F.length(column) / length).cast("int"), F.lit(1))
    starts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(F.col(column), i * length + 1, F.lit(length)))
    return df.where(F.col(column).isNotNull()).select(key, F.posexplode(starts).alias("piece", "part"))


def join_pieces(pieces: DataFrame, key: str, column: str) -> DataFrame:
    """Texts put together from their pieces, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("piece", "part")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias(column))


def scan_watermark(df: DataFrame, mark: str, last: object | None, rows: int, tie: str) -> DataFrame:
    """The next ``rows`` rows past a watermark; ``tie`` makes the order total, so that a page can be cut anywhere."""
    found = df if last is None else df.where(F.col(mark) > F.lit(last))
    return found.orderBy(mark, tie).limit(rows)


def table_size_mb(spark: SparkSession, path: str) -> DataFrame:
    """Size of a table's files, from their listing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg((F.sum("length") / (1 << 20)).alias("size_mb"))


def discover(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, type, nullable) of DataFrames, as catalog rows."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")
