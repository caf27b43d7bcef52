"""Load strategies over a target's current rows, as DataFrames: upsert, range reload, merge, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import floor_div


def one_per_key(rows: DataFrame, keys: Sequence[str], last_by: str | None = None) -> DataFrame:
    """``rows`` with one row a key: the last by a column where one is named, else a repeated key is an error, as it is to a database."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    if last_by is not None:
        kept = F.max_by(rest, last_by)
    else:
        kept = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*[F.first(k).alias(k) for k in keys]))))).otherwise(F.first(rest))
    return rows.groupBy(*keys).agg(kept.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str], last_by: str | None = None) -> DataFrame:
    """The target with the staged rows in place of those of the same keys; of a key that is staged repeatedly the last by ``last_by``, or an error."""
    staged = one_per_key(staged, keys, last_by)
    return target.join(staged.select(*keys), list(keys), "left_anti").unionByName(staged.select(*target.columns))


def reload_range(target: DataFrame, key: str, low: object, high: object, rows: DataFrame) -> DataFrame:
    """The target with all rows of a key range replaced: a rerun gives the same result."""
    return target.where(~F.coalesce(F.col(key).between(low, high), F.lit(False))).unionByName(rows)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str], delete_unmatched: bool = False, last_by: str | None = None) -> DataFrame:
    """MERGE: matched rows take ``update`` columns from the source, others are inserted; optionally unmatched target rows go.

    Of a key that the source has repeatedly the last by ``last_by`` counts, or it is an error.
    """
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), one_per_key(source, keys, last_by).withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    matched, new = F.col("_t") & F.col("_s"), F.col("_t").isNull()
    if delete_unmatched:
        both = both.where(F.col("_s").isNotNull())
    return both.select(*[F.when(new | (matched if c in update else F.lit(False)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns])


def merge_output(target: DataFrame, source: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(action, keys, old, new) of an upsert, as an OUTPUT clause tells them."""
    t, s = target.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_t")), source.select(*keys, F.col(value).alias("new_value"))
    return s.join(t, list(keys), "left").select(F.when(F.col("_t"), "UPDATE").otherwise("INSERT").alias("action"), *keys, "old_value", "new_value")


def quarantine(rows: DataFrame, bad: Column, key: str, chunk: int, cause: str) -> DataFrame:
    """Chunks of keys with bad rows: range, rows, cause."""
    return rows.where(bad).groupBy(floor_div(F.col(key), chunk).cast("long").alias("chunk_id")).agg(F.min(key).alias("key_start"), F.max(key).alias("key_end"), F.count("*").alias("bad_rows"), F.lit(cause).alias("cause"))


#: From how many rows or MB on a table goes by files.
OFFLOAD_ROWS, OFFLOAD_MB = 2_000_000, 256.0


def offload_plan(tables: DataFrame, least_rows: int = OFFLOAD_ROWS, least_mb: float = OFFLOAD_MB, enabled: bool = True) -> DataFrame:
    """(table_name, mode) of (table_name, rows, mb, same_server) rows: ``files`` for large tables, ``copy`` for others and within one server.

    Unknown rows and sizes count as none.
    """
    large = (F.coalesce("rows", F.lit(0)) >= least_rows) | ((F.coalesce("mb", F.lit(0.0)) > 0) & (F.coalesce("mb", F.lit(0.0)) >= least_mb))
    return tables.select("table_name", F.when(F.lit(enabled) & ~F.coalesce("same_server", F.lit(False)) & large, "files").otherwise("copy").alias("mode"))


def as_csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line a row, quoted where needed, nulls as nothing; the header is ``df.columns``."""
    return df.select(F.to_csv(F.struct(*df.columns), {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}).alias("line"))


def as_html_rows(df: DataFrame) -> DataFrame:
    """One row of an HTML table a row, values escaped."""

    def safe(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(sign), F.lit(entity))
        return text

    cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, keys in column order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
