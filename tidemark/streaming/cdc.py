"""Change data capture: decoding, ordering, deduplication, apply, checkpoints, lag and a streaming loop.

A change's identity is (table, lsn, seq, op). LSNs are fixed-width lower-case hex, so their order as text is
their order. Applying is idempotent: the target keeps each key's last position, and only later ones apply.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import files
from tidemark.sources.scratch import cut_lineage

OPERATIONS = {1: "DELETE", 2: "INSERT", 4: "UPDATE"}  # 3 is the row before an update


def lsn_hex(text: Column) -> Column:
    """``8:8:4`` hex parts, each with or without 0x, as 20 hex digits."""
    parts = F.split(F.regexp_replace(F.lower(text), "0x", ""), ":")
    return F.concat(*[F.lpad(F.get(parts, F.lit(i)), w, "0") for i, w in ((0, 8), (1, 8), (2, 4))])


def lsn_text(hexed: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(hexed, 1, 8), F.lit(":"), F.substring(hexed, 9, 8), F.lit(":"), F.substring(hexed, 17, 4))


def decode(changes: DataFrame, code: str = "operation") -> DataFrame:
    """Change-table rows as events; rows before an update go."""
    op = F.when(F.col(code) == 1, "DELETE").when(F.col(code) == 2, "INSERT").when(F.col(code) == 4, "UPDATE")
    return changes.withColumn("op", op).where(F.col("op").isNotNull()).drop(code)


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("lsn", "seq")


def deduplicate(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One event of each (table, lsn, seq, op) and of ``keys``, if rows of a load share a position; without an LSN the identity is the event's content."""
    content = F.when(F.col("lsn").isNull(), F.sha2(F.to_json(F.struct(*events.columns)), 256))
    identity = [c for c in ("table_name", "lsn", "seq", "op", *keys) if c in events.columns]
    return events.withColumn("_content", content).dropDuplicates([*identity, "_content"]).drop("_content")


def latest(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last event of each key, by a max that combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("lsn", "seq")).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def apply_changes(target: DataFrame, events: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The target after the events: upserts of the last event of each key, deletes taken out."""
    last = latest(events, keys)
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.select(*keys, *columns).unionByName(last.where("op <> 'DELETE'").select(*keys, *columns))


def apply_idempotent(target: DataFrame, events: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As ``apply_changes`` on a target that has each key's last_lsn, last_seq and a tombstone flag: events not later than these do nothing.

    An event without a position is later than a row without one. Null keys are a key like any other.
    """
    row = [*columns, "last_lsn", "last_seq", "deleted"]
    new = events.select(*keys, *columns, F.col("lsn").alias("last_lsn"), F.col("seq").alias("last_seq"), (F.col("op") == "DELETE").alias("deleted"), F.lit(1).alias("_turn"))
    old = target.select(*keys, *row, F.when(F.col("last_lsn").isNull(), 0).otherwise(2).alias("_turn"))
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*row), F.struct("last_lsn", "last_seq", "_turn")).alias("_row"))
    return last.select(*keys, "_row.*")


def checkpoints(events: DataFrame, *more: Column) -> DataFrame:
    """Last position and rows applied by table, and ``more`` aggregates of its events."""
    place = F.max(F.struct("lsn", "seq"))
    return events.groupBy("table_name").agg(place["lsn"].alias("last_lsn"), place["seq"].alias("last_seq"), F.count("*").alias("rows_applied"), *more)


def clamp_to_retention(points: DataFrame, least: DataFrame) -> DataFrame:
    """Checkpoints older than the oldest kept position restart from that."""
    both = points.join(F.broadcast(least), "table_name")
    return both.select("table_name", F.greatest("last_lsn", "min_lsn").alias("from_lsn"), (F.col("last_lsn") < F.col("min_lsn")).alias("restarted"))


def watermark_events(df: DataFrame, mark: str, last: object, deleted: Column) -> DataFrame:
    """Rows past a high-water mark as INSERT events, soft-deleted ones as DELETE."""
    return df.where(F.col(mark) > F.lit(last)).withColumn("op", F.when(deleted, "DELETE").otherwise("INSERT"))


def snapshot_events(df: DataFrame, table_name: str) -> DataFrame:
    """All rows as INSERT events at position zero."""
    return df.select("*", F.lit("INSERT").alias("op"), F.lit("0" * 20).alias("lsn"), F.lit(0).cast("long").alias("seq"), F.lit(table_name).alias("table_name"))


#: The life of a stream, as (state, event, next state). RESUME goes back to the state before PAUSE.
TRANSITIONS = (
    ("IDLE", "START", "STARTING"),
    ("STARTING", "SNAPSHOT_BEGIN", "SNAPSHOTTING"), ("STARTING", "CATCHUP_DONE", "CDC_STREAMING"), ("STARTING", "FAIL", "FAILED"), ("STARTING", "STOP", "STOPPING"),
    ("SNAPSHOTTING", "SNAPSHOT_DONE", "CDC_CATCHUP"), ("SNAPSHOTTING", "FAIL", "FAILED"), ("SNAPSHOTTING", "STOP", "STOPPING"), ("SNAPSHOTTING", "PAUSE", "PAUSED"),
    ("CDC_CATCHUP", "CATCHUP_DONE", "CDC_STREAMING"), ("CDC_CATCHUP", "FAIL", "FAILED"), ("CDC_CATCHUP", "STOP", "STOPPING"), ("CDC_CATCHUP", "PAUSE", "PAUSED"),
    ("CDC_STREAMING", "FAIL", "FAILED"), ("CDC_STREAMING", "STOP", "STOPPING"), ("CDC_STREAMING", "PAUSE", "PAUSED"), ("CDC_STREAMING", "COMPLETE", "COMPLETED"),
    ("PAUSED", "RESUME", "CDC_STREAMING"), ("PAUSED", "STOP", "STOPPING"), ("PAUSED", "FAIL", "FAILED"),
    ("STOPPING", "COMPLETE", "COMPLETED"), ("STOPPING", "FAIL", "FAILED"),
)


def run_states(events: Sequence[str], start: str = "IDLE", failed_may_catch_up: bool = False) -> list[tuple[int, str, str, str]]:
    """(step, from, event, to) of a sequence of events; one that a state doesn't know is refused."""
    table = {(a, e): b for a, e, b in TRANSITIONS} | ({("FAILED", "CATCHUP_DONE"): "CDC_CATCHUP"} if failed_may_catch_up else {})
    state, before, out = start, None, []
    for step, event in enumerate(events):
        if (state, event) not in table:
            raise ValueError(f"{event} isn't allowed in {state}")
        to = before if event == "RESUME" and before else table[state, event]
        before = state if event == "PAUSE" else before
        out.append((step, state, event, to))
        state = to
    return out


def log_versions(number: int, fold: int) -> range:
    """Versions of a change log that hold its state as of ``number``: from the last one that others were folded into."""
    return range(number - number % fold, number + 1)


def run_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], columns: Sequence[str], files_per_batch: int = 1000, fold: int = 16) -> StreamingQuery:
    """Apply a folder of change files to a versioned change log until all are read.

    Each batch writes the last event of each of its keys as a version named by the batch; every ``fold``-th version
    also takes in those since the fold before, so one batch in ``fold`` costs as much as the whole log. The log keeps
    deleted keys and all versions: for targets that are small beside their changes, or whose history is wanted.
    ``apply_files`` writes to a ``StoredTable``, whose cost goes by the keys that changed. A batch that is run again
    overwrites the same version from the same input, so a lost driver or executor changes nothing.
    """
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        events = decode(batch).select(*keys, *columns, "lsn", "seq", "op")
        if number and number % fold == 0:
            events = events.unionByName(batch.sparkSession.read.parquet(*[f"{target}/version={v}" for v in log_versions(number - 1, fold)]))
        # Repeated events are equal, so the last of each key absorbs them.
        latest(events, keys).write.mode("overwrite").parquet(f"{target}/version={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, target: str, version: int, keys: Sequence[str], columns: Sequence[str], fold: int = 16) -> DataFrame:
    """The rows of a change log as of ``version``: each key's last event by (lsn, seq), deletes taken out."""
    log = spark.read.parquet(*[f"{target}/version={v}" for v in log_versions(version, fold)])
    return latest(log, keys).where("op <> 'DELETE'").select(*keys, *columns)


def apply_files(spark: SparkSession, source: str, schema: str, target, checkpoint: str, files_per_batch: int = 1000, of: str = "changes") -> StreamingQuery:
    """Apply a folder of change files to a ``StoredTable`` until all are read.

    Files come in any order, so each key's own position decides. A batch rewrites the buckets that its keys fall in and
    commits with its number; one that runs again after a failure finds its number committed, or commits it now.
    """
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def apply(batch: DataFrame, number: int) -> None:
        events = decode(batch)
        target.apply(events if "table_name" in events.columns else events.withColumn("table_name", F.lit(of)), batch=number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(stream: DataFrame, time: str, delay: str, identity: Sequence[str] = ("table_name", "lsn", "seq", "op")) -> DataFrame:
    """One event of each identity of a stream, if repeats come within ``delay`` of event time.

    State holds the identities of the last ``delay`` only, however long the stream runs; start it within
    ``state_on_disk`` where these are more than memory holds. Events later than that are
    dropped with the repeats; ``split_late`` keeps them apart first.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([c for c in identity if c in stream.columns])


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is planned within."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB on the executors' disks, in memory of a bounded size, not in the heap."""
    store = "spark.sql.streaming.stateStore"
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.boundedMemoryUsage": "true",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.trackTotalNumberOfRows": "false",
    }
    with settings(spark, wanted):
        yield


def split_late(batch: DataFrame, time: str, mark: object) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch: late are those before the mark. Rows without a time are on time."""
    late = F.coalesce(F.col(time) < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
    return batch.where(~late), batch.where(late)


def keep_late(stream: DataFrame, time: str, delay: timedelta, to: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's batches to ``to``/on_time and ``to``/late, none lost.

    An event is late if its time is before the watermark: the greatest time of the batches before, less ``delay``.
    Each batch stores the greatest time so far beside its rows, which a batch that runs again or a restarted stream
    reads from the batch before, so a repeat writes the same.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        before = f"{to}/seen/batch={number - 1}"
        seen = spark.read.schema("seen timestamp_ntz").parquet(before).first()["seen"] if number and files.exists(spark, before) else None
        batch = batch.withColumn(time, F.col(time).cast("timestamp_ntz")).persist()
        try:
            for name, rows in zip(("on_time", "late"), split_late(batch, time, None if seen is None else seen - delay)):
                rows.write.mode("overwrite").parquet(f"{to}/{name}/batch={number}")
            batch.agg(F.greatest(F.max(time), F.lit(seen).cast("timestamp_ntz")).alias("seen")).write.mode("overwrite").parquet(f"{to}/seen/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lag(captured: DataFrame, applied: DataFrame) -> DataFrame:
    """Events captured, applied and behind, by table."""
    a = applied.groupBy("table_name").agg(F.count("*").alias("applied"))
    c = captured.groupBy("table_name").agg(F.count("*").alias("captured"), F.max("lsn").alias("max_lsn"))
    return c.join(a, "table_name", "left").select("table_name", "captured", F.coalesce("applied", F.lit(0)).alias("applied"), F.greatest(F.lit(0), F.col("captured") - F.coalesce("applied", F.lit(0))).alias("lag"), "max_lsn")


def pages(events: DataFrame, rows: int, ranges: int = 64) -> DataFrame:
    """Events with the poll (page) that brings them, by position within each table.

    Events are dealt to ranges by table and position and sorted there, so no task has a table of its own. An event's
    place is that within its range, after what its table has in the ranges before, of which there is a row a range and
    table.
    """
    order = ["table_name", "lsn", "seq"]
    dealt = events.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")))
    sizes = placed.groupBy(F.col("table_name").alias("_of"), F.col("_range").alias("_in")).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    ahead = F.sum("_size").over(Window.partitionBy("_of").orderBy("_in")) - F.col("_size") - F.col("_first")
    before = F.broadcast(sizes.select("_of", "_in", ahead.alias("_before")))
    numbered = placed.join(before, F.col("table_name").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return numbered.withColumn("page", F.call_function("div", F.col("_before") + F.col("_at"), F.lit(rows)).cast("int")).select(*events.columns, "page")
