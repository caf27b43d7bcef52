"""A stored target of change data: rows in key buckets, under a manifest that is swapped at once.

The manifest names the folder of each bucket, the position up to which each source table was applied with the
number of rows applied so far, and the last batch. A batch writes new folders for the buckets that its keys fall
in, then a new manifest; until that is there, readers and later runs see the version before, so a batch counts
whole or not at all, and its position moves with it. Cost goes by the touched buckets. Folders that neither the
manifest nor the one before names are removed after each commit; the version before stays, for readers that have
begun with it.

Events at or before a table's stored position are left out if the source delivers in order. If it doesn't, each
key's own last position decides, and deleted keys leave a tombstone until ``horizon``, before which the source
promises to deliver nothing more, has passed it.

One writer at a time: a second one that commits the same version fails. Null keys are a key like any other.
Repeated events of a batch count once. An empty batch only records its number and positions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files
from tidemark.streaming import cdc


class StoredTable:
    """Rows by key below ``path``. ``schema`` holds keys and columns; ``buckets`` is set when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in self.schema if f.name not in self.keys]
        self.buckets = self.manifest().get("buckets", buckets)

    # ---- what is stored

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in files.names(self.spark, f"{self.path}/manifests") if n[0] == "v")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the last; an empty table's before the first."""
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": 0, "folders": {}, "positions": {}, "batch": None}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/v{found[-1]:012d}"))

    def _stored(self, folders: dict[str, str], only: Sequence[str] | None = None) -> DataFrame:
        """Stored rows with their positions and tombstones, of some buckets or all."""
        kind = StructType([*self.schema.fields, *StructType.fromDDL("last_lsn string, last_seq long, deleted boolean").fields])
        paths = [f"{self.path}/data/{f}" for b, f in sorted(folders.items()) if only is None or b in only]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of the one before it."""
        return self._stored(self.manifest(version)["folders"]).where("NOT deleted").select(*[f.name for f in self.schema])

    def positions(self) -> DataFrame:
        """(table_name, last_lsn, last_seq, rows_applied) of each source table that was applied."""
        rows = [(t, *p) for t, p in sorted(self.manifest()["positions"].items())]
        return self.spark.createDataFrame(rows, "table_name string, last_lsn string, last_seq long, rows_applied long")

    # ---- applying

    def apply(self, events: DataFrame, batch: int | None = None, ordered: bool = False, horizon: str | None = None, done: dict[str, tuple[str, int]] | None = None, before_commit: Callable[[], None] | None = None) -> bool:
        """Apply decoded events (keys, columns, lsn, seq, op, table_name) as one version; False if ``batch`` was applied before.

        ``done`` adds positions that no event tells, such as that of a finished part of a snapshot.
        ``before_commit`` runs when all rows are written and the manifest isn't.
        """
        old = self.manifest()
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return False
        fresh = cdc.deduplicate(events.select(*self.keys, *self.columns, "lsn", "seq", "op", "table_name"), self.keys)
        if ordered and old["positions"]:
            known = self.positions().select("table_name", "last_lsn", "last_seq")
            fresh = fresh.join(F.broadcast(known), "table_name", "left").where(F.col("last_lsn").isNull() | (F.struct("lsn", "seq") > F.struct("last_lsn", "last_seq"))).drop("last_lsn", "last_seq")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # Kept in as many parts as its size asks for: each part of a small batch is written in as many pieces as a shuffle has.
        with cdc.settings(events.sparkSession, {"spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true"}):
            fresh = fresh.withColumn("_bucket", bucket).persist()
        try:
            told = {r["table_name"]: r for r in cdc.checkpoints(fresh, F.collect_set("_bucket").alias("touched")).collect()}
            touched = sorted({b for r in told.values() for b in r["touched"]})
            version, folders = old["version"] + 1, dict(old["folders"])
            if touched:
                self._write(version, fresh.drop("_bucket"), folders, [str(b) for b in touched], bucket, horizon)
                folders |= {str(b): f"v{version}/_bucket={b}" for b in touched}
                there = set(files.names(self.spark, f"{self.path}/data/v{version}"))
                folders = {b: f for b, f in folders.items() if int(b) not in touched or f"_bucket={b}" in there}  # all of a bucket's rows may have gone
        finally:
            fresh.unpersist()
        positions = dict(old["positions"])
        for name, r in told.items():
            before = positions.get(name, ["", -1, 0])
            positions[name] = [*max(before[:2], [r["last_lsn"] or "", r["last_seq"] or 0]), before[2] + r["rows_applied"]]
        for name, place in (done or {}).items():
            positions[name] = [*place, positions.get(name, ["", -1, 0])[2]]
        if before_commit:
            before_commit()
        new = {"version": version, "buckets": self.buckets, "folders": folders, "positions": positions, "batch": old["batch"] if batch is None else batch}
        files.write_new(self.spark, f"{self.path}/manifests/v{version:012d}", json.dumps(new))
        self._clean(old, new)
        return True

    def _write(self, version: int, fresh: DataFrame, folders: dict[str, str], touched: list[str], bucket, horizon: str | None) -> None:
        after = cdc.apply_idempotent(self._stored(folders, touched), fresh, self.keys, self.columns)
        if horizon is not None:
            after = after.where(~F.col("deleted") | (F.col("last_lsn") >= horizon))
        # Rebalanced, so that a large bucket is written by several tasks and small ones share a task.
        after.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v{version}")

    def _clean(self, old: dict, new: dict) -> None:
        """Remove what neither version names: folders of buckets, and manifests before ``old``."""
        named = {*old["folders"].values(), *new["folders"].values()}
        for v in files.names(self.spark, f"{self.path}/data"):
            parts = [f"{v}/{b}" for b in files.names(self.spark, f"{self.path}/data/{v}") if b.startswith("_bucket=")]
            if not any(p in named for p in parts):
                files.remove(self.spark, f"{self.path}/data/{v}")
            else:
                for p in parts:
                    if p not in named:
                        files.remove(self.spark, f"{self.path}/data/{p}")
        for v in self.versions():
            if v < old["version"]:
                files.remove(self.spark, f"{self.path}/manifests/v{v:012d}")


def take_snapshot(table: StoredTable, name: str, chunks: Sequence[tuple[object, object]], read: Callable[[object, object], DataFrame], position: Callable[[], tuple[str, int]], log: Callable[[tuple[str, int], tuple[str, int]], DataFrame]) -> None:
    """Load a source in key ranges while it goes on changing, each range and what the log holds around it as one batch.

    ``read(low, high)`` gives the rows of a range as they are, ``position()`` the log's present position and
    ``log(after, until)`` its events (keys, columns, lsn, seq, op, table_name). Rows of a range that the log changed
    between the positions before and after the read are left to these events; the others hold as of the position
    before. Finished ranges are stored with the rows, so an interrupted snapshot goes on with the first that isn't.
    """
    positions = table.manifest()["positions"]
    until = None
    for i, (low, high) in enumerate(chunks):
        if f"{name}#{i}" in positions:
            until = tuple(positions[f"{name}#{i}"][:2])
            continue
        before = position()
        rows = read(low, high).persist()
        rows.count()  # the read lies between the two positions
        after = position()
        window = log(before, after)
        kept = rows.join(window.select(*table.keys), table.keys, "left_anti")
        loaded = kept.select(*table.keys, *table.columns, F.lit(before[0]).alias("lsn"), F.lit(before[1]).cast("long").alias("seq"), F.lit("INSERT").alias("op"), F.lit(name).alias("table_name"))
        # Also what came between the range before and this one, so that no event is missed.
        events = loaded.unionByName(log(until if until is not None and until < before else before, after).select(*loaded.columns))
        table.apply(events, done={f"{name}#{i}": after})
        rows.unpersist()
        until = after
