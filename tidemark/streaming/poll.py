"""Polling of a change table as a stream source: ``spark.readStream.format("tidemark_changes")``.

The change table is a folder of Parquet files with columns ``lsn`` and ``seq``. An offset is the position (lsn, seq)
of the last event of a poll. A poll takes at most ``limit`` events after the last one in order of position, and more
only where several share the last position. Its events are read in ``splits`` ranges of positions, each by a task
of its own. Row groups are known by the least and greatest LSN in the files' footers, so a poll reads those that hold
the next positions and, where files follow the log's order, no others: the two columns of positions at the driver, and
all asked columns in tasks.

A batch is one poll, or up to ``polls`` polls where more are there, so that catching up takes few batches. Then the
footers' counts tell how far a batch goes: row groups that it takes whole are not read at the driver, only that in which
it ends (with those that overlap it, and of these at most ``AT_DRIVER`` positions, with which a batch ends sooner).

Options: ``path`` (a path or URI that pyarrow can open), ``limit`` (1000), ``polls`` (1), ``splits`` (4), ``after``
(``lsn,seq`` to begin after). The schema is the files' unless one is given. Rows without an LSN have no place in the log and are not read;
a missing ``seq`` counts as 0. An empty or missing folder has no events yet; files may be added at any time with
positions after those that were polled.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.sources import files
from tidemark.streaming import cdc

# The source travels to workers by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Position = tuple[str, int]
START: Position = ("", -1)
#: Positions of a batch of many polls that the driver holds at most, unless one poll has more.
AT_DRIVER = 1_000_000
LAST = (1 << 63) - 1


Unit = tuple[str, str, str, int]  # least and greatest LSN, file, row group


class Range(InputPartition):
    """Events after ``low`` up to ``high``, of the row groups that can hold any."""

    def __init__(self, low: Position, high: Position, units: list[Unit]):
        super().__init__((low, high))
        self.low, self.high, self.units = low, high, units


class ChangeFiles:
    """The row groups of a change table's files with the LSNs that each holds."""

    def __init__(self, path: str):
        self.system, self.root = pafs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (pafs.LocalFileSystem(), path)
        self.known: dict[str, list[Unit]] = {}
        self.counts: dict[tuple[str, int], int] = {}  # rows with an LSN, of row groups whose footer tells

    def list(self) -> list[Unit]:
        """All row groups in order of their least LSN; footers are read once a file."""
        selector = pafs.FileSelector(self.root, recursive=True, allow_not_found=True)
        for info in self.system.get_file_info(selector):
            if info.is_file and info.path.endswith(".parquet") and not info.base_name.startswith(("_", ".")) and info.path not in self.known:
                self.known[info.path] = self.bounds(info.path)
        return sorted(u for units in self.known.values() for u in units)

    def bounds(self, path: str) -> list[Unit]:
        with self.system.open_input_file(path) as file:
            meta = pq.ParquetFile(file).metadata
        place, out = meta.schema.names.index("lsn"), []
        for i in range(meta.num_row_groups):
            told = meta.row_group(i).column(place).statistics
            if told is not None and told.has_min_max:
                out.append((told.min, told.max, path, i))
                if told.has_null_count:
                    self.counts[path, i] = meta.row_group(i).num_rows - told.null_count
            elif told is None or told.num_values:
                out.append(("", "\U0010ffff", path, i))  # without statistics it may hold any
        return out

    def read(self, units: list[Unit], low: Position, high: Position | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """Batches of the rows after ``low`` and up to ``high``."""
        lsn, seq = ds.field("lsn"), pc.coalesce(ds.field("seq"), pa.scalar(0, pa.int64()))
        wanted = (lsn > low[0]) | ((lsn == low[0]) & (seq > low[1]))
        if high is not None:
            wanted &= (lsn < high[0]) | ((lsn == high[0]) & (seq <= high[1]))
        for _, _, path, group in units:
            yield from ds.ParquetFileFormat().make_fragment(path, self.system, row_groups=[group]).to_batches(columns=columns, filter=wanted)

    def next_places(self, low: Position, limit: int) -> list[Position]:
        """The positions of the first ``limit`` events after ``low``, and those that share the last of them."""
        best: list[Position] = []
        for unit in self.list():
            if unit[1] < low[0]:
                continue
            if len(best) >= limit and unit[0] > best[limit - 1][0]:
                break  # neither this row group nor a later one begins before the limit-th position
            found = [(r["lsn"], r["seq"]) for b in self.read([unit], low, None, ["lsn", "seq"]) for r in self.first(b, limit)]
            best = list(heapq.merge(best, sorted(found)))
            if len(best) > limit:
                best = [p for p in best if p <= best[limit - 1]]
        return best

    def clusters(self, low: Position) -> list[list[Unit]]:
        """Row groups that may hold events after ``low``, in order; those whose LSNs overlap are together."""
        out, high = [], ""
        for unit in self.list():
            if unit[1] >= low[0]:
                if out and unit[0] <= high:
                    out[-1].append(unit)
                else:
                    out.append([unit])
                high = max(high, unit[1])
        return out

    def end_of_polls(self, low: Position, limit: int, polls: int) -> Position | None:
        """The position that ends the next ``polls`` polls after ``low``, or as many as there are; None if there are none."""
        passed, end, skipped = 0, None, None
        found = self.clusters(low)
        for i, units in enumerate(found):
            left = limit * polls - passed
            own = None if units[0][0] <= low[0] or any((u[2], u[3]) not in self.counts for u in units) else sum(self.counts[u[2], u[3]] for u in units)
            if own is not None and own < left and i + 1 < len(found):
                passed, skipped = passed + own, units
                continue
            at_driver = max(AT_DRIVER, limit)
            wanted = left if left <= at_driver else (passed + at_driver) // limit * limit - passed
            places = self.positions(units, low, wanted)
            if places.num_rows:
                passed, end, skipped = passed + places.num_rows, (places["lsn"][-1].as_py(), places["seq"][-1].as_py()), None
            if places.num_rows >= wanted:
                break
        if skipped:  # what came after it holds no events
            top = max(u[1] for u in skipped)
            end = (top, max(pc.max(pc.fill_null(b.column("seq").cast(pa.int64()), 0)).as_py() for b in self.read(skipped, max(low, (top, -LAST)), (top, LAST), ["lsn", "seq"]) if b.num_rows))
        return end

    def positions(self, units: list[Unit], low: Position, wanted: int) -> pa.Table:
        """(lsn, seq) of the first ``wanted`` events after ``low`` in order, and no more at a time than twice that and a batch."""
        kind = pa.schema([("lsn", pa.string()), ("seq", pa.int64())])
        order, held, rows = [("lsn", "ascending"), ("seq", "ascending")], [], 0
        for b in self.read(units, low, None, ["lsn", "seq"]):
            held.append(pa.table({"lsn": b.column("lsn").cast(pa.string()), "seq": pc.fill_null(b.column("seq").cast(pa.int64()), 0)}, schema=kind))
            rows += b.num_rows
            if rows > 2 * wanted:
                held = [pa.concat_tables(held).sort_by(order).slice(0, wanted).combine_chunks()]
                rows = held[0].num_rows
        return pa.concat_tables([kind.empty_table(), *held]).sort_by(order).slice(0, wanted)

    @staticmethod
    def first(batch: pa.RecordBatch, limit: int) -> list[dict]:
        """The rows of a batch up to its ``limit``-th position, with all that share it."""
        table = pa.table({"lsn": batch.column("lsn"), "seq": pc.fill_null(batch.column("seq").cast(pa.int64()), 0)}).sort_by([("lsn", "ascending"), ("seq", "ascending")])
        if table.num_rows > limit:
            last = (table["lsn"][limit - 1].as_py(), table["seq"][limit - 1].as_py())
            upto = pc.or_(pc.less(table["lsn"], last[0]), pc.and_(pc.equal(table["lsn"], last[0]), pc.less_equal(table["seq"], last[1])))
            table = table.filter(upto)
        return table.to_pylist()


class PollReader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        self.path, self.limit, self.splits = options["path"], int(options.get("limit", 1000)), int(options.get("splits", 4))
        self.polls = int(options.get("polls", 1))
        lsn, _, seq = options.get("after", ",").partition(",")
        self.begin: Position = (lsn, int(seq)) if lsn else START
        self.schema = schema
        self.at: Position | None = None
        self.polled: list[Position] = []

    def initialOffset(self) -> dict:
        return {"lsn": self.begin[0], "seq": self.begin[1]}

    def latestOffset(self) -> dict:
        """The end of the next poll. After a restart Spark plans the last batch first, which tells where that ended."""
        if self.at is None:
            self.at = self.begin
        if self.polls > 1:
            self.at = self.changes().end_of_polls(self.at, self.limit, self.polls) or self.at
            return {"lsn": self.at[0], "seq": self.at[1]}
        self.polled = self.changes().next_places(self.at, self.limit)
        if self.polled:
            self.at = self.polled[-1]
        return {"lsn": self.at[0], "seq": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["lsn"], start["seq"]), (end["lsn"], end["seq"])
        if self.at is None:
            self.at = high
        if self.polls > 1:
            return self.by_row_groups(low, high)
        places = self.polled if self.polled and self.polled[-1] == high else self.changes().next_places(low, self.limit)
        every = max(1, -(-len(places) // self.splits))
        cuts = [low, *dict.fromkeys([p for p in places[every - 1 : -1 : every] if low < p < high] + [high])]
        there = self.changes().list()
        return [Range(a, b, [u for u in there if u[0] <= b[0] and u[1] >= a[0]]) for a, b in zip(cuts, cuts[1:])] or [Range(low, high, [])]

    def by_row_groups(self, low: Position, high: Position) -> list[Range]:
        """Ranges that end where row groups do, of about as many row groups each."""
        there = [u for u in self.changes().list() if u[0] <= high[0] and u[1] >= low[0]]
        ends = sorted({(u[1], LAST) for u in there if (u[1], LAST) < high and u[1] >= low[0]})
        every = max(1, -(-len(ends) // self.splits))
        cuts = [low, *ends[every - 1 :: every], high]
        return [Range(a, b, [u for u in there if u[0] <= b[0] and u[1] >= a[0]]) for a, b in zip(cuts, cuts[1:])]

    def changes(self) -> ChangeFiles:
        if not hasattr(self, "_changes"):
            self._changes = ChangeFiles(self.path)
        return self._changes

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        for batch in ChangeFiles(self.path).read(partition.units, partition.low, partition.high, kind.names):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in kind], schema=kind)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_changes"}  # open file systems stay where they are


class ChangeTable(DataSource):
    """The ``tidemark_changes`` format."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> StructType:
        found = ChangeFiles(self.options["path"])
        units = found.list()
        if not units:
            raise ValueError("a change table without files needs a schema")
        with found.system.open_input_file(units[0][2]) as file:
            return from_arrow_schema(pq.read_schema(file))

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options, schema)


def poll(spark: SparkSession, path: str, limit: int, schema: StructType | str | None = None, **options: object) -> DataFrame:
    """A stream of the change table at ``path``, ``limit`` events a poll and a poll a batch, or up to as many as the option ``polls`` says."""
    spark.dataSource.register(ChangeTable)
    stream = spark.readStream.format(ChangeTable.name()).option("path", path).option("limit", str(limit))
    for k, v in options.items():
        stream = stream.option(k, str(v))
    return (stream if schema is None else stream.schema(schema)).load()


def poll_into(table, changes: DataFrame, checkpoint: str, limit: int, on_poll=None) -> StreamingQuery:
    """Apply each poll of decoded events to a stored table, in order, and go on until none is left.

    ``on_poll(batch, events, state)`` hears of each: the state is ``CDC_CATCHUP`` until a poll isn't full, from then on
    ``CDC_STREAMING``. A poll that was applied before a failure isn't applied again: the table knows its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        n = batch.count()
        table.apply(batch, batch=number, ordered=True)
        if on_poll:
            on_poll(number, n, "CDC_CATCHUP" if n >= limit else "CDC_STREAMING")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def pages_of(spark: SparkSession, changes: DataFrame, to: str, checkpoint: str, limit: int | None = None) -> StreamingQuery:
    """Write each batch of a stream below ``to``/poll=<batch>, with the number of its poll as ``page``.

    With ``limit``, a batch holds many polls of as many events each, of one source table, which are numbered by their
    order: after the polls of the batch before, whose last number lies beside its rows, so a repeated batch finds the same.
    """

    def keep(batch: DataFrame, number: int) -> None:
        if limit is None:
            batch.withColumn("page", F.lit(number)).write.mode("overwrite").parquet(f"{to}/poll={number}")
            return
        before = f"{to}/last/batch={number - 1}"
        first = spark.read.schema("next int").parquet(before).first()["next"] if number and files.exists(spark, before) else 0
        table = [] if "table_name" in batch.columns else ["table_name"]
        placed = cdc.pages(batch.withColumns({t: F.lit(None).cast("string") for t in table}), limit).withColumn("page", F.col("page") + first).drop(*table)
        placed.write.mode("overwrite").parquet(f"{to}/poll={number}")
        written = spark.read.schema(placed.schema).parquet(f"{to}/poll={number}")
        written.agg(F.coalesce(F.max("page") + 1, F.lit(first)).cast("int").alias("next")).write.mode("overwrite").parquet(f"{to}/last/batch={number}")

    return changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
