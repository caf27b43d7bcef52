"""What the operators of this subpackage share: shared-folder tables, Arrow batch maps, lookups."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a single machine, as in tests, a temporary folder is made, once per application.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application's Python ends."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may be gone at exit; the folder is the cluster's scratch space
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python process, over all tasks that it runs, or until another operator's task gives it back."""
    home = sys.modules.setdefault("_tidemark_caches", types.ModuleType("_tidemark_caches"))
    return home.__dict__.setdefault(name, {})


def give_back(keep: str | None = None) -> None:
    """Return what a Python process holds and doesn't need now: caches but those whose names begin with ``keep``, and freed memory."""
    for name, cache in vars(sys.modules.get("_tidemark_caches", types.ModuleType(""))).items():
        if isinstance(cache, dict) and not (keep and name.startswith(keep)):
            cache.clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on the session sends Python workers Arrow batches of about ``size``, unless it has a size of its own.

    The batches of 10,000 rows that are usual take, with long texts, some 100 MB of an executor for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def mapped(df: DataFrame, of: Callable[[dict[str, list]], dict[str, Sequence]], schema: str | StructType, rows: int = 512, keep: str | None = None) -> DataFrame:
    """Apply ``of`` to pieces of at most ``rows`` rows as Python lists by column; it returns columns of ``schema``.

    Between batches the process gives back what it holds, but for the caches that ``keep`` names.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, rows):
            out = of({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep)
        for batch in batches:
            yield from made(batch)
            del batch
            give_back(keep)

    return df.mapInArrow(run, kind)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of a batch, so that what a step holds besides the batch stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo ``modulus``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case and every other character as it is."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def code_points(text: str | None) -> np.ndarray:
    """The code points of a text as uint32."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class HashLookup:
    """An immutable map from 64-bit keys to floats with a vectorised ``get``; absent keys give 0.

    It travels as its keys and values; each worker lays the slots out for itself. A slot holds the position of a key, 0 if
    it is empty: the key at 0 is never looked up in another slot than its own, so no empty slot looks like it.
    """

    def __reduce__(self) -> tuple:
        return HashLookup, (self.keys, self.values)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys.astype(np.uint64, copy=False), values.astype(np.float32, copy=False)
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (mix(self.keys) >> self.shift).astype(np.int64)
        self.place = np.zeros(1 << bits, np.uint32)
        self.place[slot[::-1]] = np.arange(len(keys), dtype=np.uint32)[::-1]  # of the keys of a slot the first stays
        self.first = slot[0] if len(keys) else -1
        rest = np.flatnonzero(self.place[slot] != np.arange(len(keys), dtype=np.uint32))
        self.more = rest[np.argsort(self.keys[rest])].astype(np.uint32)
        self.more_keys = self.keys[self.more]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``keys`` and which of them are present."""
        if not len(self.keys):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        at = self.place[slot]
        found = self.keys[at] == keys
        values = np.where(found, self.values[at], np.float32(0))
        if len(self.more):
            odd = np.flatnonzero(~found)
            odd = odd[(at[odd] > 0) | (slot[odd] == self.first)]  # a key that isn't in its slot was there after another
            near = np.minimum(np.searchsorted(self.more_keys, keys[odd]), len(self.more) - 1)
            hit = self.more_keys[near] == keys[odd]
            values[odd[hit]], found[odd[hit]] = self.values[self.more[near[hit]]], True
        return values, found
