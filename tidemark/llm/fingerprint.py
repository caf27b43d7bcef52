"""Operator 8: winnowed document fingerprints.

Rolling hashes of all k-grams of code points are cut to the minimum of each window of w consecutive
k-grams, the rightmost one on ties, and kept with their positions. Two texts that share k + w - 1 code
points share a kept hash, whatever surrounds the passage.

A text of under k code points has one hash, of the whole text. Unless w is given, texts of few k-grams have
windows of a quarter of them, so that they keep several hashes; a smaller window keeps every hash that a larger
one would, so what long and short texts share is still found. With w given, fewer k-grams count as one window.
Null counts as empty; the empty text has no hashes and two such are alike (likeness 1). Very long texts are
hashed whole, in blocks. Repeated rows give repeated results; rows of one key are ordered by text. Rows
without a key come last in the order. Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import code_points, mix, pieces

K, WINDOW, BLOCK = 12, 40, 1 << 20
SHARE = 4
BASE = 0x9E3779B97F4A7C15
RECORD = np.dtype([("position", "<u4"), ("hash", "<u4")])


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams (of the whole text if it is shorter), by doubling the gram's length."""
    k = min(k, len(points))
    h, done = mix(points.astype(np.uint64) + np.uint64(1)), 1
    out, length = None, 0
    rest = k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, length = h, done
                else:  # out covers [i, i+length), h covers what follows
                    n = len(points) - length - done + 1
                    out, length = out[:n] + np.uint64(pow(BASE, length, 1 << 64)) * h[length : length + n], length + done
            rest >>= 1
            if rest:
                n = len(h) - done
                h, done = h[:n] + np.uint64(pow(BASE, done, 1 << 64)) * h[done : done + n], 2 * done
        return mix(out[: len(points) - k + 1] * np.uint64(BASE))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values, by doubling."""
    done, out = 1, x
    while done * 2 <= w:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - done : w - done + len(x) - w + 1]) if done < w else out


def winnow(text: str | None, k: int = K, w: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Kept positions (of k-grams, in code points) and 32-bit hashes, in order of position."""
    points = code_points(text)
    if not len(points):
        return np.empty(0, RECORD)
    grams = max(1, len(points) - k + 1)
    w = min(w or min(WINDOW, max(1, grams // SHARE)), grams)
    kept = []
    for at in range(0, grams - w + 1, block):  # windows that begin in [at, at + block)
        windows = min(block, grams - w + 1 - at)
        h = rolling(points[at : at + windows + w + k - 2], k) >> np.uint64(32)
        order = (h << np.uint64(21)) | (np.uint64((1 << 21) - 1) - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is least
        least = np.unique(sliding_minimum(order, w))
        kept.append(np.stack([np.uint64((1 << 21) - 1) - (least & np.uint64((1 << 21) - 1)) + np.uint64(at), least >> np.uint64(21)], 1))
    rows = np.unique(np.concatenate(kept), axis=0) if len(kept) > 1 else kept[0][np.argsort(kept[0][:, 0])]
    out = np.empty(len(rows), RECORD)
    out["position"], out["hash"] = rows[:, 0], rows[:, 1]
    return out


def encoded(prints: np.ndarray) -> str:
    """Base64 of (position, hash) pairs as little-endian 32-bit integers."""
    return base64.b64encode(prints.tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), RECORD)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hashes; 1 if both are empty."""
    a, b = np.unique(a["hash"]), np.unique(b["hash"])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of another text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int | None = None) -> DataFrame:
    """Key and winnowed fingerprint, with positions, of each text."""
    @F.pandas_udf("string")
    def prints(texts):
        return texts.map(lambda x: encoded(winnow(x, k, w)))

    return docs.select(key, prints(F.col(text)).alias("fingerprint"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, with the next row by descending key.

    Rows are dealt out by ranges of the key, once, and sorted there. The first row of each range also goes to
    the range before it (that of the first range to the last), so every row finds the one after it at hand.
    The driver gets range bounds and first keys only, two per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(b) for b in keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []}) if n > 1 else []
    n = len(bounds) + 1
    key_or_least = F.coalesce(F.col("key"), F.lit(-(1 << 63)))
    # The range of a key counts the bounds that are not below it: 0 has the largest keys.
    place = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b >= key_or_least)) if bounds else F.lit(0)
    firsts = {r[0]: r[1] for r in keys.groupBy(place.alias("place")).agg(F.max("key")).collect()}
    ordered = sorted(firsts)
    before = {firsts[p]: ordered[i - 1] for i, p in enumerate(ordered)}
    copies = rows.select("*", place.alias("place"), F.lit(0).alias("copy"))
    if before:
        to = F.create_map([F.lit(x) for pair in before.items() for x in pair])
        ends = rows.where(key_or_least.isin(list(before))).select("*", to[key_or_least].cast("int").alias("place"), F.lit(1).alias("copy"))
        copies = copies.unionByName(ends)
    dealt = copies.repartitionById(n, "place").sortWithinPartitions("place", "copy", F.col("key").desc_nulls_last(), "text")
    kind = docs.schema[key].dataType
    fields = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        held = None  # the row whose next one is awaited: key, text, fingerprint
        place_now, done = None, False
        out: list[tuple] = []
        for batch in batches:
            for part in pieces(batch, 256):
                for x, t, p, copy in zip(*(part.column(c).to_pylist() for c in ("key", "text", "place", "copy"))):
                    if p != place_now:
                        held, place_now, done = None, p, False
                    if done:
                        continue
                    prints = winnow(t, k, w)
                    if held is not None:
                        changed = edited(held[1], t)
                        its = winnow(changed, k, w)
                        out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(held[2]), encoded(its), likeness(held[2], its), likeness(held[2], prints)))
                    held, done = (x, t, prints), copy == 1
                if out:
                    yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))
                    out = []

    return dealt.mapInArrow(run, fields).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
