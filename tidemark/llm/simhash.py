"""Operator 2: SimHash near-duplicate groups, found with BK-trees.

Each text gets a 64-bit SimHash of its word shingles. Equal fingerprints are brought together first, so
copies cost nothing later. Distinct fingerprints are dealt to shards: the 64 bits are cut into
``radius + 1`` blocks, and two fingerprints within the radius agree on a whole block, so they meet in the
shard of that block's value. A shard with too many members is dealt again by blocks of its other bits, and so on. In
each shard a BK-tree (children keyed by their integer distance from the parent) is searched along edges
within the radius only, and a spanning forest of the links found is kept: one edge a member at most, not
all pairs. Trees go where their shard is; nothing is broadcast or brought to the driver.

By exact likeness (``radius`` a fraction) the same trees hold SimHashes of five-word sets, in shards of
min-hash bands: at a likeness of 0.8 about 10 of 64 bits differ, so blocks of equal bits would be too short to
deal by. See ``alike``.

Null texts and texts without words have fingerprint 0 and are linked like any other. Texts of fewer words
than a shingle have one shingle of all words. Long texts are hashed whole, their bits counted in blocks. Repeated rows share a fingerprint and thus a component. A
component without any key gets a null id. Empty tables give empty results; columns other than the key and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alike import alike_prints, link_sets
from tidemark.llm.bktree import BKForest
from tidemark.llm.components import connected_components
from tidemark.llm.shared import free_name, lower_bytes, mapped, written

WORDS, RADIUS, SHARD = 3, 3, 2048
SET_WORDS = 5


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, which are split at ASCII white space."""
    joined = b" ".join(lower_bytes(text).split())
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts, ends = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()], [*gaps[words - 1 :].tolist(), len(joined)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles, repeats included."""
    return majority_bits(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(mask: int, count: int) -> list[int]:
    """``mask`` with each of ``count`` equal blocks of the bits that it lacks."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [round(i * len(free) / count) for i in range(count + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def link_prints(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, deepest: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column ``print``) within the radius of each other.

    Shards of over ``shard`` members are dealt again, up to ``deepest`` times; what is large then shares all but
    a few bits, and is searched as it is.
    """
    masks, small = block_masks(0, radius + 1), None
    dealt = prints.select("print", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    for turn in range(deepest):
        value = F.col("print").bitwiseAND(F.col("mask")).alias("value")
        valued = dealt.select("print", "mask", value)
        large = written(valued.groupBy("mask", "value").count().where(F.col("count") > shard).select("mask", "value", F.lit(True).alias("large")), "large-shards")
        if large.isEmpty():
            break
        marked = written(valued.join(large, ["mask", "value"], "left").select("print", "mask", "large"), "dealt")
        rest = marked.where(F.col("large").isNull()).select("print", "mask")
        small = rest if small is None else small.unionByName(rest)
        split = {m: block_masks(m, radius + 1) for m in masks}
        table = prints.sparkSession.createDataFrame([(signed(m), signed(x)) for m, found in split.items() for x in found], "mask long, next long")
        # A few thousand rows at most: the masks of a level, whatever the input.
        dealt = marked.where("large").join(F.broadcast(table), "mask").select("print", F.col("next").alias("mask"))
        masks = sorted({x for found in split.values() for x in found})
    dealt = dealt if small is None else dealt.unionByName(small)
    keyed = dealt.select("print", F.xxhash64("mask", F.col("print").bitwiseAND(F.col("mask"))).alias("shard"))
    # A hash that two shards share joins them into one tree, which only adds distances to compute.
    rows = keyed.distinct().repartition("shard").sortWithinPartitions("shard", "print")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_p = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(s: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            member, earlier = BKForest(s, x).spanning(radius)
            return pa.RecordBatch.from_arrays([pa.array(x[member].view(np.int64)), pa.array(x[earlier].view(np.int64))], names=["a", "b"])

        for batch in batches:
            s = np.concatenate([held_s, batch.column(1).to_numpy()])
            x = np.concatenate([held_p, batch.column(0).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(s, s[-1])) if len(s) else 0  # the last shard may go on in the next batch
            if whole:
                yield linked(s[:whole], x[:whole])
            held_s, held_p = s[whole:], x[whole:]
        if len(held_s):
            yield linked(held_s, held_p)

    return rows.select("print", "shard").mapInArrow(link, "a long, b long")


def simhash_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Key and fingerprint (``print``, as a signed long) of each text."""
    kind = docs.schema[key].dataType.simpleString()
    made = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), lambda r: {"key": r["key"], "print": [signed(simhash(x, words)) for x in r["text"]]}, f"key {kind}, print long")
    return made.withColumnRenamed("key", key)


def set_hashes(text: str | None) -> np.ndarray:
    """The set of a text's shingles of five words, sorted."""
    return np.unique(shingle_hashes(text, SET_WORDS))


def printed(docs: DataFrame, text: str, words: int, radius: int | float, name: str = "_tidemark") -> DataFrame:
    """``docs`` with a struct ``name`` of what tells its text apart: ``print``, and what links need beside it."""
    if isinstance(radius, float):
        made = alike_prints(F.col(text), set_hashes, majority_bits, 1 - radius)
    else:
        made = F.struct(F.pandas_udf(lambda t: t.map(lambda x: signed(simhash(x, words))), "long")(F.col(text)).alias("print"))
    return docs.withColumn(name, made)


def rooted_prints(made: DataFrame, groups: DataFrame, text: str, radius: int | float, name: str = "_tidemark") -> DataFrame:
    """``groups``, a row a print, with the root of its component."""
    if isinstance(radius, float):
        edges = link_sets(made.select(f"{name}.*", F.col(text).alias("text")), 1 - radius, set_hashes)
    else:
        edges = link_prints(groups.select("print"), radius)
    roots = connected_components(edges).toDF("print", "root")
    return written(groups.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int | float = RADIUS) -> DataFrame:
    """Key, fingerprint (hex) and component_id, the smallest key that links lead to.

    A whole ``radius`` counts differing bits of SimHashes. A fraction is a Jaccard distance of the sets of
    five-word shingles: BK-trees of the sets' SimHashes find candidates and exact likeness decides; the
    fingerprint is then a digest of the set.
    """
    made = printed(docs.select(key, text), text, words, radius)
    made = written(made if isinstance(radius, float) else made.drop(text), "prints")
    groups = written(made.groupBy("_tidemark.print").agg(F.min(key).alias("least")), "distinct-prints")
    rooted = rooted_prints(made, groups, text, radius)
    # The ids are a table of their own, so the join's hot roots can be split.
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    members = rooted.join(ids, "root").select("print", "component_id")
    return made.select(key, F.col("_tidemark.print").alias("print")).join(members, "print").select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int | float = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest key, missing keys last, then of the least print.

    Rows are told apart by key and print, so a key that several texts have keeps those that are first in their
    groups. Of rows with the same key and print one stays.
    """
    name = free_name(docs, "_tidemark")
    own, print_ = free_name(docs, f"{name}_key"), free_name(docs, f"{name}_print")
    made = written(printed(docs, text, words, radius, name), "prints")
    by_key = made.groupBy(F.col(f"{name}.print").alias("print"), F.col(key).alias("key")).agg(F.count("*").alias("rows"))
    groups = written(by_key.groupBy("print").agg(F.min(F.struct(F.isnull("key").alias("unkeyed"), "key", "print", "rows")).alias("least")), "distinct-prints")
    rooted = rooted_prints(made, groups, text, radius, name)
    first = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(own), F.col("least.print").alias(print_), F.col("least.rows").alias("rows")), "first")
    at = F.col(key).eqNullSafe(F.col(own)) & (F.col(f"{name}.print") == F.col(print_))
    sole = F.col("rows") == 1
    once = made.join(first.where(sole).drop("rows"), at, "left_semi")
    often = made.join(first.where(~sole).drop("rows"), at, "left_semi").withColumn(print_, F.col(f"{name}.print")).dropDuplicates([key, print_]).drop(print_)
    return once.unionByName(often).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
