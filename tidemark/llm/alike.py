"""Near-duplicate links by the exact Jaccard likeness of sets of word shingles, among candidates of BK-trees.

Texts of equal sets are brought together first. Sets are dealt to shards by min-hashes in bands, so many bands
of so many rows that a pair alike in the bound shares none but for ``MISS`` at most; shards of the same members
count once. In a shard a BK-tree of the sets' SimHashes gives the pairs within ``RADIUS`` bits, which cut the
shard into clusters; equal clusters of several shards count once. Only then are the sets themselves shuffled,
to their clusters, and pairs of candidates that links do not join yet are linked if their likeness reaches the
bound.

A shard of over ``ROOM`` members is never searched whole. All its members are compared with one hub, the one
whose SimHash is nearest to the majority of the shard's bits; those alike are linked to it. Two members that
are linked to one hub need no comparison, so shards without others are done, which is how groups of near copies
end. Where at most ``GUESTS`` others are left, the linked ones are dealt to parts and the others go to all
parts. Else the members of such shards are dealt again by more and longer bands, until all shards are small. A
shard's hub is left out then, as it met all members, so this ends. No pair is left out for a shard's size.

Null texts and texts without words have the empty set and are alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bktree import BKForest, joined
from tidemark.llm.shared import give_back, mapped, mix, written

MISS, ROOM, GUESTS, RADIUS, SMALL_TABLE = 3e-5, 512, 64, 24, 100_000


def set_print(hashes: np.ndarray) -> int:
    """A digest of a sorted set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)).view(np.int64))


def band_shape(bound: float, turn: int) -> tuple[int, int]:
    """How many bands of how many rows each: 4, 12 and then 20 rows."""
    rows = (4, 12, 20)[min(turn, 2)]
    return math.ceil(math.log(MISS) / math.log1p(-(min(bound, 0.999) ** rows))), rows


def bands(hashes: np.ndarray, bound: float, turn: int = 0) -> np.ndarray:
    """One value a band: equal for two sets if their min-hashes in the band are."""
    count, rows = band_shape(bound, turn)
    at = np.arange(count * rows, dtype=np.uint64) + np.uint64(1 + 100_000 * turn)
    salts, factors = mix(at), mix(at + np.uint64(50_000)) | np.uint64(1)
    least = np.full(count * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[k : k + 4096] ^ salts[:, None]) * factors[:, None]).min(1))
    value = np.zeros(count, np.uint64)
    for column in least.reshape(count, rows).T:
        value = mix(value + column)
    return value.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, bound: float) -> bool:
    """Whether the Jaccard likeness of two sorted sets is ``bound`` at least; empty sets are alike."""
    if min(len(a), len(b)) < bound * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= bound * (len(both) - shared)


def candidates(shards: np.ndarray, prints: np.ndarray, sizes: np.ndarray, hubs: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard within ``RADIUS`` bits whose sizes allow the bound and that no hub joins (-1: none)."""
    a, b = BKForest(shards, prints, RADIUS).earlier_within(np.arange(len(prints), dtype=np.int32), RADIUS)
    fit = (np.minimum(sizes[a], sizes[b]) >= bound * np.maximum(sizes[a], sizes[b])) & ((hubs[a] != hubs[b]) | (hubs[a] < 0))
    return a[fit], b[fit]


def links(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], hubs: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Of the candidates (a, b) alike pairs that connect all that a chain of alike pairs or a hub connects."""
    of, home, out = list(range(len(sets))), {}, []
    for i, hub in enumerate(hubs.tolist()):
        if hub >= 0:
            of[i] = home.setdefault(hub, i)

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y and alike(sets[i], sets[j], bound):
            out.append((i, j))
            of[max(x, y)] = min(x, y)
    return out


def alike_prints(text: Column, hashes: Callable, majority: Callable, bound: float) -> Column:
    """A struct of each text: digest of its set (``print``), SimHash and size of the set, and bands."""

    @F.pandas_udf("print long, simhash long, size long, bands array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        give_back()
        rows = []
        for t in texts:
            h = hashes(t)
            rows.append((set_print(h), int(np.uint64(majority(h)).view(np.int64)), len(h), bands(h, bound)))
        return pd.DataFrame(rows, columns=["print", "simhash", "size", "bands"])

    return made(text)


MEMBER = ("shard", "print", "simhash", "size", "hub")


def shards_of(dealt: DataFrame) -> DataFrame:
    """Members of shards that have a pair to compare, with their number ``n``; of shards with the same members one."""
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("print", "hub")).alias("x"), F.bit_xor(F.xxhash64("hub", "print")).alias("y"), F.min("print").alias("lo"), F.max("print").alias("hi")]
    met = dealt.groupBy("shard").agg(*same, F.count(F.when(F.col("hub").isNull(), 1)).alias("open")).where("n > 1 AND open > 0")
    once = written(met.groupBy("n", "x", "y", "lo", "hi").agg(F.min("shard").alias("shard")).select("shard", "n"), "shards")
    return written(dealt.join(once, "shard"), "shard-members")


def whole_groups(batches: Iterator[pa.RecordBatch], room: int, room_bytes: int = 1 << 26) -> Iterator[pa.Table]:
    """Tables of whole groups (equal values of the first column, which come together), of about ``room`` rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), batch.num_rows]
        at = 0
        for k, end in enumerate(ends):
            start = ends[k - 1] if k else 0
            begins = bool(k) or not held or held[-1].column(0)[-1].as_py() != first[0]
            if begins and (held or start > at):
                rows = sum(x.num_rows for x in held) + start - at
                if rows >= room or sum(x.nbytes for x in held) + batch.slice(at, start - at).nbytes >= room_bytes:
                    yield pa.Table.from_batches([*held, batch.slice(at, start - at)])
                    held, at = [], start
                    give_back()
        if batch.num_rows > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def numbered(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    x = values.combine_chunks().dictionary_encode()
    return x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def clusters(members: DataFrame, bound: float) -> DataFrame:
    """Members of small shards by clusters of candidates (column ``shard``); members without one and equal clusters are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4096):
            shards, hubs = numbered(t["shard"]), numbered(t["hub"])
            prints, simhash, sizes = (t[c].to_numpy() for c in ("print", "simhash", "size"))
            a, b = candidates(shards, simhash.view(np.uint64), sizes, hubs, bound)
            label = joined(np.arange(len(prints), dtype=np.int32), a, b)
            order = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0]) if len(order) else order
            sizes_of = np.diff(np.r_[first, len(order)])
            with np.errstate(over="ignore"):
                each = mix(prints[order].view(np.uint64) ^ mix(np.where(hubs[order] < 0, np.uint64(0), mix(t["hub"].fill_null(0).to_numpy()[order].view(np.uint64)) | np.uint64(1))))
                names = mix(np.add.reduceat(each, first)) if len(first) else each
            kept = np.repeat(sizes_of > 1, sizes_of)
            out = t.take(pa.array(order[kept])).set_column(0, "shard", pa.array(np.repeat(names, sizes_of)[kept].view(np.int64)))
            yield from out.combine_chunks().to_batches()

    dealt = members.select(*MEMBER).repartition("shard").sortWithinPartitions("shard", "print")
    return dealt.mapInArrow(cut, "shard long, print long, simhash long, size long, hub long").dropDuplicates(["shard", "print"])


def small(df: DataFrame) -> DataFrame:
    """``df`` to broadcast if it has few rows (of some longs each), else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def shard_hubs(large: DataFrame) -> DataFrame:
    """(shard, hub, parts): the open member nearest to the majority of the open ones' bits, and how many tasks compare with it."""
    still = large.where(F.col("hub").isNull())
    sums = still.groupBy("shard").agg(*[F.sum(F.getbit("simhash", F.lit(i)).cast("int") * 2 - 1).alias(f"b{i}") for i in range(64)])
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    centre = written(sums.select("shard", bits.alias("centre")), "centres")
    near = still.join(small(centre), "shard").groupBy("shard").agg(F.min(F.struct(F.bit_count(F.col("simhash").bitwiseXOR(F.col("centre"))).alias("far"), "print")).alias("of"), F.max("n").alias("n"))
    hubs = written(near.select("shard", F.col("of.print").alias("new_hub"), F.ceil(F.col("n") / ROOM).cast("int").alias("parts")), "hubs")
    most = hubs.groupBy("new_hub").agg(F.max("parts").alias("parts"))
    return written(hubs.drop("parts").join(most, "new_hub").select("shard", "new_hub", "parts"), "hubs")


def compared(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, bound: float) -> DataFrame:
    """Of the (print, new_hub, parts) pairs those that are alike; a hub's set goes to each of its parts."""
    hub_sets = hubs.select("new_hub", "parts").distinct().join(sets.select(F.col("print").alias("new_hub"), F.col("hashes").alias("hub_hashes")), "new_hub")
    hub_sets = hub_sets.select("new_hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hub_hashes")
    dealt = pairs.select("print", "new_hub", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int").alias("part")).join(sets.select("print", "hashes"), "print").join(hub_sets, ["new_hub", "part"])

    def keep(r: dict[str, list]) -> dict[str, list]:
        found = [(p, h) for p, h, a, b in zip(r["print"], r["new_hub"], r["hashes"], r["hub_hashes"]) if alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), bound)]
        return {"print": [p for p, _ in found], "new_hub": [h for _, h in found]}

    return mapped(dealt.select("print", "new_hub", "hashes", "hub_hashes"), keep, "print long, new_hub long", 64)


def link_sets(made: DataFrame, bound: float, hashes: Callable) -> DataFrame:
    """Edges (a, b) between the prints of ``made`` that connect all texts alike in ``bound`` or more."""
    one = written(made.groupBy("print").agg(*[F.first(c).alias(c) for c in ("simhash", "size", "bands")]), "bands")
    dealt = one.select("print", "simhash", "size", F.lit(None).cast("long").alias("hub"), F.posexplode("bands").alias("band", "value"))
    members = shards_of(dealt.select(F.xxhash64("band", "value").alias("shard"), *MEMBER[1:]))
    wanted = made.select("print", "text").join(members.select("print").distinct(), "print", "left_semi").dropDuplicates(["print"])
    sets = written(mapped(wanted, lambda r: {"print": r["print"], "hashes": [hashes(x).tobytes() for x in r["text"]]}, "print long, hashes binary"), "sets")
    edges, ready, turn = [], members.where(F.col("n") <= ROOM).select(*MEMBER), 0
    while not (large := members.where(F.col("n") > ROOM)).isEmpty():
        hubs = shard_hubs(large)
        met = written(large.join(small(hubs), "shard").where("print <> new_hub"), "met")
        linked = written(compared(met.select("print", "new_hub", "parts").distinct(), sets, hubs, bound), "linked")
        edges.append(linked.toDF("a", "b"))
        told = met.join(linked.withColumn("linked", F.lit(True)), ["print", "new_hub"], "left").select("shard", "print", "simhash", "size", F.when(F.col("linked"), F.col("new_hub")).otherwise(F.col("hub")).alias("hub"))
        told = written(told, "told")
        still = written(told.groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(F.col("hub").isNull(), 1)).alias("open")).where("open > 0"), "open")
        few = still.where((F.col("open") <= GUESTS) & (F.col("open") < F.col("n"))).select("shard", F.ceil((F.col("n") - F.col("open")) / ROOM).cast("int").alias("parts"))
        parts = F.when(F.col("hub").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("print", "shard"), F.col("parts")).cast("int")))
        guests = told.join(small(few), "shard").select(F.explode(parts).alias("part"), *MEMBER)
        ready = ready.unionByName(guests.select(F.xxhash64("shard", "part").alias("shard"), *MEMBER[1:]))
        many = still.join(few, "shard", "left_anti").select("shard")
        # Longer bands need no shard beside them: each set is dealt again once, however many large shards it was in.
        turn += 1
        again = told.join(small(many), "shard", "left_semi").groupBy("print").agg(F.first("simhash").alias("simhash"), F.first("size").alias("size"), F.min("hub").alias("hub"))
        banded = mapped(sets.join(again.select("print"), "print", "left_semi"), lambda r, turn=turn: {"print": r["print"], "bands": [bands(np.frombuffer(x, np.uint64), bound, turn) for x in r["hashes"]]}, "print long, bands array<long>")
        dealt = again.join(banded, "print").select("print", "simhash", "size", "hub", F.posexplode("bands").alias("band", "value"))
        members = shards_of(dealt.select(F.xxhash64(F.lit(turn), "band", "value").alias("shard"), *MEMBER[1:]))
        ready = ready.unionByName(members.where(F.col("n") <= ROOM).select(*MEMBER))
    found = written(clusters(ready, bound), "clusters")
    grouped = found.join(sets, "print").select(*MEMBER, "hashes").repartition("shard").sortWithinPartitions("shard", "print")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1024):
            prints, simhash, sizes = (t[c].to_numpy() for c in ("print", "simhash", "size"))
            shards, hubs = numbered(t["shard"]), numbered(t["hub"])
            a, b = candidates(shards, simhash.view(np.uint64), sizes, hubs, bound)
            pairs = links(a, b, [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]], hubs, bound)
            yield pa.RecordBatch.from_arrays([pa.array([prints[p[side]] for p in pairs], pa.int64()) for side in (0, 1)], names=["a", "b"])

    out = grouped.mapInArrow(link, "a long, b long")
    for more in edges:
        out = out.unionByName(more)
    return out
