"""Operator 13: centroid clustering of vectors by weighted deduplication.

Vectors are quantised to integers and packed into bytes; equal ones are grouped into one with a multiplicity.
Lloyd's rounds run on the distinct vectors: each task assigns its vectors and sums them by cluster, weighted by
their multiplicities and in integers, so sums are exact and don't depend on how rows are dealt. Only ``k``
centroids pass through the driver. Assignments are then joined back to the rows: vectors that make up more than
a thousandth of all rows, of which there are fewer than a thousand, by a broadcast, the others by a shuffle in
which no key is hot.

Kept are vectors of exactly ``dims`` components, none null or non-finite; a null vector isn't kept. A component
is floor(scale * x) in doubles, and at most 2 ** 62 either way. Ties: of equally near centroids the smaller number
is taken. Centroids start as the rows whose key's hash is least; rows without a key come last, rows of one key in
the order of their vectors' bytes; with fewer rows there are fewer centroids. A centroid without vectors stays as
it is. Repeated rows count as often as they occur and all come back, an empty table gives no rows, and columns
other than key and vector are not read. Distances and inertias of more than 2 ** 63 - 1 are given as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.shared import mapped, pieces, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64.0, 1
LIMIT, HIGHEST, HOT_PARTS = 1 << 62, (1 << 63) - 1, 1000
KINDS = (np.int8, np.int16, np.int32, np.int64)
#: Up to this size squares of 64 differences, and sums of 2 ** 42 vectors, are exact in 64 bits.
SMALL = 1 << 20


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    x = np.floor(scale * vectors.astype(np.float64))
    out = np.where(np.abs(x) < LIMIT, x, 0).astype(np.int64)
    return np.where(x >= LIMIT, LIMIT, np.where(x <= -LIMIT, -LIMIT, out))


def pack(vectors: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it, so that equal vectors have equal bytes."""
    out: list[bytes] = [b""] * len(vectors)
    low, high = (vectors.min(1), vectors.max(1)) if vectors.size else (np.zeros(len(vectors)), np.zeros(len(vectors)))
    left = np.ones(len(vectors), bool)
    for kind in KINDS:
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        left &= ~fits
        for at, row in zip(np.flatnonzero(fits).tolist(), vectors[fits].astype(kind)):
            out[at] = row.tobytes()
    return out


def unpack(packed: Sequence[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int64)
    sizes = np.array([len(p) for p in packed])
    for kind in KINDS:
        rows = np.flatnonzero(sizes == dims * np.dtype(kind).itemsize)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([packed[i] for i in rows]), kind).reshape(-1, dims)
    return out


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The number of each vector's nearest centroid and the exact squared distance to it."""
    largest = max([0, *(abs(x) for c in centroids for x in c)])
    fast = (np.abs(vectors) <= SMALL).all(1) if largest <= SMALL else np.zeros(len(vectors), bool)
    at, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), object)
    if fast.any():
        x, c = vectors[fast].astype(np.float64), np.array(centroids, np.float64)  # all terms are whole and below 2 ** 53
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        at[fast] = d.argmin(1)
        distance[fast] = d.min(1).astype(np.int64).astype(object)
    for i in np.flatnonzero(~fast):
        row = vectors[i].tolist()
        d, best = min((sum((a - b) ** 2 for a, b in zip(row, c)), j) for j, c in enumerate(centroids))
        at[i], distance[i] = best, d
    return at, distance.tolist()


def cluster_sums(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[tuple[int, list[int]] | None]:
    """Per centroid the number of its vectors and their sums; None without any."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for part in (p for b in batches for p in pieces(b, 4096)):
            x, n = unpack(part.column("packed").to_pylist(), dims), part.column("n").to_numpy()
            to, _ = nearest(x, centroids)
            fits = bool((np.abs(x) <= SMALL).all()) and int(n.sum()) < 1 << 42
            for c in np.unique(to).tolist():
                rows = to == c
                sums = (n[rows][:, None] * x[rows]).sum(0) if fits else (n[rows].astype(object)[:, None] * x[rows].astype(object)).sum(0)
                count[c] += int(n[rows].sum())
                total[c] = [a + int(b) for a, b in zip(total[c], sums)]
        told = [(c, place, x) for c in range(len(centroids)) if count[c] for place, x in enumerate([count[c], *total[c]])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in told], pa.int32()), pa.array([p for _, p, _ in told], pa.int32()), pa.array([Decimal(x) for _, _, x in told], pa.decimal128(38, 0))], names=["cluster", "place", "total"]
        )

    parts = distinct.mapInArrow(add, "cluster int, place int, total decimal(38,0)")
    found: list[dict[int, int]] = [{} for _ in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        found[r["cluster"]][r["place"]] = int(r["total"])
    return [(f[0], [f[p + 1] for p in range(dims)]) if f else None for f in found]


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int, dims: int) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over weighted vectors; a mean is rounded down in each component."""
    for _ in range(rounds if centroids else 0):
        sums = cluster_sums(distinct, centroids, dims)
        centroids = [old if new is None else [s // new[0] for s in new[1]] for old, new in zip(centroids, sums)]
    return centroids


def keep_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(key, packed) of the vectors that have ``dims`` finite components, as a table."""
    x = F.col(vector)
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.where(x.isNotNull() & whole).select(F.col(key).alias("key"), x.cast("array<double>").alias("x"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, 4096)):
            rows = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(pack(quantised(rows, scale)), pa.binary())], names=["key", "packed"])

    return written(kept.mapInArrow(quantise, f"key {vectors.schema[key].dataType.simpleString()}, packed binary"), "vectors")


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept row of ``vectors``."""
    spark = vectors.sparkSession
    kept = keep_vectors(vectors, key, vector, dims, scale)
    distinct = written(kept.groupBy("packed").agg(F.count("*").alias("n")), "distinct")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = kept.select(draw.alias("draw"), "packed").orderBy(F.asc_nulls_last("draw"), "packed").limit(k).collect()
    centroids = lloyd(distinct, unpack([bytes(r["packed"]) for r in first], dims).tolist(), rounds, dims)

    def assign(rows: dict[str, list]) -> dict[str, Sequence]:
        to, distance = nearest(unpack(rows["packed"], dims), centroids)
        return {"packed": rows["packed"], "n": rows["n"], "cluster": to.tolist(), "distance": [min(d, HIGHEST) for d in distance]}

    assigned = written(mapped(distinct, assign, "packed binary, n long, cluster int, distance long", 4096), "assigned")
    exact = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    sums = {r["cluster"]: (int(r["d"]), int(r["n"])) for r in assigned.groupBy("cluster").agg(F.sum(exact).alias("d"), F.sum("n").alias("n")).collect()}
    inertia, rows = sum(d for d, _ in sums.values()), sum(n for _, n in sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    schema = StructType([StructField("cluster", IntegerType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])
    told = spark.createDataFrame([(c, min(d, HIGHEST), min(inertia, HIGHEST), digests[c]) for c, (d, _) in sorted(sums.items())], schema)

    hot = F.col("n") * HOT_PARTS > rows  # fewer than HOT_PARTS vectors
    often = kept.join(F.broadcast(assigned.where(hot).select("packed", "cluster", "distance")), "packed", "left")
    rest = often.where(F.col("cluster").isNull()).select("packed", "key").join(assigned.where(~hot).select("packed", "cluster", "distance"), "packed")
    found = often.where(F.col("cluster").isNotNull()).unionByName(rest).join(F.broadcast(told), "cluster")
    return found.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all kept vectors of ``embeddings``."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    """Assignments and centroids of each round, one after another."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT vec_id, pos, v, c, list_sum(list_transform(list_zip(v, w), lambda x: CAST(x[1] - x[2] AS BIGINT) * (x[1] - x[2]))) AS d FROM k, c{r})")
        parts.append(f"a{r} AS (SELECT vec_id, pos, v, c, CAST(d AS BIGINT) AS d FROM d{r} QUALIFY row_number() OVER (PARTITION BY pos ORDER BY d, c) = 1)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))")
    return ",\n".join(parts)


SQL = f"""
WITH k AS (SELECT vec_id, row_number() OVER () AS pos, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INTEGER) AS c, v AS w FROM k ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS}),
{_rounds_sql()},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN i USING (c) JOIN c{ROUNDS} USING (c)
"""
