"""Operator 12: ranked lexical search, score-at-a-time over impact-ordered postings.

Documents are dealt to shards as they lie, some thousands each, and a shard's postings are grouped by term and by
exact impact, highest first; nothing is shuffled for it. The index is a table of the shared folder with a row a
shard. A search takes a shard's segments in descending order of what they add to a query's score. What each list
may still add bounds every document's remaining gain: when no document without a score can reach the k-th best
found so far, and few others can, the rest is left unread and the scores of those others are completed from the
shard's postings by document. So the k best are exact, ties included. A task carries each query's k-th best score
from shard to shard, and only k rows a query and task are shuffled.

Scores are whole numbers. A term is a run of digits, letters and all beyond ASCII, with A-Z in lower case; the
index holds the terms that any query has. Documents without terms (null and empty texts too) are in no result and
don't count in N. Queries without terms, or with terms that no document has, have no result. Queries that share
an id, or have none, are one query with the terms of all of them. Rows that share a key are documents of their
own; missing keys come last among equal scores. Texts are read whole, a row at a time. Empty tables give an empty
result, and columns other than key and text are not read.

Queries pass through the driver in blocks of at most ``BLOCK_TERMS`` distinct terms, or one query if it has more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.shared import written

TOP, BLOCK_TERMS = 10, 200_000
SHARD_DOCS, SHARD_POSTINGS, STEP, MANY = 8192, 2_000_000, 0.7, 64
SCALE, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75
#: Bytes as they are read: A-Z in lower case, digits, a-z and bytes beyond ASCII as they are, all others as gaps.
_READ = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_READ).split()


@dataclass
class Block:
    """Some queries: their ids, and by query the numbers of its terms with repeats."""

    ids: list
    terms: list[Counter]
    vocabulary: dict[bytes, int]


def query_blocks(queries: DataFrame, key: str, text: str, most: int) -> Iterator[Block]:
    """The queries in blocks of bounded vocabulary; the driver holds one block at a time."""
    ids: dict = {}
    words: dict[bytes, int] = {}
    for row in queries.select(F.col(key).alias("key"), F.col(text).alias("text")).orderBy("key").toLocalIterator():
        found = Counter(terms_of(row["text"]))
        if not found:
            continue
        if ids and row["key"] not in ids and len(words) + len(found) > most:
            yield Block(list(ids), list(ids.values()), words)
            ids, words = {}, {}
        query = ids.setdefault(row["key"], Counter())
        for term, n in found.items():
            query[words.setdefault(term, len(words))] += n
    if ids:
        yield Block(list(ids), list(ids.values()), words)


def count_terms(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row a shard: documents with their lengths and, by document, the numbers and counts of their terms.

    ``docs`` counts documents that have a term, ``words`` their terms. Listed are documents with a term of the vocabulary.
    """
    kind = docs.schema[key].dataType
    fields = [("keys", pa.list_(to_arrow_type(kind))), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.int64()), ("words", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def new() -> dict:
            return {"keys": [], "lengths": [], "ends": [], "terms": [], "counts": [], "docs": 0, "words": 0}

        shard = new()
        for batch in batches:
            keys = batch.column("key")
            for i, value in enumerate(batch.column("text")):
                words = terms_of(value.as_py())
                if not words:
                    continue
                shard["docs"] += 1
                shard["words"] += len(words)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                if found:
                    shard["keys"].append(keys[i].as_py())
                    shard["lengths"].append(len(words))
                    shard["terms"] += found.keys()
                    shard["counts"] += found.values()
                    shard["ends"].append(len(shard["terms"]))
                    if len(shard["keys"]) >= SHARD_DOCS or len(shard["terms"]) >= SHARD_POSTINGS:
                        yield pa.RecordBatch.from_pylist([shard], schema=schema)
                        shard = new()
        if shard["docs"]:
            yield pa.RecordBatch.from_pylist([shard], schema=schema)

    ddl = f"keys array<{kind.simpleString()}>, lengths array<bigint>, ends array<int>, terms array<int>, counts array<bigint>, docs bigint, words bigint"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, ddl)


def flat(column: pa.Array, i: int) -> np.ndarray:
    """One row of a list column as an array."""
    return column[i].values.to_numpy(zero_copy_only=False)


def impacts_of(tf: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A term's impact in a document of ``length`` terms, rounded down; ``docs`` and ``words`` are of the collection."""
    sizes, at = np.unique(length, return_inverse=True)
    norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // words for n in sizes.tolist()], np.int64)[at]
    return (SCALE * tf) // (TF_WEIGHT * tf + LENGTH_WEIGHT * norm)


def order_by_impact(counted: DataFrame, docs: int, words: int) -> DataFrame:
    """The index: a row a shard, with postings by term and descending impact, and the same postings by document.

    ``list_terms`` and ``list_ends`` name the lists and where each ends among the segments, ``impacts`` and
    ``segment_ends`` the segments of equal impact and where each ends among the ``postings``, which are places of
    documents in ``keys``. ``doc_ends``, ``doc_terms`` and ``doc_impacts`` hold the postings by document.
    """
    key = counted.schema["keys"].dataType.simpleString()
    ddl = f"keys {key}, list_terms array<int>, list_ends array<int>, impacts array<bigint>, segment_ends array<int>, postings array<int>, doc_ends array<int>, doc_terms array<int>, doc_impacts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = {n: c for n, c in zip(batch.schema.names, batch.columns)}
                ends, terms, counts = (flat(column[n], i) for n in ("ends", "terms", "counts"))
                doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
                impact = impacts_of(counts, flat(column["lengths"], i)[doc], docs, words)
                order = np.lexsort((doc, -impact, terms))
                t, x = terms[order], impact[order]
                segment = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (x[1:] != x[:-1])]) if len(t) else np.empty(0, np.int64)
                lists = np.flatnonzero(np.r_[True, t[segment][1:] != t[segment][:-1]]) if len(t) else np.empty(0, np.int64)
                out = [t[segment][lists], np.r_[lists[1:], len(segment)] if len(lists) else lists, x[segment], np.r_[segment[1:], len(t)] if len(segment) else segment, doc[order], ends, terms, impact]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                columns = [column["keys"].slice(i, 1), *(pa.ListArray.from_arrays(pa.array([0, len(o)], pa.int32()), pa.array(o, k)) for o, k in zip(out, kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in ddl.split(", ")])

    return counted.where(F.size("keys") > 0).mapInArrow(run, ddl)


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.__dict__ |= row
        self.lists = {t: i for i, t in enumerate(self.list_terms.tolist())}
        self.list_starts = np.r_[0, self.list_ends[:-1]]
        self.segment_starts = np.r_[0, self.segment_ends]
        self.by_posting = np.repeat(self.impacts, np.diff(self.segment_starts))
        self.falling = -self.impacts
        self.scores = np.zeros(len(self.doc_ends), np.int64)

    def search(self, weights: dict[int, int], dense: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that may be among the ``k`` best, given the best scores so far.

        ``weights`` are by term; ``dense`` has room for a weight a term and is left as it was, all zeros.
        """
        lists = [(w, i) for t, w in weights.items() if w and (i := self.lists.get(t)) is not None]
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not lists:
            return none
        weight = np.array([w for w, _ in lists])
        at = np.array([self.list_starts[i] for _, i in lists])
        end = np.array([self.list_ends[i] for _, i in lists])
        floor = int(best.min()) if len(best) >= k else 0
        if int((weight * self.impacts[at]).sum()) < floor:
            return none  # no document of the shard can reach the k-th best
        scores = self.scores
        scores[:] = 0
        while True:
            open_ = at < end
            heads = np.where(open_, weight * self.impacts[np.minimum(at, end - 1)], 0)
            rest = int(heads.sum())  # no document can gain more from what is unread
            if not rest:
                break
            if rest < floor and np.count_nonzero((scores > 0) & (scores + rest >= floor)) <= MANY + k:
                break
            level = max(1, int(heads.max() * STEP))
            for j in np.flatnonzero(heads >= level).tolist():
                w, a, e = int(weight[j]), int(at[j]), int(end[j])
                b = a + int(np.searchsorted(self.falling[a:e], -(-(-level // w)), side="right"))  # segments that add the level or more
                p, q = self.segment_starts[a], self.segment_starts[b]
                scores[self.postings[p:q]] += w * self.by_posting[p:q]
                at[j] = b
            seen = scores[scores > floor]
            if len(seen) + len(best) >= k:
                both = np.concatenate([seen, best])
                floor = max(floor, int(np.partition(both, len(both) - k)[len(both) - k]))
        found = np.flatnonzero((scores > 0) & (scores + rest >= floor))
        if rest and len(found):
            starts, stops = np.where(found > 0, self.doc_ends[found - 1], 0), self.doc_ends[found]
            sizes = stops - starts
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
            for t, w in weights.items():
                dense[t] = w
            gains = dense[self.doc_terms[places]] * self.doc_impacts[places]
            for t in weights:
                dense[t] = 0
            whole = np.add.reduceat(gains, np.cumsum(sizes) - sizes)
        else:
            whole = scores[found]
        keep = whole >= max(floor, 1)
        return found[keep], whole[keep]


def best_of(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The ``k`` highest (score, key), equal scores by ascending key, missing keys last."""
    if len(found) > k:
        least = sorted((s for s, _ in found), reverse=True)[k - 1]
        found = [f for f in found if f[0] >= least]
    some, rest = [f for f in found if f[1] is not None], [f for f in found if f[1] is None]
    return sorted([*sorted(some, key=lambda f: f[1]), *rest], key=lambda f: -f[0])[:k]


def search_index(index: DataFrame, block: Block, weights: list[dict[int, int]], k: int, item: str, item_kind: str) -> DataFrame:
    """(item, key, score): at least the ``k`` best documents of each query, from each task."""
    kind = index.schema["keys"].dataType.elementType
    size = len(block.vocabulary)
    names = [n for n in index.columns if n != "keys"]
    schema = pa.schema([("item", pa.int32()), ("key", to_arrow_type(kind)), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size, np.int64)
        best: list[list[tuple[int, object]]] = [[] for _ in weights]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({n: flat(batch.column(n), i) for n in names})
                keys = batch.column("keys")[i].values
                for q, of in enumerate(weights):
                    places, scores = shard.search(of, dense, k, np.array([s for s, _ in best[q]], np.int64))
                    if len(places):
                        if len(places) > k:  # ties stay
                            least = np.partition(scores, len(scores) - k)[len(scores) - k]
                            places, scores = places[scores >= least], scores[scores >= least]
                        best[q] = best_of(best[q] + list(zip(scores.tolist(), keys.take(pa.array(places)).to_pylist())), k)
        told = [(q, key, s) for q, rows in enumerate(best) for s, key in rows]
        yield pa.RecordBatch.from_arrays([pa.array([t[j] for t in told], f.type) for j, f in enumerate(schema)], schema=schema)

    found = index.mapInArrow(run, f"item int, key {kind.simpleString()}, score bigint")
    ids = index.sparkSession.createDataFrame([(q, i) for q, i in enumerate(block.ids)], f"item int, id {item_kind}")
    return found.join(F.broadcast(ids), "item").select("item", "id", "key", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """Item id, rank, key and score of the ``k`` highest-scoring rows of ``docs`` for each query."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), queries.schema[item].dataType.simpleString()
    out = None
    for block in query_blocks(queries, item, item_text, BLOCK_TERMS):
        counted = written(count_terms(docs, key, text, block.vocabulary), "terms")
        total = counted.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        n, words = total["docs"] or 0, total["words"] or 0
        held = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
        weights = [{t: c * weight[t] for t, c in terms.items() if weight.get(t)} for terms in block.terms]
        index = written(order_by_impact(counted, n, words), "impacts")
        found = search_index(index, block, weights, k, item, item_kind)
        # What tasks found is cut to k rows in parts of a query first, so that no query's rows meet in one task.
        order = [F.desc("score"), F.asc_nulls_last("key")]
        part = F.pmod(F.xxhash64("key", "score"), F.lit(64))
        near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], f"`{item}` {item_kind}, rank int, `{key}` {kind}, score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each ``benchmark`` item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS pos, {_TERMS} AS t FROM documents),
g AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, pos, n, term, count(*) AS tf FROM (SELECT doc_id, pos, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, pos, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, pos, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * g.n) // g.l)))) AS score FROM p JOIN q USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id, pos)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= {TOP}
"""
