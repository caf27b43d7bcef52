"""Operator 7: likelihood of texts under a subword lattice.

The vocabulary and its order come from an existing unigram file. Piece probabilities start from the order
and are fitted to the training texts by expectation maximisation over the lattice of each distinct word. A
text's probability is that of all its segmentations into pieces, then the end: forward recursion in log
space. Pieces do not cross words, so the recursion runs once for each distinct word of the corpus.

Word counts are summed over all training texts. Words that make up a ``1 / hot`` share of all words or more
(at most ``hot`` of them) go to all tasks as a table; the others are joined by word, packed by the word's
occurrences within a task, so no key holds much. Nothing that grows with the corpus reaches the driver.

A row's sums meet in a bucket of its hash, about ``BUCKET_ROWS`` rows each. Very long words are scored one at a
time, very long texts as the words they have. Null texts are empty: one token, the end. Rows are told apart by key and text; equal rows are scored once
and returned as often as they occur. Rows without a key count as the empty key for the held-out split. An
empty table gives an empty result, and columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import lower_bytes, mapped, mix, pieces, remainder, written
from tidemark.llm.vocabulary import MODEL_PATH, SPACE, BatchLattice, load_vocabulary

HOT, ROUNDS, BUCKET_ROWS = 100_000, 4, 1_000_000
PAIR = np.dtype([("id", "<i8"), ("tag", "<u4"), ("n", "<u4")])
SUM = np.dtype([("id", "<i8"), ("tag", "<i8"), ("copies", "<i8"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def row_id(key: int | None, text: str | None) -> tuple[int, int]:
    """What tells a row from others: its key and 31 bits of its text's hash, or 95 bits of that without a key."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tag = xxhash.xxh32_intdigest(data) & 0xFFFFFFFE
    if key is None:
        return xxhash.xxh64_intdigest(data) - (1 << 63), tag | 1
    return key, tag


def count_words(docs: DataFrame, room: int = 300_000) -> DataFrame:
    """(word, c, n) with c over rows whose ``train`` is true and n over all rows; the null word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, other = Counter(), Counter()  # a word counts in one of them, so no text is counted twice

        def flush() -> pa.RecordBatch:
            words = [*learnt, *[w for w in other if w not in learnt]]
            c = [learnt.get(w, 0) for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([n + other.get(w, 0) for w, n in zip(words, c)], pa.int64())], names=["word", "c", "n"])
            learnt.clear()
            other.clear()
            return out

        for batch in batches:
            for part in pieces(batch):
                for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts = learnt if train else other
                    counts.update(lower_bytes(text).split())
                    counts[None] += 1
                    if max(len(learnt), len(other)) > room:
                        yield flush()
        if learnt or other:
            yield flush()

    return docs.select("text", "train").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, lattice: BatchLattice, rounds: int = ROUNDS, prior: float = 0.1) -> np.ndarray:
    """Log-probabilities of the pieces after ``rounds`` of expectation maximisation over all training words."""
    vocabulary = lattice.vocabulary
    logp = vocabulary.logp
    known = words.where("c > 0")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(now))
            for batch in batches:
                found, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
                ends = np.array([w is None for w in found], bool)
                counts[vocabulary.end_id] += c[ends].sum()
                lattice.add_expected([SPACE + w.decode("utf-8", "surrogatepass") for w in found if w is not None], c[~ends], now, counts)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["piece", "n"])

        # A row a piece at most: the vocabulary's size, whatever the corpus.
        found = known.select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.where(np.isfinite(vocabulary.logp), prior, 0.0)
        for r in found:
            counts[r["piece"]] += r["n"]
        with np.errstate(divide="ignore"):
            logp = np.log(counts / counts.sum())
    return logp


def compact(records: list[np.ndarray]) -> np.ndarray:
    """One record a row id, the others added to it."""
    x = np.concatenate(records) if records else np.empty(0, SUM)
    x = x[np.lexsort((x["tag"], x["id"]))]
    first = np.flatnonzero(np.r_[True, (x["id"][1:] != x["id"][:-1]) | (x["tag"][1:] != x["tag"][:-1])]) if len(x) else np.empty(0, np.int64)
    out = x[first].copy()
    for name in SUM.names[2:]:
        out[name] = np.add.reduceat(x[name], first) if len(x) else x[name]
    return out


def dealt(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records packed by bucket of their id: a row a bucket, however many there are."""
    place = ((mix(records["id"].view(np.uint64) ^ mix(records["tag"].astype(np.uint64))) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    records, place = records[order], place[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    parts = np.split(records, first[1:]) if len(first) else []
    return pa.RecordBatch.from_arrays([pa.array(place[first], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "records"])


def score_texts(docs: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """Token counts, base score and lattice score (log10) of each row of ``docs``, learnt from rows where ``train``."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    lattice = BatchLattice(load_vocabulary(model_path))
    counted = written(count_words(rows), "words")
    logp = fit_pieces(counted, lattice, rounds)
    end_logp = logp[lattice.vocabulary.end_id] / math.log(10)

    def weigh(r: dict[str, list]) -> dict[str, list]:
        told = np.full(len(r["word"]), end_logp)
        told[[w is not None for w in r["word"]]] = lattice.marginals([SPACE + w.decode("utf-8", "surrogatepass") for w in r["word"] if w is not None], logp) / math.log(10)
        return {"word": r["word"], "c": r["c"], "n": r["n"], "lp": told.tolist()}

    words = written(mapped(counted, weigh, "word binary, c long, n long, lp double", 10_000), "word-scores")
    ends = [F.max(F.when(F.col("word").isNull(), F.col(x))) for x in ("c", "n")]
    tokens, distinct, everything, end_c, n_rows = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("n"), *ends).first()
    tokens, distinct, everything, end_c = tokens or 0, distinct or 0, everything or 0, end_c or 0
    unit = math.log10(tokens + (distinct + 1))
    # At most ``hot`` words can have a share of 1 / hot.
    common = words.where(F.col("word").isNotNull() & (F.col("n") * hot >= everything)).select("word", "c", "lp").toArrow()
    common_c, common_lp = common.column("c").to_numpy(), common.column("lp").to_numpy()
    # Each common word's place in the columns of what it adds; the last row is for all other words.
    table = {w: i for i, w in enumerate(common.column("word").to_pylist())}
    adds = np.zeros((3, len(table) + 1))
    adds[:, : len(table)] = common_c > 0, np.log10(common_c + 1) - unit, common_lp
    shared = docs.sparkSession.sparkContext.broadcast((table, adds))
    end = (int(end_c > 0), math.log10(end_c + 1) - unit, end_logp)

    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_rows or 0) // BUCKET_ROWS)

    def common_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, added = shared.value
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = lower_bytes(t).split()
                known, base, score = added[:, np.fromiter(map(hot_words.get, words, repeat(len(hot_words))), np.int64, len(words))].sum(1).tolist()
                out.append((*row_id(k, t), 1, len(words) + 1, int(known) + end[0], base + end[1], score + end[2]))
            if out:
                yield dealt(compact([np.array(out, SUM)]), buckets)

    def pack(batches: Iterator[pa.RecordBatch], room: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        hot, held, size = shared.value[0].__contains__, {}, 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(map(b"".join, held.values())), pa.binary())], names=["word", "rows"])
            held.clear()
            return out

        for batch in batches:
            for part in pieces(batch):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    i, tag = row_id(k, t)
                    head = i.to_bytes(8, "little", signed=True) + tag.to_bytes(4, "little")
                    once = head + (1).to_bytes(4, "little")
                    rare = Counter(filterfalse(hot, lower_bytes(t).split()))
                    for w, n in rare.items():
                        pair = once if n == 1 else head + n.to_bytes(4, "little")
                        if w in held:
                            held[w].append(pair)
                        else:
                            held[w] = [pair]
                    size += len(rare)
                    if size > room:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def unpack(batches: Iterator[pa.RecordBatch], room: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, c, lp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out = np.zeros(len(pairs), SUM)
            out["id"], out["tag"], n = pairs["id"], pairs["tag"], pairs["n"].astype(np.int64)
            out["n_known"], out["base"], out["score"] = n * (c > 0), n * (np.log10(c + 1) - unit), n * lp
            return dealt(compact([out]), buckets)

        for batch in batches:
            for part in pieces(batch, 4096):
                found = part.column(0).to_pylist()
                sizes = np.array([len(x) for x in found]) // PAIR.itemsize
                held.append((np.frombuffer(b"".join(found), PAIR), np.repeat(part.column(1).to_numpy(), sizes), np.repeat(part.column(2).to_numpy(), sizes)))
                size += int(sizes.sum())
                if size > room:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch], room: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                held.append(np.frombuffer(data.as_py(), SUM))
                size += len(held[-1])
                if size > room:  # what is left is a record a row of this partition
                    held = [compact(held)]
                    size = 0
        whole = compact(held)
        for at in range(0, len(whole), 10_000):
            x = whole[at : at + 10_000]
            each = np.repeat(np.arange(len(x)), x["copies"])
            n = x["copies"][each]
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (x["id"][each], x["tag"][each], x["n_tokens"][each] // n, x["n_known"][each] // n, x["base"][each] / n, x["score"][each] / n)], names=["id", "tag", "n_tokens", "n_known", "base", "score"])

    sums = rows.select("key", "text").mapInArrow(common_sums, "bucket int, records binary")
    packed = rows.select("key", "text").mapInArrow(pack, "word binary, rows binary")
    rare = packed.join(words.select("word", "c", "lp").hint("shuffle_merge"), "word").select("rows", "c", "lp").mapInArrow(unpack, "bucket int, records binary")
    whole = sums.unionByName(rare).repartitionById(buckets, "bucket").select("records").mapInArrow(merge, "id long, tag long, n_tokens long, n_known long, base double, score double")
    return whole.select(F.when(F.col("tag") % 2 == 0, F.col("id")).cast(kind).alias(key), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of ``documents``."""
    held_out = remainder("doc_id", 7) == 2
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
