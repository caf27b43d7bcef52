"""Operator 5: toxicity by class-conditional Kneser-Ney models of words and of characters.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, have counts of their own at the
highest order and share the counts they back off to, so an expression that neither class knows well tells
nothing. There is such a pair for characters, of order ``ORDER``. For words there are two unigram models with
absolute discounting that back off to their shared shares, of all words of the sample. Of either, log-ratios within ``LEAST`` are taken as 0, so an entry of the models is off by less
than that. A text is judged by its
length-normalised log-likelihood ratios and by those of its most telling words; a logistic fit on
out-of-fold ratios turns them into a probability.

The models are fitted on a bounded sample of labelled rows: at most ``max_docs``, half of each class, chosen
by a hash of the key. Rows are scored whole, very long texts in blocks. Equal scores at the threshold count as
toxic. Null and empty texts get the score of a text that tells
nothing; rows without a key are scored and never learnt from; rows with several labels count as toxic if any
does. With no labelled rows of both classes every score is 0. Repeated rows get equal scores, an empty table
an empty result, and columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import HashLookup, code_points, free_name, give_back, mapped, remainder, written

ORDER, DISCOUNT, MAX_DOCS, THRESHOLD, SMOOTHING, LEAST = 5, 0.75, 12_000, 0.3, 0.5, 0.02
BASE = np.uint64(0x9E3779B97F4A7C15)


def hashed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            h = (h + rows[:, i].astype(np.uint64) + np.uint64(1)) * BASE
    return h


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-case text between single spaces; all but letters and digits are spaces."""
    x = code_points((text or "").lower())
    word = ((x >= 97) & (x <= 122)) | ((x >= 48) & (x <= 57)) | ((x >= 0xAA) & (x != 0xD7) & (x != 0xF7) & ~((x >= 0x2000) & (x <= 0x206F)) & ~((x >= 0x3000) & (x <= 0x303F)))
    x = np.where(word, x, np.uint32(32))
    keep = np.r_[True, word[1:] | word[:-1]] if len(x) else np.empty(0, bool)
    return np.r_[np.full(ORDER - 1, 32, np.uint32), x[keep], np.full(1, 32, np.uint32)].astype(np.uint32)


def windows(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, ORDER) if len(x) >= ORDER else np.empty((0, ORDER), np.uint32)


def shared_backoff(grams: np.ndarray) -> np.ndarray:
    """P(last | the ORDER - 2 before it) of each gram by continuation counts of all classes together."""
    levels, rows = [], grams
    for n in range(ORDER - 1, 0, -1):
        rows = rows[:, 1:]
        _, first, at, counts = np.unique(hashed(rows), return_index=True, return_inverse=True, return_counts=True)
        levels.append((rows[first], at, counts))
        rows = rows[first]
    p = None
    for n, (rows, _, counts) in zip(range(1, ORDER), reversed(levels)):
        if n == 1:
            p = (counts + 1) / (counts.sum() + len(counts) + 1)
            continue
        lower = levels[ORDER - n][1]  # where each type of this level lies in the level below
        _, context = np.unique(hashed(rows[:, :-1]), return_inverse=True)
        total, types = np.bincount(context, counts), np.bincount(context)
        p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * types[context] * p[lower]) / total[context]
    return p[levels[0][1]]


@dataclass
class Ratio:
    """log P(toxic) - log P(ordinary) of a symbol in its context."""

    grams: HashLookup
    contexts: HashLookup

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray) -> Ratio:
        """``grams`` are distinct rows of ORDER code points; ``counts`` are those in ordinary and in toxic texts."""
        if not len(grams):
            return cls(HashLookup(np.empty(0, np.uint64), np.empty(0)), HashLookup(np.empty(0, np.uint64), np.empty(0)))
        backoff = shared_backoff(grams)
        keys, context = np.unique(hashed(grams[:, :-1]), return_inverse=True)
        logs, rests = [], []
        for c in (0, 1):
            total = np.bincount(context, counts[:, c])
            types = np.bincount(context, counts[:, c] > 0)
            # A smoothing share of the backoff keeps contexts that a class has hardly seen near the shared model.
            rest = (DISCOUNT * types + SMOOTHING) / (total + SMOOTHING)
            p = (np.maximum(counts[:, c] - DISCOUNT, 0) + (DISCOUNT * types + SMOOTHING)[context] * backoff) / (total + SMOOTHING)[context]
            logs.append(np.log(p))
            rests.append(np.log(rest))
        rest, ratio = rests[1] - rests[0], logs[1] - logs[0]
        told = np.abs(ratio - rest[context]) > LEAST
        known = np.abs(rest) > LEAST
        return cls(HashLookup(hashed(grams)[told], ratio[told]), HashLookup(keys[known], rest[known]))

    def of(self, x: np.ndarray) -> np.ndarray:
        rows = windows(x)
        if not len(rows):
            return np.empty(0, np.float32)
        with np.errstate(over="ignore"):
            context = np.zeros(len(rows), np.uint64)
            for i in range(ORDER - 1):
                context = (context + rows[:, i].astype(np.uint64) + np.uint64(1)) * BASE
            values, found = self.grams.get((context + rows[:, ORDER - 1].astype(np.uint64) + np.uint64(1)) * BASE)
        odd = np.flatnonzero(~found)
        values[odd] = self.contexts.get(context[odd])[0]
        return values


@dataclass
class WordRatio:
    """log P(toxic) - log P(ordinary) of whole words, 0 for those that neither class has."""

    words: HashLookup

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> WordRatio:
        """``keys`` are distinct words' hashes; ``counts`` are those in ordinary and in toxic texts."""
        if not len(keys) or not counts.sum(0).all():
            return cls(HashLookup(np.empty(0, np.uint64), np.empty(0)))
        shared, logs = counts.sum(1) / counts.sum(), []
        for c in (0, 1):
            total, rest = counts[:, c].sum(), DISCOUNT * (counts[:, c] > 0).sum()
            # Over the backoff's share alone, which is what a word that the class lacks gets.
            logs.append(np.log((np.maximum(counts[:, c] - DISCOUNT, 0) / (rest * shared)) + 1) if total else np.zeros(len(keys)))
        ratio = logs[1] - logs[0]
        told = np.abs(ratio) > LEAST
        return cls(HashLookup(keys[told], ratio[told]))

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.words.get(keys)[0]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_keys(x: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of ``symbols``: sums of code points times powers, brought to the word's start."""
    ends = np.flatnonzero((x == 32) & (np.r_[np.uint32(32), x[:-1]] != 32))
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero((x != 32) & (np.r_[np.uint32(32), x[:-1]] == 32))
    out = []
    with np.errstate(over="ignore"):
        cut = np.searchsorted(ends, np.arange(block, len(x) + block, block))
        for a, b in zip(np.r_[0, cut[:-1]], cut):
            if b > a:
                lo, hi = starts[a], ends[b - 1]
                powers = np.cumprod(np.r_[np.uint64(1), np.full(hi - lo, BASE, np.uint64)])
                sums = np.r_[np.uint64(0), np.cumsum((x[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[:-1])]
                back = np.cumprod(np.r_[np.uint64(1), np.full(hi - lo, INVERSE, np.uint64)])
                out.append((sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * back[starts[a:b] - lo])
    return np.concatenate(out)


FEATURES = 9


def highest(x: np.ndarray) -> list[float]:
    """The three highest values, 0 where there are fewer or none above it."""
    top = np.partition(x, len(x) - 3)[-3:] if len(x) > 3 else x
    top = np.sort(np.maximum(top, 0))[::-1]
    return [*map(float, top), *[0.0] * (3 - len(top))]


def features(models: tuple[Ratio, WordRatio], text: str | None, block: int = 1 << 20) -> list[float]:
    """Mean ratio a symbol and a word, the three highest of words by either model, and log words."""
    ratio, whole = models
    x = symbols(text)
    r = np.concatenate([ratio.of(x[at : at + block + ORDER - 1]) for at in range(0, max(1, len(x) - ORDER + 1), block)])
    ends = np.flatnonzero(x[ORDER - 1 :] == 32)
    if len(r) < 2 or not len(ends):
        return [0.0] * FEATURES
    words = np.diff(np.r_[0.0, np.cumsum(r, dtype=np.float64)[ends]])
    told = whole.of(word_keys(x))
    return [float(r.mean()), *highest(words), float(np.log1p(len(words))), float(told.mean()) if len(told) else 0.0, *highest(told)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients (the intercept last) of a weighted, lightly penalised logistic fit."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), penalty * len(x) * np.r_[np.ones(z.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


@dataclass
class ToxicityModel:
    models: tuple[Ratio, WordRatio]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = (np.array(features(self.models, text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30))))


def count_grams(rows: dict[str, list]) -> dict[str, Sequence]:
    """Grams (code points) and words (hashes) by class and fold, with counts, of a batch of labelled rows."""
    out: dict[str, list] = {"gram": [], "toxic": [], "fold": [], "n": []}
    parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for text, toxic, fold in zip(rows["text"], rows["toxic"], rows["fold"]):
        x = symbols(text)
        parts.setdefault((toxic, fold), []).append((windows(x), word_keys(x)))
    for (toxic, fold), found in parts.items():
        grams = np.concatenate([g for g, _ in found])
        _, first, n = np.unique(hashed(grams), return_index=True, return_counts=True)
        keys, m = np.unique(np.concatenate([k for _, k in found]), return_counts=True)
        out["gram"] += [g.tobytes() for g in grams[first]] + [k.tobytes() for k in keys]
        out["n"] += [*n.tolist(), *m.tolist()]
        out["toxic"] += [toxic] * (len(n) + len(m))
        out["fold"] += [fold] * (len(n) + len(m))
    return out


def joined_bytes(values: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, one after another."""
    parts = []
    for c in values.chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[c.offset] : ends[c.offset + len(c)]])
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicityModel | None:
    """A model fitted on at most about ``max_docs`` of the rows of ``docs`` that ``labels`` covers; None without both classes."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    span = 1 << 20
    share = {c: min(1.0, max_docs / 2 / n) for c, n in sizes.items()}
    draw = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(span))
    chosen = named.where(draw < F.when(F.col("toxic") == 1, share[1] * span).otherwise(share[0] * span))
    # At most max_docs rows, but for chance, whatever the input's size: of the rows of one key the one of the least hash.
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key, "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = found.select("text", "toxic", F.pmod(F.xxhash64(key, F.lit(9)), F.lit(2)).cast("int").alias("fold"))
    sample = written(sample, "labelled")
    counted = mapped(sample, count_grams, "gram binary, toxic int, fold int, n long").groupBy("gram").agg(*[F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{c}{f}") for c in (0, 1) for f in (0, 1)])
    table = counted.toArrow()
    if not table.num_rows:
        return None
    is_word = pc.equal(pc.binary_length(table.column("gram")), 8).to_numpy()
    grams = joined_bytes(table.column("gram").filter(pa.array(~is_word))).view(np.uint32).reshape(-1, ORDER)
    keys = joined_bytes(table.column("gram").filter(pa.array(is_word))).view(np.uint64)
    n = {(c, f): table.column(f"n{c}{f}").to_numpy().astype(np.float64) for c in (0, 1) for f in (0, 1)}

    def fitted(folds: tuple[int, ...]) -> tuple[Ratio, WordRatio]:
        counts = np.stack([sum(n[c, f] for f in folds) for c in (0, 1)], 1)
        seen = counts.sum(1) > 0
        return Ratio.fit(grams[seen[~is_word]], counts[seen & ~is_word]), WordRatio.fit(keys[seen[is_word]], counts[seen & is_word])

    others = {0: fitted((1,)), 1: fitted((0,))}
    told = mapped(sample, lambda r: {"x": [features(others[f], t) for t, f in zip(r["text"], r["fold"])], "toxic": r["toxic"]}, "x array<double>, toxic int").collect()
    if len({r["toxic"] for r in told}) < 2:
        return None
    y = np.array([r["toxic"] for r in told], float)
    mean, scale, w = logistic(np.array([r["x"] for r in told]), y, np.where(y == 1, 1 / share[1], 1 / share[0]) * min(share.values()))
    return ToxicityModel(fitted((0, 1)), mean, scale, w)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``, the probability that a text is toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(texts):
        give_back()
        return texts.map(model.score)

    return docs.withColumn(name, score(F.col(text)))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel | None:
    """The model of the labels whose key's crc32 modulo 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    return fit_toxicity(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), trained(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose toxicity reaches the threshold."""
    name = free_name(docs, "_tidemark_toxicity")
    return score_toxicity(docs, trained(spark, docs, sf_dir), name=name).where(F.col(name) < threshold).drop(name)
