"""Operator 11: document quality by a regularised quadratic discriminant.

A text is described by transformed statistics of its characters, words and lines (``STATISTICS``), each bounded
or a logarithm. Each class has a mean and a covariance of them, which is shrunk towards that of both classes and
towards a multiple of the unit matrix. A text's log-density difference is that of two Mahalanobis distances, each
by the class's inverse Cholesky factor, which is kept with the model. A logistic curve over the difference turns
it into a probability.

Moments are summed over all labelled rows, by class and by fold, so a fit has one row a moment at the driver
however many rows there are. The amounts of shrinkage and the curve are chosen by likelihood on out-of-fold
differences, which are counted in bins. Rows with equal statistics (copies, for one) are in one fold.

Every text is read whole, in blocks of about ``BLOCK`` characters. Null and empty texts have the statistics of
no words and are scored by these. Rows without a key are scored and never learnt from; of rows with several
labels the lowest counts. With labels of one class only, every score is that class; without any, 0.5. Equal texts
get equal scores, and a score equal to the threshold predicts 1. An empty table gives an empty result, and columns
other than key and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import mapped, pieces, remainder, written

THRESHOLD, FOLDS, BLOCK = 0.7, 5, 1 << 20
STATISTICS = (
    "log words", "log mean word length", "spread of word lengths", "log longest word", "upper case of ASCII letters", "words that begin in upper case", "digits", "stops a word",
    "exclamations a word", "bars and brackets a word", "other symbols", "words that end in a symbol", "words without a letter", "space", "log lines", "words equal to the one before",
    "share of the commonest word", "distinct words", "repeated lines", "entropy of bytes", "beyond ASCII",
)
#: Shrinkage towards both classes' covariance and towards a multiple of the unit matrix, of which the likeliest pair is taken.
TO_POOLED, TO_UNIT = (0.0, 0.1, 0.5), (0.001, 0.02, 0.2)
#: Bins of sign(d) * log(1 + |d|) for a log-density difference d.
BINS, WIDTH = 400, 0.1

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _OTHER, _LEAD, _TRAIL = range(10)


def _kinds() -> np.ndarray:
    """The kind of each byte of UTF-8."""
    out = np.full(256, _OTHER, np.uint8)
    out[65:91], out[97:123], out[48:58] = _UPPER, _LOWER, _DIGIT
    out[9:14], out[32], out[192:], out[128:192] = _SPACE, _SPACE, _LEAD, _TRAIL
    for kind, signs in ((_STOP, b".,;:'\"-"), (_SHOUT, b"!?"), (_BAR, b"|[]{}()<>_")):
        out[list(signs)] = kind
    return out


KINDS = _kinds()
LETTERS, SIGNS = (_UPPER, _LOWER, _LEAD, _TRAIL), (_SHOUT, _BAR, _OTHER)


def blocks(text: str) -> Iterator[str]:
    """Parts of a text, cut where a space stands or, in a word of more than ``BLOCK`` characters, within it."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(" ", at, at + BLOCK), text.rfind("\n", at, at + BLOCK))
        cut = cut + 1 if cut > at else at + BLOCK
        yield text[at:cut]
        at = cut
    yield text[at:]


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a text."""
    byte_counts, kinds = np.zeros(256, np.int64), np.zeros(10, np.int64)
    words: Counter = Counter()
    lines: Counter = Counter()
    n = same = capital = signed = bare = longest = 0
    total = squares = 0.0
    last = None
    for part in blocks(text or ""):
        raw = part.encode("utf-8", "surrogatepass")
        x = np.frombuffer(raw, np.uint8)
        byte_counts += np.bincount(x, minlength=256)
        k = KINDS[x]
        space = k == _SPACE
        edges = np.diff(np.r_[True, space, True].astype(np.int8))
        starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        found = raw.split()
        if not len(starts):
            continue
        before = lambda of: np.r_[0, np.cumsum(of)]
        within = lambda of: (c := before(of))[stops] - c[starts]
        length = within(k != _TRAIL)
        n += len(starts)
        total, squares, longest = total + float(length.sum()), squares + float((length.astype(np.float64) ** 2).sum()), max(longest, int(length.max()))
        capital += int((k[starts] == _UPPER).sum())
        signed += int(np.isin(k[stops - 1], SIGNS).sum())
        bare += int((within(np.isin(k, LETTERS)) == 0).sum())
        same += sum(map(eq, found, found[1:])) + (found[0] == last)
        last = found[-1]
        words.update(found)
        lines.update(line for line in part.split("\n") if line.strip())
    if n:
        kinds += np.bincount(KINDS, byte_counts, 10).astype(np.int64)
    chars = max(1, int(kinds.sum() - kinds[_TRAIL]))
    each, line_count = max(1, n), sum(lines.values())
    share = byte_counts[byte_counts > 0] / max(1, byte_counts.sum())
    mean = total / each
    root = lambda a, b: float(np.sqrt(a / max(1, b)))
    return [
        float(np.log1p(n)), float(np.log1p(mean)), float(np.log1p(np.sqrt(max(0.0, squares / each - mean * mean)))), float(np.log1p(longest)), root(kinds[_UPPER], kinds[_UPPER] + kinds[_LOWER]), root(capital, n),
        root(kinds[_DIGIT], chars), min(2.0, root(kinds[_STOP], n)), min(2.0, root(kinds[_SHOUT], n)), min(2.0, root(kinds[_BAR], n)), root(kinds[_OTHER], chars), root(signed, n), root(bare, n), root(kinds[_SPACE], chars),
        float(np.log1p(100 * line_count / each)), root(same, n), root(max(words.values(), default=0), n), float(np.log1p(len(words)) / max(0.7, np.log1p(n))), root(line_count - len(lines), line_count),
        float(-(share * np.log(share)).sum()), root(kinds[_LEAD], chars),
    ]


@dataclass
class Discriminant:
    """A mean, an inverse Cholesky factor of the shrunk covariance and its half log-determinant for each class."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    halves: list[float]
    slope: float = 1.0
    intercept: float = 0.0

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float, to_unit: float) -> Discriminant:
        """From the moments of classes 0 and 1."""
        means = [s / max(c, 1) for c, s in zip(counts, sums)]
        scatters = [p - c * np.outer(m, m) for c, p, m in zip(counts, products, means)]
        pooled = sum(scatters)
        scale = np.sqrt(np.maximum(np.diag(pooled) / counts.sum(), 1e-4))  # of both classes, so that units don't matter
        factors, halves = [], []
        for c, scatter in zip(counts, scatters):
            cov = ((1 - to_pooled) * scatter + to_pooled * pooled) / ((1 - to_pooled) * c + to_pooled * counts.sum()) / np.outer(scale, scale)
            cov = (1 - to_unit) * cov + to_unit * max(1e-3, float(np.trace(cov)) / len(cov)) * np.eye(len(cov))
            lower = np.linalg.cholesky((cov + cov.T) / 2)
            factors.append(np.linalg.inv(lower) / scale)
            halves.append(float(np.log(np.diag(lower)).sum()))
        return cls(means, factors, halves)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 less that under class 0, by row."""
        ways = [h + 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, h in zip(self.means, self.factors, self.halves)]
        return ways[0] - ways[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(self.difference(x)) + self.intercept, -30, 30)))


def squeezed(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def curve(z: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Slope, intercept and log-loss of a logistic curve over ``z``; ``counts`` are of class 0 and of class 1."""
    x, n, w = np.c_[z, np.ones(len(z))], counts.sum(0), np.zeros(2)
    p = np.full(len(z), 0.5)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([0.5, 1e-6]), x.T @ (n * p - counts[1]) + np.array([0.5, 1e-6]) * w)
        w = w - step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0]), float(w[1]), float(-(counts[1] * np.log(p) + counts[0] * np.log(1 - p)).sum())


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of each row's whole text."""
    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), lambda r: {"key": r["key"], "x": [statistics(t) for t in r["text"]]}, f"key {kind}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def moments(labelled: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """By class and fold the count, the sums and the products of the statistics, one after another."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, fold = matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for c, f in {*zip(y.tolist(), fold.tolist())}:
                rows = x[(y == c) & (fold == f)]
                found[c, f] = found.get((c, f), 0) + np.concatenate([[len(rows)], rows.sum(0), (rows.T @ rows).ravel()])
        told = [(c, f, v.tolist()) for (c, f), v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.int32()), pa.array([t[2] for t in told], pa.list_(pa.float64()))], names=["label", "fold", "v"])

    parts = labelled.mapInArrow(add, "label int, fold int, v array<double>").select("label", "fold", F.posexplode("v").alias("place", "v"))
    out: dict[tuple[int, int], np.ndarray] = {}
    size = 1 + len(STATISTICS) + len(STATISTICS) ** 2
    for r in parts.groupBy("label", "fold", "place").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r["label"], r["fold"]), np.zeros(size))[r["place"]] = r["v"]
    return out


def fitted(found: dict[tuple[int, int], np.ndarray], without: int, to_pooled: float, to_unit: float) -> Discriminant | None:
    """A discriminant of all folds but one; None where a class has no rows there."""
    d = len(STATISTICS)
    both = [sum((v for (c, f), v in found.items() if c == k and f != without), np.zeros(1 + d + d * d)) for k in (0, 1)]
    if not all(b[0] for b in both):
        return None
    return Discriminant.fit(np.array([b[0] for b in both]), np.array([b[1 : d + 1] for b in both]), np.array([b[d + 1 :].reshape(d, d) for b in both]), to_pooled, to_unit)


def fit_quality(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant | float:
    """A discriminant fitted on all rows of ``described`` that ``labels`` covers, or the one score that they allow."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min((F.col(label) > 0).cast("int")).alias("label"))
    labelled = written(described.join(named, "key").select("x", "label", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    found = moments(labelled)
    classes = {c for c, _ in found}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.5
    pairs = [(a, b) for a in TO_POOLED for b in TO_UNIT]
    models = [[fitted(found, f, *pair) for f in range(FOLDS)] for pair in pairs]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pairs), 2, BINS), np.int64)
        for batch in batches:
            x, y, fold = matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                rows = fold == f
                for i, of in enumerate(models):
                    if of[f] is not None:
                        at = np.clip(np.floor(squeezed(of[f].difference(x[rows])) / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)
                        np.add.at(counts[i], (y[rows], at), 1)
        i, c, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[i, c, b], pa.int64())], names=["pair", "label", "bin", "n"])

    counts = np.zeros((len(pairs), 2, BINS))
    for r in labelled.mapInArrow(place, "pair int, label int, bin int, n long").groupBy("pair", "label", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"], r["label"], r["bin"]] = r["n"]
    z = (np.arange(BINS) - BINS // 2 + 0.5) * WIDTH
    curves = [curve(z, c) for c in counts]
    best = min(range(len(pairs)), key=lambda i: (curves[i][2] if counts[i].sum() else np.inf, -i))
    model = fitted(found, -1, *pairs[best])
    model.slope, model.intercept = max(0.0, curves[best][0]), curves[best][1]
    return model


def score_quality(described: DataFrame, model: Discriminant | float) -> DataFrame:
    """(key, quality): the probability that each described row is of class 1."""
    if isinstance(model, float):
        return described.select("key", F.lit(model).alias("quality"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in pieces(b, 4096)):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(model.score(matrix(part.column("x"))), pa.float64())], names=["key", "quality"])

    return described.mapInArrow(score, f"key {described.schema['key'].dataType.simpleString()}, quality double")


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", name: str = "quality") -> DataFrame:
    """Key and quality of each row of ``docs``, learnt from the rows that ``labels`` covers."""
    described = written(describe(docs, key, text), "statistics")
    return score_quality(described, fit_quality(described, labels, key, label)).toDF(key, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, by the labels whose key's crc32 modulo 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    scored = classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, name="score")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
