"""Operator 6: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rolled) by its place; a text's vector bundles (sums) those of its n-grams. A language's
prototype bundles the normalised vectors of its training texts, less the mean of all languages, and a text
goes to the language of the highest cosine.

Prototypes are fitted on a bounded sample of at most about ``max_docs`` rows, or one row a language where there
are more languages, chosen by a hash of the key. Every language has a prototype, a vector each at the driver.
Every text is read whole. Null texts and those without a letter get ``und`` and score 0; without prototypes
every text does. Ties of cosines go to the language that sorts first. Repeated rows get equal results, an
empty table an empty one, and columns other than key, text and, in training, language are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import code_points, mapped, mix, remainder, written

DIMENSIONS, GRAM, MAX_DOCS, UNKNOWN = 1024, 3, 8000, "und"
SPACE = 32


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-case letters of a text, with one space wherever others stand between them and at both ends."""
    text = text or ""
    x = code_points(text.lower())
    other = np.unique(x)
    alpha = other[[chr(c).isalpha() for c in other.tolist()]] if len(other) else other
    if not len(alpha):
        return np.empty(0, np.uint32)
    letter = np.isin(x, alpha) if int(x.max()) > 0xFFFF else np.bincount(alpha, minlength=0x10000).astype(bool)[x]
    keep = np.r_[True, letter[1:] | letter[:-1]]
    x = np.where(letter, x, np.uint32(SPACE))[keep]
    return np.concatenate([[SPACE] * int(x[0] != SPACE), x, [SPACE] * int(x[-1] != SPACE)]).astype(np.uint64)


class Encoder:
    """Vectors of n-grams, made from the letters' random vectors and kept in a cache of bounded size."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, room: int = 32_768):
        self.dimensions, self.gram, self.room = dimensions, gram, room
        self.letters: dict[int, np.ndarray] = {}
        self.keys, self.vectors = np.empty(0, np.uint64), np.empty((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            bits = mix(np.uint64(code * 1_000_003) + np.arange(self.dimensions, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            found = self.letters[code] = np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)
        return found

    def bind(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: the product of the letters' vectors, each rolled by its distance from the end."""
        out = np.ones((len(keys), self.dimensions), np.int8)
        for place in range(self.gram):
            codes, at = np.unique((keys >> np.uint64(21 * place)) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), place) for c in codes])[at]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = keys[~known]
            if len(self.keys) + len(new) > self.room:
                self.keys, self.vectors = np.empty(0, np.uint64), self.vectors[:0]
                if len(keys) > self.room:
                    return self.bind(keys)
                new = keys
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged)
            self.keys, self.vectors = merged[order], np.concatenate([self.vectors, self.bind(new)])[order]
            at = np.searchsorted(self.keys, keys)
        return self.vectors[at]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text's n-grams, each as often as it occurs; None without a letter."""
        x = letter_codes(text)
        if not len(x):
            return None
        x = np.concatenate([x, np.full(max(0, self.gram - len(x)), SPACE, np.uint64)])
        keys = x[: len(x) - self.gram + 1].copy()
        for place in range(1, self.gram):
            keys = (keys << np.uint64(21)) | x[place : len(x) - self.gram + 1 + place]
        keys, counts = np.unique(keys, return_counts=True)
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(keys), 4096):
            out += counts[at : at + 4096].astype(np.float32) @ self.of(keys[at : at + 4096]).astype(np.float32)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Prototypes:
    languages: list[str]
    centre: np.ndarray
    vectors: np.ndarray
    encoder: Encoder

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.encoder.encode(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        cosines = self.vectors @ unit(unit(x) - self.centre)
        best = int(np.argmax(cosines))
        return self.languages[best], float((1 + np.clip(cosines[best], -1, 1)) / 2)


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, dimensions: int = DIMENSIONS, gram: int = GRAM) -> Prototypes:
    """Prototypes of the languages of a bounded sample of ``docs``."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")), F.lit(3)).alias("draw"))
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")), "languages")
    count, encoder = sizes.count(), Encoder(dimensions, gram)
    if not count:
        return Prototypes([], np.zeros(dimensions), np.zeros((0, dimensions)), encoder)
    # Each language gives an equal share of the sample, or all it has, and one row at least.
    span = 1 << 20
    sample = known.join(sizes, "lang").where((F.pmod(F.col("draw"), F.lit(span)) * F.col("n") < F.lit(span * max_docs / count)) | (F.col("draw") == F.col("first"))).select("lang", "text")

    def bundle(rows: dict[str, list]) -> dict[str, Sequence]:
        sums: dict[str, np.ndarray] = {}
        for name, t in zip(rows["lang"], rows["text"]):
            if (x := encoder.encode(t)) is not None:
                sums[name] = sums.get(name, 0) + unit(x)
        return {"lang": list(sums), "sum": [v.astype(np.float64).tolist() for v in sums.values()]}

    parts = mapped(sample, bundle, "lang string, sum array<double>")
    sums = parts.select("lang", F.posexplode("sum").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    found = {r["lang"]: r["v"] for r in sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("v")).collect()}
    languages = sorted(found)
    vectors = unit(np.array([found[x] for x in languages]).reshape(len(languages), dimensions))
    centre = vectors.mean(0) if len(languages) > 1 else np.zeros(dimensions)
    return Prototypes(languages, centre, unit(vectors - centre), encoder)


def identify_languages(docs: DataFrame, prototypes: Prototypes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, predicted language and score of each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def predict(rows: dict[str, list]) -> dict[str, Sequence]:
        told = [prototypes.predict(t) for t in rows["text"]]
        return {"key": rows["key"], "lang_pred": [x for x, _ in told], "score": [x for _, x in told]}

    found = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), predict, f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = fit_languages(docs.where(remainder("doc_id", 3) != 1))
    return identify_languages(docs, prototypes).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
