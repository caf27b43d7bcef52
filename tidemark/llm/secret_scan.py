"""Operator 10: secrets in texts, by patterns and by character Markov models.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples: random strings of usual secret alphabets, and identifiers of usual shapes whose words come
from a bounded sample of the corpus itself (at most ``max_docs`` rows and ``max_words`` words of each, by hashes).
A long token is a secret when the log-likelihood ratio per transition of the random model to the ordinary one is high
enough. Spans of the pattern kinds always stay. A corpus without words leaves the words of ``WORDS``.

Nulls and empty texts have no spans. Very long texts are scanned whole, in time that grows with their length.
Spans of different kinds may overlap and are all listed, by start and then by kind; a ratio equal to the
threshold counts as a secret. Repeated rows, with or without a key, give repeated results, an empty table an empty
one, and columns other than the key and the text are not read. Numbers alone are no secrets to the models.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, mapped

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
THRESHOLD, MAX_DOCS, MAX_WORDS = 0.5, 2000, 200
WORD = re.compile(r"[A-Za-z]{2,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
WORDS = (
    "user name account customer order item list map set get put load store read write file path open close parse format "
    "token value key index count total sum average price date time stamp start end first last next previous node edge tree "
    "graph table column row field record schema query result filter group sort merge join split batch stream buffer cache "
    "queue stack heap thread lock worker task job event message request response server client host port address config "
    "option setting default handler manager factory builder service model view controller test case check valid error "
    "warning debug log trace report metric counter image document text string number integer float double boolean array "
    "object class method function module package version release branch commit change update delete insert create remove"
).split()


def corpus_words(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> list[str]:
    """Lower-case words of letters of at most ``max_docs`` rows chosen by a hash, at most ``max_words`` distinct ones of each, by a hash too."""
    span = 1 << 30
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), F.lit(span))
    share = min(1.0, 2 * max_docs / max(1, docs.count()))  # twice as many as are wanted, cut below

    def words(rows: dict[str, list]) -> dict[str, Sequence]:
        found = [{w.lower() for w in WORD.findall(t or "")} for t in rows["text"]]
        return {"draw": rows["draw"], "words": [sorted(x, key=lambda w: (zlib.crc32(w.encode()), w))[:max_words] for x in found]}

    for part in {share: None, 1.0: None}:  # equal rows are drawn together, or none of them
        drawn = docs.select(draw.alias("draw"), F.col(text).alias("text")).where(F.col("draw") < int(part * span))
        rows = mapped(drawn, words, "draw long, words array<string>").orderBy("draw", "words").limit(max_docs).collect()
        if rows:
            break
    return sorted({w for r in rows for w in r["words"]})


def labelled_samples(n: int = 4000, seed: int = 11, vocabulary: Sequence[str] = WORDS) -> list[tuple[str, int]]:
    """(string, 1 if random) pairs: strings drawn from usual secret alphabets, and identifiers made of words."""
    draw, out = random.Random(seed), []
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62], ALPHABET[:26] + "0123456789")
    for k in range(n):
        out.append(("".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randint(20, 48))), 1))
        words = draw.choices(vocabulary, k=draw.randint(3, 7))
        shape = (
            "_".join(words), "-".join(words), "/".join(words), "".join(words), words[0] + "".join(w.title() for w in words[1:]),
            "".join(w.title() for w in words), "_".join(words).upper(), f"{'_'.join(words)}_{draw.randint(0, 2030)}",
        )[k % 8]
        out.append((shape, 0))
    return out


def markov_ratio(samples: Sequence[tuple[str, int]], smoothing: float = 0.5) -> np.ndarray:
    """log P(next | char) under the random model minus under the ordinary one, as a 128 x 128 table."""
    counts = np.full((2, 128, 128), 0.0)
    for text, label in samples:
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    used = np.frombuffer(ALPHABET.encode(), np.uint8)
    table = np.zeros((128, 128))
    smooth = counts[np.ix_([0, 1], used, used)] + smoothing
    ratio = np.log(smooth[1] / smooth[1].sum(1, keepdims=True)) - np.log(smooth[0] / smooth[0].sum(1, keepdims=True))
    table[np.ix_(used, used)] = ratio
    return table


@functools.cache
def default_ratio() -> np.ndarray:
    return markov_ratio(labelled_samples())


def fit_ratio(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, samples: int = 20_000) -> np.ndarray:
    """The ratio of the models whose ordinary identifiers are made of the words of ``docs``, in equal parts with those of ``WORDS``."""
    words = corpus_words(docs, key, text, max_docs, max_words)
    return markov_ratio(labelled_samples(samples, 11, words) + labelled_samples(samples, 12)) if words else default_ratio()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of long tokens that the random model explains better by ``threshold`` a transition."""
    found = []
    for m in TOKEN.finditer(text):
        codes = np.frombuffer(m[0].encode("ascii"), np.uint8)
        if ratio[codes[:-1], codes[1:]].mean() >= threshold:
            found.append((m.start(), 3, m.end()))
    return found


def scan_text(text: str | None, ratio: np.ndarray, threshold: float) -> tuple[list, list]:
    """The base spans and all spans of a text; spans of the model that lie within a base span are left out."""
    text = text or ""
    base = base_spans(text)
    added, at, reach = [], 0, 0
    for x in random_spans(text, ratio, threshold):
        while at < len(base) and base[at][0] <= x[0]:
            reach = max(reach, base[at][2])
            at += 1
        if x[2] > reach:
            added.append(x)
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, samples: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Key, spans by kind counted and listed, and the redacted text of every row of ``docs``."""
    ratio = markov_ratio(samples) if samples is not None else fit_ratio(docs, key, text)

    def scan(rows: dict[str, list]) -> dict[str, Sequence]:
        found = [scan_text(x, ratio, threshold) for x in rows["text"]]
        counts = [[sum(s[1] == k for s in spans) for _, spans in found] for k in range(4)]
        return {
            "key": rows["key"], "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "n_random": counts[3],
            "base": [joined(b) for b, _ in found], "spans": [joined(s) for _, s in found],
            "clean_text": [redacted(x, s) for x, (_, s) in zip(rows["text"], found)],
        }

    kind = docs.schema[key].dataType.simpleString()
    out = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scan, f"key {kind}, n_assign long, n_access long, n_hex long, n_random long, base string, spans string, clean_text string")
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in every whole text of ``documents``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, secrets replaced in ``text`` and ``n_chars`` to match."""
    ratio = fit_ratio(docs)

    @F.pandas_udf("string")
    def clean(texts):
        give_back()
        return texts.map(lambda x: redacted(x, scan_text(x, ratio, THRESHOLD)[1]), na_action="ignore")

    text = clean("text")
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else changed


