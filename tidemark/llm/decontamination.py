"""Operator 3: benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item, or a whole item that is shorter. Its fingerprint is the
least hash of the k-grams of words within it, the first of equal ones. Documents' windows are winnowed alike, so a
shared window always has a shared fingerprint, at the same place in it. Benchmark fingerprints go into a bitmap of
bounded size, which all tasks look their windows up in as they read the texts; texts are read once and never shuffled.
Fingerprints that pass, each once for all windows that it stands for, are joined to the benchmark's with the words
around them. A match is extended to both sides, as far as the words agree and its windows reach; from ``span`` words on
it is a hit, so hits are exact.

Very long texts are read whole, a row at a time. A window that several items share counts for each of them. A
null text has no words. Items without words match nothing. Rows of one key with different texts are told
apart by a hash of the text; repeated rows get equal results. Items without an id are listed as ``null``;
items that share an id count once. Empty tables give no hits, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, written

SPAN, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BITS, BROADCAST_WINDOWS, BROADCAST_ITEMS = 24, 200_000, 1_000_000


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case: runs of digits, letters and all beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all k-grams of words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(words: Column, hashes: Column, at: Column, span: int, k: int) -> Column:
    """The least k-gram hash of the window of ``span`` words at ``at``; a shorter window's own hash."""
    if span < k:
        return F.xxhash64(F.slice(words, at, F.lit(span)))
    return F.array_min(F.slice(hashes, at, F.lit(span - k + 1)))


def positions(words: Column, span: int) -> Column:
    n = F.size(words)
    return F.when(n >= span, F.sequence(F.lit(1), n - span + 1)).otherwise(F.array().cast("array<int>"))


MARK = "struct<length:int,print:bigint,at:int,before:int,around:array<string>>"


def marks(words: Column, hashes: Column, span: int, k: int, windows: Column) -> Column:
    """The fingerprints of windows, given by their places: each with its place and the words as far around it as a window with it can reach.

    ``before`` of these words lie before the fingerprint's own.
    """
    reach = max(0, span - k)

    def place(i: Column) -> Column:
        return i + F.array_position(F.slice(hashes, i, F.lit(reach + 1)), fingerprint(words, hashes, i, span, k)).cast("int") - 1 if span >= k else i

    def mark(at: Column) -> Column:
        first = F.greatest(F.lit(1), at - reach)
        print_ = F.element_at(hashes, at) if span >= k else fingerprint(words, hashes, at, span, k)
        return F.struct(F.lit(span).alias("length"), print_.alias("print"), at.alias("at"), (at - first).alias("before"), F.slice(words, first, at - first + F.lit(min(span, k) + reach)).alias("around"))

    return F.transform(F.array_distinct(F.transform(windows, place)), mark)


def benchmark_marks(items: DataFrame, item: str, text: str, span: int, k: int) -> DataFrame:
    """(length, print, before, around, items): the distinct fingerprints of all windows, with the ids of the items that have them."""
    worded = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    found, size = None, F.size("words")

    def cut(m: int) -> Column:
        return bound(F.col("words"), lambda w: bound(gram_hashes(w, k), lambda h: marks(w, h, m, k, positions(w, m))))

    for m in (span, *range(1, span)):
        part = worded.where(size >= span if m == span else size == m).select("item", F.inline(cut(m)))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("length", "print", "before", "around").agg(F.array_sort(F.collect_set("item")).alias("items"))


def extended(k: int) -> tuple[Column, Column]:
    """(words that agree to the left of a shared fingerprint, words that agree from it on), of ``around`` and ``before`` in a document and, after ``their_``, in an item."""

    def agreeing(a: Column, b: Column) -> Column:
        """How many words two lists share from their beginnings on."""
        n = F.least(F.size(a), F.size(b))
        same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
        at = F.array_position(same, F.lit(False)).cast("int")
        return F.when(at > 0, at - 1).otherwise(n)

    head = lambda words, n: F.reverse(F.slice(words, F.lit(1), n))
    tail = lambda words, n: F.slice(words, n + 1, F.size(words))
    own, theirs = (F.col("around"), F.col("before")), (F.col("their_around"), F.col("their_before"))
    return agreeing(head(*own), head(*theirs)), agreeing(tail(*own), tail(*theirs))


def bitmap(windows: DataFrame, count: int) -> tuple[list[int], int]:
    """Words of 64 bits that tell which fingerprints may occur, and the number of address bits.

    16 bits a window up to 2 ** MAX_BITS in all; beyond, more windows pass by chance and the join sorts them out.
    """
    bits = min(MAX_BITS, max(6, (16 * max(1, count)).bit_length()))
    slot = F.expr(f"shiftrightunsigned(print, {64 - bits})")
    rows = windows.select(slot.alias("slot")).select((F.col("slot") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = [0] * (1 << (bits - 6))
    for r in rows:
        out[r["word"]] = r["bits"]
    return out, bits


def find_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Per row of ``docs``: key, text_hash, n_words, n_hit, items (sorted ids)."""
    tests = written(benchmark_marks(items, item, item_text, span, k), "marks")
    told = tests.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items")).collect()
    sizes, listed = {r["length"]: r["n"] for r in told}, sum(r["items"] for r in told)
    count = sum(sizes.values())
    table, bits = bitmap(tests, count)
    member = F.lit(table).cast("array<bigint>")

    def may(print_: Column) -> Column:
        return bound(F.call_function("shiftrightunsigned", print_, F.lit(64 - bits)), lambda s: F.call_function("getbit", F.get(member, F.call_function("shiftright", s, F.lit(6)).cast("int")), (s % 64).cast("int")) == 1)

    def passing(w: Column, h: Column) -> Column:
        def of(m: int) -> Column:
            return bound(F.filter(positions(w, m), lambda i: may(fingerprint(w, h, i, m, k))), lambda at: marks(w, h, m, k, at))

        passed = [of(m) for m in sorted(sizes)]
        return F.concat(*passed) if passed else F.array().cast(f"array<{MARK}>")

    read = bound(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), bound(gram_hashes(w, k), lambda h: passing(w, h)).alias("passed")))
    # Two uses of the struct's fields must not compute it twice: it is written as it is and taken apart afterwards.
    told = written(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), read.alias("read")), "passed")
    passed = told.where(F.size("read.passed") > 0).select("key", "text_hash", F.inline("read.passed"))
    theirs = tests.select("length", "print", F.col("before").alias("their_before"), F.col("around").alias("their_around"), "items")
    theirs = F.broadcast(theirs) if count <= BROADCAST_WINDOWS and listed <= BROADCAST_ITEMS else theirs.hint("shuffle_merge")
    left, right = extended(k)
    met = passed.join(theirs, ["length", "print"]).select("key", "text_hash", "length", "at", "items", left.alias("left"), right.alias("right")).where("left + right >= length")
    hits = met.groupBy("key", "text_hash").agg(F.collect_set(F.struct((F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right") - 1).alias("last"))).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    hits = hits.select(F.col("key").alias("hit_key"), F.col("text_hash").alias("hit_hash"), covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    at = F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("text_hash") == F.col("hit_hash"))
    return told.select("key", "text_hash", F.col("read.n_words").alias("n_words")).join(hits, at, "left").select(
        F.col("key").alias(key), "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all whole texts of ``documents``."""
    found = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that share a window with the benchmark."""
    own, print_ = free_name(docs, "_tidemark_key"), free_name(docs, "_tidemark_hash")
    hit = find_hits(docs, items, key, text).where("n_hit > 0").select(F.col(key).alias(own), F.col("text_hash").alias(print_))
    return docs.join(hit, F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(print_)), "left_anti")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, w[p:p + least(10, len(w)) - 1] AS g FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, p, m, w[p:p + m - 1] AS g FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(p)),
h AS (SELECT DISTINCT doc_id, p, m, item_id FROM dw JOIN iw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM h, unnest(range(0, m)) AS t(o) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
