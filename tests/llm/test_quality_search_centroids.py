"""Quality, ranked search and centroid clustering: brute force, held-out quality, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm.test_models import auc, crc
from tidemark.llm import centroids, quality, ranked_search

SF = "/root/testdata/sf0.01"


# ---- quality


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.query(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > 0.98
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_discriminant_against_densities():
    draw = np.random.default_rng(1)
    x = [draw.normal(size=(60, 21)) + k * 0.3 for k in (0, 1)]
    counts, sums, products = np.array([60, 60]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x])
    model = quality.Discriminant.fit(counts, sums, products, 0.0, 0.0)
    covs, means = [np.cov(a.T, bias=True) for a in x], [a.mean(0) for a in x]
    at = draw.normal(size=(7, 21))
    logs = [[-0.5 * np.linalg.slogdet(c)[1] - 0.5 * (p - m) @ np.linalg.inv(c) @ (p - m) for p in at] for c, m in zip(covs, means)]
    assert np.allclose(model.difference(at), np.array(logs[1]) - np.array(logs[0]))


def test_moments_are_those_of_all_rows(spark):
    draw = np.random.default_rng(3)
    x, y, f = draw.normal(size=(50, 21)), draw.integers(0, 2, 50), draw.integers(0, 2, 50)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, f)], "x array<double>, label int, fold int").repartition(5)
    found = quality.moments(rows)
    for (c, k), v in found.items():
        part = x[(y == c) & (f == k)]
        assert v[0] == len(part) and np.allclose(v[1:22], part.sum(0)) and np.allclose(v[22:], (part.T @ part).ravel())


def test_statistics_by_definition():
    text = "Aa bb bb, 12 ## bb.\nAa bb bb, 12 ## bb.\né x"
    words = text.split()
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    assert math.isclose(got["log words"], math.log(len(words) + 1))
    assert math.isclose(got["log mean word length"], math.log(1 + sum(map(len, words)) / len(words)))
    assert math.isclose(got["share of the commonest word"] ** 2, Counter(words).most_common(1)[0][1] / len(words))
    assert math.isclose(got["words equal to the one before"] ** 2, sum(a == b for a, b in zip(words, words[1:])) / len(words))
    assert math.isclose(got["repeated lines"] ** 2, 1 / 3) and math.isclose(got["words without a letter"] ** 2, 4 / len(words))
    assert math.isclose(got["words that begin in upper case"] ** 2, 2 / len(words)) and math.isclose(got["words that end in a symbol"] ** 2, 2 / len(words))


def test_statistics_of_long_texts_by_blocks(monkeypatch):
    text = " ".join(random.Random(4).choices(["ab", "Cd", "é!", "|", "x\ny"], k=3000))
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "BLOCK", 101)
    cut = quality.statistics(text)
    lines = [i for i, n in enumerate(quality.STATISTICS) if "lines" in n]
    assert all(math.isclose(a, b) for i, (a, b) in enumerate(zip(whole, cut)) if i not in lines)
    assert quality.statistics("x" * 1000)[0] > 0 and "".join(quality.blocks("x" * 1000)) == "x" * 1000


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (7, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.classify_quality(odd_docs, labels).collect()
    assert len(rows) == 11 and all(0 <= r["quality"] <= 1 for r in rows)
    assert len({r["quality"] for r in rows if r["doc_id"] in (1, 8)}) == 1
    assert {r["quality"] for r in quality.classify_quality(odd_docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["quality"] for r in quality.classify_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(no_docs, labels).collect() == []


# ---- ranked search


def brute_search(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    read = [(d, terms(t)) for d, t in docs]
    n, words = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    df = Counter(x for _, t in read for x in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for i, query in asked.items():
        found = []
        for d, t in read:
            tf = Counter(t)
            m = 100 - 75 + (75 * len(t) * n) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in query if tf[x])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def random_docs(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(n)]
    return docs + [(i + n, docs[3][1]) for i in range(30)]  # ties


def test_ranked_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 40)
    monkeypatch.setattr(ranked_search, "MANY", 2)
    docs, items = random_docs(400, 5), [(i, t) for i, t in random_docs(12, 6)[:12]] + [(50, "w1 w2 W1"), (50, "w3"), (None, "w1"), (51, "zzz"), (52, None)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 4, 10):
        got = [tuple(r) for r in ranked_search.ranked_search(frame, asked, k=k).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == brute_search(docs, items, k)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 15)
    got = [tuple(r) for r in ranked_search.ranked_search(frame, asked, k=4).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == brute_search(docs, items, 4)


def test_postings_are_in_order_of_impact_and_search_stops_early(spark):
    docs = [(i, "rare common" if i < 12 else "common " * 3) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    vocabulary = {b"rare": 0, b"common": 1}
    counted = ranked_search.count_terms(frame, "doc_id", "text", vocabulary)
    row = ranked_search.order_by_impact(counted, 3000, 12 * 2 + 2988 * 3).first()
    assert row["list_terms"] == [0, 1] and row["list_ends"] == [1, 3] and row["segment_ends"] == [12, 3000, 3012]
    assert row["impacts"][1] > row["impacts"][2] and set(row["postings"][:12]) == set(range(12))
    shard = ranked_search.Shard({n: np.array(row[n]) for n in row.asDict() if n != "keys"})
    places, scores = shard.search({0: 5000, 1: 10}, np.zeros(2, np.int64), 10, np.empty(0, np.int64))
    assert sorted(places.tolist()) == list(range(12)) and set(scores.tolist()) == {5000 * row["impacts"][0] + 10 * int(np.array(row["doc_impacts"])[1])}
    assert (shard.scores > 0).sum() == 12  # the common term's list was left unread
    assert len(shard.search({0: 5000, 1: 10}, np.zeros(2, np.int64), 10, np.full(10, 10**12))[0]) == 0


def test_ranked_search_odd_rows(spark, odd_docs, no_docs):
    asked = spark.createDataFrame([(1, "two alpha"), (2, ""), (3, "größe 日本語")], "item_id long, text string")
    got = [tuple(r) for r in ranked_search.ranked_search(odd_docs, asked).collect()]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(got) == brute_search(docs, [(1, "two alpha"), (3, "größe 日本語")], 10)
    assert ranked_search.ranked_search(no_docs, asked).collect() == [] and ranked_search.ranked_search(odd_docs, asked.limit(0)).collect() == []


# ---- centroids


def brute_clusters(rows, k, rounds, scale=64.0, dims=4):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(parts[j]) for col in zip(*parts[j])] if j in parts else w for j, w in enumerate(c)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, j, d in told:
        own[j] += d
    return [(i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told]


def by_text(rows):
    return sorted(map(repr, rows))


def test_centroids_against_brute_force(spark):
    draw = random.Random(7)
    rows = [(i, [draw.choice([-1.5, 0.0, 0.25, draw.random()]) for _ in range(4)]) for i in range(200)] + [(500 + i, [0.5, 0.5, -0.5, 0.0]) for i in range(150)]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, packed string, cluster int, n int").repartition(4)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = [tuple(r) for r in centroids.cluster_vectors(frame, dims=4, k=5).collect()]
    assert by_text(got) == by_text(brute_clusters(rows, 5, 3))
    assert by_text(tuple(r) for r in centroids.cluster_vectors(frame, dims=4, k=5, rounds=0).collect()) == by_text(brute_clusters(rows, 5, 0))


def test_centroids_of_large_components_are_exact(spark):
    rows = [(1, [1e9, 1e12, -1e13, 3.0]), (2, [-1e9, 1e12, 1e13, 3.0]), (3, [0.0, 1.0, 2.0, 3.0]), (4, [1e9, 1e12, -1e13, 3.5]), (4, [1e9, 1e12, -1e13, 3.5]), (5, [40.0, 700.0, 600.0, -600.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(*r[:2], *(min(x, 2**63 - 1) for x in r[2:5]), r[5]) for r in brute_clusters(rows, 2, 3)]
    assert by_text(tuple(r) for r in centroids.cluster_vectors(frame, dims=4, k=2).collect()) == by_text(want)
    packed = centroids.pack(np.array([[1, -128], [127, 128], [40_000, 0], [1 << 40, -1]]))
    assert [len(p) for p in packed] == [2, 4, 8, 16] and centroids.unpack(packed, 2).tolist() == [[1, -128], [127, 128], [40_000, 0], [1 << 40, -1]]


def test_centroids_odd_rows(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0]), (4, [1.0, nan, 1.0, 1.0]), (5, [1.0, float("inf"), 1.0, 1.0]), (6, [1.0] * 5), (7, [1.0] * 4), (7, [1.0] * 4), (None, [-0.0, 0.0, 1.0, 2.0]), (8, [1e-9, 0.0, 1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2, 16):
        assert by_text(tuple(r) for r in centroids.cluster_vectors(frame, dims=4, k=k).collect()) == by_text(brute_clusters(rows, k, 3))
    assert centroids.cluster_vectors(frame.limit(0), dims=4).collect() == []
    assert centroids.cluster_vectors(frame.where("vec_id < 7"), dims=4).collect() == []
