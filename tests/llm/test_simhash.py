import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_brute(points, radius=3):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:k] ^ points[k]) <= radius):
            parent[find(k)] = find(int(j))
    return [find(i) for i in range(len(points))]


def clusters(seed, n):
    draw, out = np.random.default_rng(seed), set()
    for base in draw.integers(0, 2**63, 3, dtype=np.uint64):
        for _ in range(n):
            x = int(base)
            for bit in draw.integers(0, 64, draw.integers(0, 5)):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out | {int(x) for x in draw.integers(0, 2**63, n)}), np.uint64)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("radius", [3, 7])
def test_bk_forest_finds_every_link(radius):
    points = clusters(3, 300)
    member, earlier = S.BKForest(np.zeros(len(points), np.int64), points).spanning(radius)
    label = np.arange(len(points))
    label[member] = earlier
    assert same_partition(label.tolist(), roots_by_brute(points, radius))


@pytest.mark.parametrize("radius", [3, 7])
def test_links_and_components_with_split_shards(spark, radius):
    points = clusters(1, 400)
    df = spark.createDataFrame([(S.signed(int(x)),) for x in points], "print long")
    roots = {r["vertex"] % 2**64: r["root"] for r in connected_components(S.link_prints(df, radius, shard=100)).collect()}
    assert same_partition([roots.get(int(x), S.signed(int(x))) for x in points], roots_by_brute(points, radius))


def test_shards_that_stay_large_are_dealt_again(spark):
    points = clusters(5, 500)
    df = spark.createDataFrame([(S.signed(int(x)),) for x in points], "print long")
    roots = {r["vertex"] % 2**64: r["root"] for r in connected_components(S.link_prints(df, 3, shard=6)).collect()}
    assert same_partition([roots.get(int(x), S.signed(int(x))) for x in points], roots_by_brute(points, 3))


def test_components_of_a_long_path(spark):
    found = connected_components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(found) == 301 and len({r["root"] for r in found}) == 1


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    docs = sorted(docs, key=lambda r: r["doc_id"])
    points = np.array([brute_print(r["text"]) for r in docs], np.uint64)
    roots = roots_by_brute(points)
    least = {}
    for r, root in zip(docs, roots):
        least.setdefault(root, r["doc_id"])
    want = {r["doc_id"]: (f"{int(p):016x}", least[root]) for r, p, root in zip(docs, points, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.query(spark, data).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    found = S.near_duplicates(odd_docs).collect()
    assert len(found) == 11
    by_key = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_key[2]["fingerprint"] == "0" * 16 and {by_key[k]["component_id"] for k in (2, 3, 6)} == {2}
    assert by_key[8]["component_id"] == 1
    kept = S.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 4, 5, 7]
    assert S.near_duplicates(no_docs).collect() == [] and S.keep_first(no_docs).collect() == []


def test_pipeline_links_texts_by_their_shingles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    sets = [set(S.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    places = {}
    for i, s in enumerate(sets):
        for h in s or {-1}:
            places.setdefault(h, []).append(i)
    shared = Counter(p for at in places.values() for p in itertools.combinations(at, 2))
    label = list(range(len(rows)))
    for (a, b), n in sorted(shared.items()):
        if n >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == {rows[i]["doc_id"] for i in range(len(rows)) if label[i] == i}


def brute_groups(sets, bound=0.8):
    """The least index that links lead to, of every set."""
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= bound * len(sets[i] | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_large_shards_lose_no_link(spark):
    """Shards above the room: copies of one text that are alike only to it, a passage that many texts share, and chains."""
    draw = np.random.default_rng(7)
    base = [f"w{i}" for i in range(300)]

    def edited(words, tag, changes):
        out = list(words)
        for k, at in enumerate(draw.choice(len(out), changes, replace=False)):
            out[at] = f"{tag}x{k}"
        return " ".join(out)

    texts = [" ".join(base)] + [edited(base, f"a{i}", int(draw.integers(1, 9))) for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"o{i // 2}y{j}" for j in range(60)] + ([f"z{i}"] if i % 2 else [])) for i in range(400)]
    texts += [" ".join([*(f"v{j}" for j in range(k, 60 + k)), f"b{i}"]) for i in range(100) for k in range(4)]
    texts += ["only once here today again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, radius=corpus_pipeline.NEAR).collect()}
    want = brute_groups([set(S.shingle_hashes(t, 5).tolist()) for t in texts])
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) / 2


def test_repeated_keys_with_several_texts(spark):
    texts = {"t1": "one two three four five six seven", "t2": "some other words stand here in a row"}
    rows = [(1, "t1"), (2, "t1"), (2, "t2"), (3, "t2"), (None, "t1"), (2, "t2")]
    docs = spark.createDataFrame([(k, texts[t]) for k, t in rows], "doc_id long, text string")
    for radius in (3, 0.2):
        assert sorted((r["doc_id"], r["text"]) for r in S.keep_first(docs, radius=radius).collect()) == [(1, texts["t1"]), (2, texts["t2"])]
    unkeyed = spark.createDataFrame([(None, texts["t1"]), (None, texts["t1"] + " eight nine ten eleven twelve thirteen fourteen fifteen"), (None, texts["t1"]), (None, texts["t2"])], "doc_id long, text string")
    assert S.keep_first(unkeyed, radius=0.2).count() == 3
    assert S.near_duplicates(unkeyed, radius=0.2).where("component_id IS NULL").count() == 4


def test_search_of_many_nodes_looks_at_few_edges_at_a_time():
    rng = np.random.default_rng(1)
    shards = np.repeat(np.arange(9), 512)
    prints = rng.integers(0, 1 << 63, 9, dtype=np.uint64)[shards]
    for _ in range(10):
        prints ^= np.uint64(1) << rng.integers(0, 64, len(prints), dtype=np.uint64)
    queries = np.arange(len(prints), dtype=np.int32)
    tracemalloc.start()
    forest = S.BKForest(shards, prints, 24)
    a, b = forest.earlier_within(queries, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    near = [(i, j) for i in range(512) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 24]
    assert sorted(zip(a[a < 512].tolist(), b[a < 512].tolist())) == near
