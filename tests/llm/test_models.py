"""Toxicity, language identification and lattice likelihood: held-out quality, exact parts, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import language_id, lattice_lm, toxicity
from tidemark.llm.shared import HashLookup
from tidemark.llm.vocabulary import SPACE, BatchLattice, expected_counts, load_vocabulary, marginal

SF = "/root/testdata/sf0.01"


def crc(key):
    return zlib.crc32(str(key).encode())


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    n1 = sum(labels)
    return (order[np.array(labels) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > 0.85


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd_docs, labels)
    assert toxicity.score_toxicity(odd_docs, model, name="s").where("s BETWEEN 0 AND 1").count() == 11
    assert toxicity.fit_toxicity(odd_docs, labels.limit(0)) is None
    assert toxicity.score_toxicity(no_docs, model).collect() == []
    assert toxicity.score_toxicity(odd_docs, None, name="s").agg({"s": "max"}).first()[0] == 0


def test_single_words_and_repeated_keys_count_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "good plain words every day" if i % 2 else f"good plain horrid{chr(97 + i)} every day") for i in range(12)] + [(2, f"copy {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.where("text NOT LIKE 'copy%'"), labels)
    word = toxicity.word_keys(toxicity.symbols("horrida"))
    assert len(word) == 1 and model.models[1].of(word)[0] > 0.5  # it occurs once in the sample
    assert toxicity.fit_toxicity(docs, labels, max_docs=12) is not None


def test_word_ratio_against_definition():
    keys, counts = np.arange(1, 6, dtype=np.uint64), np.array([[5, 0], [1, 4], [0, 1], [3, 3], [1, 0]], float)
    ratio, shared = toxicity.WordRatio.fit(keys, counts), counts.sum(1) / counts.sum()
    for k, c, p in zip(keys, counts, shared):
        logs = []
        for i in (0, 1):
            rest = toxicity.DISCOUNT * (counts[:, i] > 0).sum()
            logs.append(math.log((max(c[i] - toxicity.DISCOUNT, 0) + rest * p) / (rest * p)))  # over what a word that the class lacks gets
        assert abs(float(ratio.of(np.array([k]))[0]) - (logs[1] - logs[0])) < 0.021


def test_logistic_fit_against_its_gradient():
    draw = np.random.default_rng(4)
    x, weight = draw.normal(size=(300, 3)), draw.uniform(0.2, 1, 300)
    y = (x @ np.array([1.0, -2.0, 0.5]) + draw.normal(size=300) > 0.3).astype(float)
    mean, scale, w = toxicity.logistic(x, y, weight)
    z = np.c_[(x - mean) / scale, np.ones(300)]
    p = 1 / (1 + np.exp(-z @ w))
    ridge = 1e-3 * 300 * np.r_[np.ones(3), 1e-6]
    assert np.abs(z.T @ (weight * (p - y)) + ridge * w).max() < 1e-3 and w[0] > 0 > w[1]


def test_features_of_a_text_by_words():
    grams = np.array([[ord(c) for c in "hate "], [ord(c) for c in "nice "]], np.uint32)
    ratio = toxicity.Ratio.fit(grams, np.array([[0, 6], [6, 0]], float))
    whole = toxicity.WordRatio.fit(toxicity.word_keys(toxicity.symbols("hate nice")), np.array([[0, 6], [6, 0]], float))
    x = toxicity.features((ratio, whole), "Nice hate, nice")
    told = [float(whole.of(toxicity.word_keys(toxicity.symbols(w)))[0]) for w in ("nice", "hate", "nice")]
    assert len(x) == toxicity.FEATURES and math.isclose(x[5], sum(told) / 3, rel_tol=1e-6) and x[6:] == [max(told), 0.0, 0.0] and math.isclose(x[4], math.log(4))
    cut = toxicity.features((ratio, whole), "nice hate " * 50, block=37)
    assert np.allclose(cut, toxicity.features((ratio, whole), "nice hate " * 50))


def test_kneser_ney_ratio_against_definition():
    draw = np.random.default_rng(2)
    grams = np.unique(draw.integers(97, 100, (60, toxicity.ORDER)).astype(np.uint32), axis=0)
    counts = draw.integers(0, 5, (len(grams), 2)).astype(float) + np.array([1, 0])
    ratio, backoff = toxicity.Ratio.fit(grams, counts), toxicity.shared_backoff(grams)
    for g, c, p in zip(grams, counts, backoff):
        same = (grams[:, :-1] == g[:-1]).all(1)
        logs = []
        for k in (0, 1):
            total, kinds = counts[same, k].sum(), (counts[same, k] > 0).sum()
            logs.append(math.log((max(c[k] - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * kinds + toxicity.SMOOTHING) * p) / (total + toxicity.SMOOTHING)))
        assert abs(float(ratio.of(g)[0]) - (logs[1] - logs[0])) < 0.021


def test_language_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language_id.query(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit_languages(odd_docs)
    rows = language_id.identify_languages(odd_docs, model).collect()
    assert len(rows) == 11 and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6)} == {"und"}
    assert language_id.identify_languages(no_docs, language_id.fit_languages(no_docs)).collect() == []


def test_batch_lattice_against_single_words():
    vocabulary = load_vocabulary()
    lattice, logp = BatchLattice(vocabulary), vocabulary.logp
    words = [SPACE + w for w in ("the", "thlyouble", "日本▁x", "ab" * 80, "é\U0001f600", "", "a" * 30)]
    assert np.allclose(lattice.marginals(words, logp), [marginal(vocabulary, logp.tolist(), w)[0] for w in words])
    weights, a, b = np.arange(1.0, len(words) + 1), np.zeros(len(logp)), [0.0] * len(logp)
    lattice.add_expected(words, weights, logp, a)
    for w, n in zip(words, weights):
        expected_counts(vocabulary, logp.tolist(), w, float(n), b)
    assert np.allclose(a, b)


def base_by_brute(docs):
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    tokens = [(k, [*find(low(t)), None]) for k, t in docs]
    c = Counter()
    for k, w in tokens:
        if crc("" if k is None else k) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return sorted(((-1 if k is None else k, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for k, w in tokens))


def told(rows):
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)


def test_lattice_likelihood(spark, odd_docs, no_docs, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert told(lattice_lm.query(spark, data).collect()) == base_by_brute(docs)
    train = ~(lattice_lm.remainder("doc_id", 7) == 2)
    for hot in (2, 1000):
        assert told(lattice_lm.score_texts(odd_docs, train, rounds=1, hot=hot).collect()) == base_by_brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert lattice_lm.score_texts(no_docs, train, rounds=1).collect() == []


def test_lattice_scores_against_marginals(spark, data):
    """Word by word and for whole texts: the score is the sum over words of the log of all segmentations' probability, and the end's."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    vocabulary = load_vocabulary()
    for rounds in (0, 2):
        counted = lattice_lm.count_words(docs.select("text", (~(lattice_lm.remainder("doc_id", 7) == 2)).alias("train")))
        logp = lattice_lm.fit_pieces(counted, BatchLattice(vocabulary), rounds).tolist()
        found = {r["doc_id"]: r["score"] for r in lattice_lm.score_texts(docs, ~(lattice_lm.remainder("doc_id", 7) == 2), rounds=rounds).collect()}
        for k in sorted(rows)[:12]:
            words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[k]))
            want = (sum(marginal(vocabulary, logp, SPACE + w)[0] for w in words) + logp[vocabulary.end_id]) / math.log(10)
            assert abs(found[k] - want) < 1e-6 * max(1, abs(want))


def all_segmentations(vocabulary, logp, text):
    if not text:
        return 1.0
    return sum(math.exp(logp[v] if v >= 0 else vocabulary.bytes_logp(text[0], logp)) * all_segmentations(vocabulary, logp, text[j:]) for j, v in vocabulary.lattice(text)[0])


def test_marginal_against_all_segmentations():
    vocabulary = load_vocabulary()
    logp = vocabulary.logp.tolist()
    for word in ("the", "other", "\u00e9te", "zqx"):
        assert abs(marginal(vocabulary, logp, SPACE + word)[0] - math.log(all_segmentations(vocabulary, logp, SPACE + word))) < 1e-9


def test_language_vectors_against_definition():
    encoder = language_id.Encoder(64, 3)
    text = "Une  \u00c9t\u00e9, 42 ans!"
    letters = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    want = np.zeros(64)
    for i in range(len(letters) - 2):
        bound = np.ones(64)
        for place, c in enumerate(reversed(letters[i : i + 3])):
            bound = bound * np.roll(encoder.letter(ord(c)), place)
        want += bound
    assert np.array_equal(encoder.encode(text), want)
    draw = np.random.default_rng(4)
    model = language_id.Prototypes(["a", "b"], np.zeros(64), language_id.unit(draw.normal(size=(2, 64))), encoder)
    cosines = [float(v @ want / np.linalg.norm(v) / np.linalg.norm(want)) for v in model.vectors]
    name, score = model.predict(text)
    assert name == "ab"[int(np.argmax(cosines))] and abs(score - (1 + max(cosines)) / 2) < 1e-6


def test_every_language_has_a_prototype(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} word", f"l{i:04d}") for i in range(1200)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=50, dimensions=64)
    assert len(model.languages) == 1200


def test_shared_backoff_against_definition():
    """Interpolated Kneser-Ney of continuation counts, level by level from the definition."""
    draw = np.random.default_rng(3)
    grams = np.unique(draw.integers(97, 100, (80, toxicity.ORDER)).astype(np.uint32), axis=0)
    tuples = [tuple(g) for g in grams.tolist()]

    def p(context, last):  # of suffixes of length len(context) + 1
        n = len(context) + 1
        # A type is counted by the distinct types one longer that end in it.
        longer = {t[-n - 1 :] for t in tuples}
        counts = Counter(t[-n:] for t in longer)
        if n == 1:
            return (counts[(last,)] + 1) / (sum(counts.values()) + len(counts) + 1)
        same = {k: v for k, v in counts.items() if k[:-1] == context}
        total = sum(same.values())
        return (max(same.get((*context, last), 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * p(context[1:], last)) / total

    for g, found in zip(tuples, toxicity.shared_backoff(grams)):
        assert abs(found - p(g[1:-1], g[-1])) < 1e-9


def test_lookup_of_many_keys_is_small_and_right():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 1 << 20, dtype=np.uint64))
    rng.shuffle(keys)
    values = rng.random(len(keys), np.float32)
    table = HashLookup(keys[:-1000], values[:-1000])
    assert sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) < 64e6
    found, present = table.get(keys)
    assert present[:-1000].all() and not present[-1000:].any()
    assert (found[:-1000] == values[:-1000]).all() and not found[-1000:].any()
    again = HashLookup(*table.__reduce__()[1]).get(keys[:5000])
    assert again[1].all() and (again[0] == values[:5000]).all()
    for few in (np.empty(0, np.uint64), np.zeros(1, np.uint64), np.full(1, 7, np.uint64)):
        got, there = HashLookup(few, np.ones(len(few))).get(np.array([0, 7, 8], np.uint64))
        assert there.tolist() == [k in few.tolist() for k in (0, 7, 8)] and got.tolist() == there.astype(float).tolist()


def test_words_count_once_however_often_counts_are_sent_on(spark):
    rows = [(t, k) for t, k in (("a b A", True), ("b c", False), ("", True), (None, False), ("d e f g a", True), ("h c", False), ("a", None))]
    docs = spark.createDataFrame(rows, "text string, train boolean").coalesce(1)
    want = {}
    for text, train in rows:
        for w in [*(x.encode() for x in (text or "").lower().split()), None]:
            c, n = want.get(w, (0, 0))
            want[w] = (c + bool(train), n + 1)
    for room in (2, 300_000):
        assert {r["word"] and bytes(r["word"]): (r["c"], r["n"]) for r in lattice_lm.count_words(docs, room).collect()} == want
