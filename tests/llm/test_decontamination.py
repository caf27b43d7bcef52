import hashlib
import re

import duckdb

from tidemark.llm import decontamination as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        m = min(10, len(iw))
        grams = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_short_items_ties_and_repeats(spark, odd_docs, no_docs):
    items = [(1, "two THREE"), (2, "gamma delta alpha beta gamma delta alpha beta gamma delta alpha beta"), (3, None), (4, "..."), (None, "größe"), (1, "no key here at all"), (5, "a b c d e f g h i j k")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, words int")
    found = D.find_hits(odd_docs, bench).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(((r["doc_id"], *brute(r["text"], items)) for r in rows), key=lambda r: (key(r), r[1:]))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=lambda r: (key(r), r[1:])) == want
    clean = D.keep_clean(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert clean.count() == sum(w[2] == 0 for w in want)
    assert D.find_hits(no_docs, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in D.find_hits(odd_docs, bench.limit(0)).collect())


def test_shared_spans_at_every_offset(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(i, " ".join([*("x" for _ in range(i)), *item.split()[i : i + n], "y"])) for i in range(12) for n in (9, 10, 11, 17)]
    found = D.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    want = sorted((k, *brute(t, [(7, item)])[1:]) for k, t in docs)
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in found) == want


def test_query_against_sql(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    df = D.query(spark, data)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({D.SQL})").fetchall())
    assert sorted(map(tuple, df.collect())) == want
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in want}


def test_plan_has_no_python(spark, data):
    plan = D.find_hits(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_words_against_brute_force(spark):
    """Texts of two words have few k-grams, so windows share least hashes in many places."""
    import random

    draw = random.Random(8)
    some = lambda n: [draw.choice("ab") for _ in range(n)]
    docs = [(i, some(draw.randint(0, 40))) for i in range(60)] + [(99, ["a"] * 60)]
    items = [(i, some(n)) for i, n in enumerate((30, 18, 12, 10, 9, 7, 5, 4, 3))] + [(50, ["a"] * 25), (51, []), (52, ["c"] * 12)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in D.find_hits(frame, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    for i, words in docs:
        hit, names = set(), set()
        for item, theirs in items:
            m = min(10, len(theirs))
            windows = {tuple(theirs[p : p + m]) for p in range(len(theirs) - m + 1)} if m else set()
            for p in range(len(words) - m + 1) if m else ():
                if tuple(words[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    names.add(str(item))
        assert found[i] == (len(hit), sorted(names)), i
