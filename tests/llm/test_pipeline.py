import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import decontamination, secret_scan, segmentation, simhash, toxicity
from tidemark.llm.shared import give_back, process_cache, written


def test_stages_follow_each_other(spark, data):
    docs = written(spark.read.parquet(f"{data}/documents.parquet"), "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], data), name))
    assert all(df.columns == columns for df in seen[:-1])
    kept = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    model = toxicity.trained(spark, docs, data)
    assert kept[1] == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < toxicity.THRESHOLD}
    groups = {}
    for r in simhash.near_duplicates(seen[1], radius=P.NEAR).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert kept[2] == {min(g) for g in groups.values()}
    hits = decontamination.find_hits(seen[2], spark.read.parquet(f"{data}/benchmark.parquet")).where("n_hit > 0")
    assert kept[3] == kept[2] - {r["doc_id"] for r in hits.collect()}
    assert kept[4] == kept[3]
    assert all(not secret_scan.base_spans(r["text"]) for r in seen[4].collect())
    last = {r["doc_id"]: r for r in seen[5].collect()}
    encode = segmentation.Segmenter(segmentation.load_vocabulary())
    assert set(last) == kept[4] and all(encode.decode(last[r["doc_id"]]["piece_ids"]) == r["text"] for r in seen[4].collect())


def test_stages_take_odd_and_empty_documents(spark, odd_docs, no_docs, data):
    columns = odd_docs.columns
    docs, seen = odd_docs, []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, data), name)
        seen.append(docs)
    assert all(df.columns == columns for df in seen[:-1])
    texts = [sorted(repr(r["text"]) for r in df.collect()) for df in seen[:-1]]
    assert len(texts[0]) == 11  # none of these is toxic
    # Of the four rows "one two three four" the first stays, as of those without words.
    assert texts[1].count(repr("one two three four")) == 1 and texts[1] == texts[2] and len(texts[1]) < 9
    assert texts[3] == texts[1] and seen[-1].count() == len(texts[1]) and all(r["exact"] in (True, None) for r in seen[-1].collect())
    docs = no_docs
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, data), name)
        assert docs.collect() == []


def test_columns_with_the_names_of_helpers_stay(spark, data):
    names = ("_tidemark", "_tidemark_key", "_tidemark_print", "_tidemark_hash", "_tidemark_toxicity", "rows", "_TIDEMARK_")
    docs = spark.createDataFrame([(i, f"plain text number {i} of several words", "en", "s", 10, *(f"{n}{i}" for n in names)) for i in range(6)] + [(1, "plain text number 1 of several words", "en", "s", 10, *(f"{n}1" for n in names))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = written(stage(spark, kept, data), name)
    assert kept.columns == docs.columns and kept.count() >= 1
    assert all(r[n] == f"{n}{r['doc_id']}" for r in kept.collect() for n in names)


def test_stages_without_labels_or_benchmark_keep_all(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    stages = dict(P.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == docs.count() == stages["benchmark_decontamination"](spark, docs, str(tmp_path)).count()


def test_python_workers_get_small_batches_and_give_memory_back(spark, data):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))

    def most():
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").agg(F.max("n")).first()[0]

    try:
        assert most() > 20_000_000
        P.encode(spark, docs, data)
        assert most() < 6_000_000
        spark.conf.set(key, "16m")
        P.encode(spark, docs, data)
        assert spark.conf.get(key) == "16m"  # a session's own size stays
    finally:
        spark.conf.unset(key)


def test_caches_of_other_operators_go():
    mine, other = process_cache("test-a:table"), process_cache("test-b")
    mine["x"] = other["x"] = 1
    give_back("test-a")
    assert mine == {"x": 1} and other == {}
    give_back()
    assert mine == {}
