import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import segmentation as S
from tidemark.llm.vocabulary import SPACE, load_vocabulary

SEGMENTER = S.Segmenter(load_vocabulary(), 5)


def brute(text):
    t = SPACE + text.replace(SPACE, S.MARK).replace(" ", SPACE)
    lattice, out = SEGMENTER.vocabulary.lattice(t), []

    def go(i, score, ids):
        if i == len(t):
            out.append((score, tuple(ids)))
            return
        for j, v in lattice[i]:
            e = (v,) if v >= 0 else SEGMENTER.char_ids(t[i])
            go(j, score + sum(SEGMENTER.logp[k] for k in e), ids + list(e))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text("aethon r▁é日\n", min_size=1, max_size=9))
def test_n_best_against_all_segmentations(text):
    want, found = brute(text), SEGMENTER.segmentations(text)
    assert len(found) == min(5, len(want))
    assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(found, want))
    assert len({tuple(ids) for _, ids in found}) == len(found)
    assert all(SEGMENTER.decode(ids) == text for _, ids in found)
    assert {tuple(ids) for _, ids in found} <= {ids for _, ids in want}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_decoding_is_exact(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, score, scores = SEGMENTER.encode(text)
    assert SEGMENTER.decode(ids) == text
    assert scores == sorted(scores, reverse=True) and abs(scores[0] - score) < 1e-9


def test_documents(spark, odd_docs, no_docs, data):
    found = S.encode_documents(odd_docs).collect()
    assert len(found) == 11
    assert all((r["piece_ids"] is None) == (r["exact"] is None) and r["exact"] in (True, None) for r in found)
    assert sum(r["exact"] is None for r in found) == 2 and next(r for r in found if r["doc_id"] == 2)["n_pieces"] == 0
    assert S.encode_documents(no_docs).collect() == []
    rows = S.query(spark, data).collect()
    assert len(rows) == 200 and all(r["exact"] for r in rows)


def k_best(text, n):
    """The n best scores of a whole text by dynamic programming over its whole lattice."""
    t = SPACE + text.replace(SPACE, S.MARK).replace(" ", SPACE)
    best = [[0.0], *([] for _ in t)]
    for i, edges in enumerate(SEGMENTER.vocabulary.lattice(t)):
        best[i] = sorted(best[i], reverse=True)[:n]
        for j, v in edges:
            lp = sum(SEGMENTER.logp[k] for k in ((v,) if v >= 0 else SEGMENTER.char_ids(t[i])))
            best[j] += [x + lp for x in best[i]]
    return sorted(best[-1], reverse=True)[:n]


def test_query_against_whole_lattices(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in S.encode_documents(docs).collect()}
    for r in S.query(spark, data).collect():
        text, full = texts[r["doc_id"]], rows[r["doc_id"]]
        digests = [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids in full["nbest_ids"]]
        assert list(r["nbest_sha256"]) == digests and r["pieces_sha256"] == digests[0] and len(set(digests)) == len(digests)
        assert list(full["piece_ids"]) == list(full["nbest_ids"][0]) and r["n_pieces"] == len(full["piece_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert all(SEGMENTER.decode(ids) == text for ids in full["nbest_ids"])
        scores = [sum(SEGMENTER.logp[i] for i in ids) for ids in full["nbest_ids"]]
        assert np.allclose(scores, r["nbest_scores"], rtol=1e-9) and (len(text) > 6000 or np.allclose(k_best(text, 4) if text else [0.0], scores, rtol=1e-9))


def test_changes_give_all_segmentations_back(spark, data, odd_docs):
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd_docs):
        rows = S.encode_documents(docs).withColumn("again", S.changed_ids()).collect()
        assert all(r["again"] == r["nbest_ids"] for r in rows) and any(any(len(c) for c in r["nbest_changes"][1:]) for r in rows if r["nbest_changes"])
    lean = S.query(spark, data)
    assert {"piece_ids", "nbest_changes"} <= set(lean.columns) and "nbest_ids" not in lean.columns


def test_tables_are_decoded(spark, odd_docs, no_docs):
    back = S.decode_documents(S.encode_documents(odd_docs.select("doc_id", "text"))).select("doc_id", "text")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, odd_docs.select("doc_id", "text").collect()))
    assert S.decode_documents(S.encode_documents(no_docs)).collect() == []


def test_blocks_of_long_texts(monkeypatch):
    text = "one  two three   four \u65e5\u672c " * 300 + "x" * 900 + " end"
    whole = SEGMENTER.segmentations(text)
    monkeypatch.setattr(S, "BLOCK", 64)
    small = S.Segmenter(SEGMENTER.vocabulary, 5, "blocks")
    found = small.segmentations(text)
    assert [ids for _, ids in found] == [ids for _, ids in whole] and np.allclose([x for x, _ in found], [x for x, _ in whole])


def test_full_tables_shrink():
    small = S.Segmenter(SEGMENTER.vocabulary, 5, "small")
    small.table().room = 20
    texts = [" ".join(f"w{i}{j % 7}" for j in range(30)) for i in range(40)]
    for text in texts:
        assert small.encode(text)[0] == SEGMENTER.encode(text)[0]
