import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string, tokens string, key string"


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\>im_endstart\n ab", max_size=30), st.text("<|\\\n ab", max_size=12))
def test_escapes_are_reversible(text, role):
    assert "<|" not in C.escape(text)
    assert C.unescape(C.escape(text)) == text
    assert C.unescape_role(C.escape_role(role)) == role
    assert C.parse_turns(C.format_turn(role, text)[0] * 2) == [(role, text)] * 2


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_windows_read_back(spark):
    rows = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i} " * (i % 9)) for i in range(700)]
    rows += [(2, 0, "user", "hello " * 3000), (2, 1, "assistant", "<|im_end|>" * 3), (3, None, None, None), (3, 5, "assistant", ""), (None, 1, "assistant", "a"), (4, 1, "user", "same"), (4, 1, "user", "same"), (5, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    windows = C.budgeted_windows(df, budget=400, history=100, system=60).collect()
    for w in windows:
        turns = C.parse_turns(w["formatted"])
        assert w["tokens"] <= 400 or len(C.parse_turns(w["formatted"][w["fresh"] :])) == 1
        if w["conv_id"] == 1:
            assert turns[0][0] == "system"
        for span in w["mask"]:
            assert span["begin"] >= w["fresh"]
    assert any(len(C.parse_turns(w["formatted"])) > len(C.parse_turns(w["formatted"][w["fresh"] :])) + 1 for w in windows if w["conv_id"] == 1)
    found = {r["conv_id"]: r for r in C.read_back(C.budgeted_windows(df, budget=400, history=100, system=60)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    for conv, r in found.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute([x for x in rows if x[0] == conv])


def test_no_turns(spark):
    assert C.read_back(C.budgeted_windows(spark.createDataFrame([], TURNS))).collect() == []


def test_query(spark, data):
    found = {r["conv_id"]: r for r in C.query(spark, data).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute([x for x in rows if x[0] == conv])


def test_long_system_turns_count(spark):
    rows = [(1, 0, "system", "word " * 2000)] + [(1, i, "user", f"short {i}") for i in range(1, 5)]
    rows += [(2, 0, "system", "word " * 500)] + [(2, i, "assistant" if i % 2 else "user", "more words " * 40) for i in range(1, 60)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    count = C.token_counter(C.TOKENS_PATH)
    windows = C.budgeted_windows(df).collect()
    for w in windows:
        assert w["tokens"] == sum(count(*t) for t in C.parse_turns(w["formatted"]))
        if w["conv_id"] == 2:
            assert w["tokens"] <= C.BUDGET and C.parse_turns(w["formatted"])[0][0] == "system"
    assert sum(w["conv_id"] == 1 for w in windows) >= 4
    found = {r["conv_id"]: r for r in C.read_back(C.budgeted_windows(df)).collect()}
    for conv, r in found.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute([x for x in rows if x[0] == conv])
