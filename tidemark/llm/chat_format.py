"""Operator 1: chat formatting in budgeted windows.

Token counts of turns are summed into prefixes, in two levels (within blocks of turns, then over blocks), so
a conversation of any length is spread over tasks. Cutting the prefix sums at multiples of the room for new
turns gives turn-aligned spans: turns between two multiples make up one span, and a turn across a multiple
one of its own. A window holds the system turn, as many turns before the span as the history budget allows,
and the span; only the span's assistant texts are under its loss mask, so no target is learnt twice. The room is
what budget, history and the conversation's own system turn (but at least the tokens set apart for one) leave.
A turn longer than the room is a span by itself. Only such a turn, or a system turn that leaves no room, whose
windows are of a turn each, can exceed the budget; ``tokens`` counts all that a window holds.

Turns are ordered by turn number, then role and text; missing numbers come first. Null texts and roles are
empty. Control strings within texts and roles are escaped, reversibly. Only a first turn of role ``system``
is repeated. Very long conversations are spread by blocks of turn numbers; rows of one block, such as turns without a
number, are ordered in one task, and so are the windows of a conversation as they are read back, one at a time.
A missing conversation id is one conversation. Repeated rows are turns of their own. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import mapped, pieces, process_cache, written

TOKENS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUDGET, HISTORY, SYSTEM, BLOCK = 1024, 256, 256, 256
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str | None) -> str:
    """No ``<|`` is left: another backslash goes between the two, after those that are there."""
    return CONTROL.sub(r"<\1\\|", text or "")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn by the template, and where its text lies in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def token_counter(path: str):
    """Counts tokens with a vocabulary file, which each Python process loads once."""

    def count(role: str | None, text: str | None) -> int:
        cache = process_cache("tiktoken")
        if path not in cache:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cache[path] = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return len(cache[path].encode_ordinary(f"{escape_role(role)}\n{escape(text)}")) + 3

    return count


def budgeted_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, tokens_path: str = TOKENS_PATH) -> DataFrame:
    """A row a window: conv, start (tokens before its span), formatted, mask (start, end pairs), fresh (where its span begins), tokens."""
    count = token_counter(tokens_path)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conv, turn)}
    base = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    counted = mapped(base, lambda r: {**r, "tokens": [count(a, b) for a, b in zip(r["role"], r["text"])]}, f"conv {kinds[conv]}, turn {kinds[turn]}, role string, text string, tokens long", keep="tiktoken")
    counted = written(
        counted.select(
            "*",
            F.coalesce(F.col("conv").cast("string"), F.lit("\u0000")).alias("key"),
            F.coalesce(F.floor(F.col("turn").cast("double") / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"),
        ),
        "turns",
    )
    # The system turn is the first row of its conversation: the least number, and then the least role and text.
    firsts = counted.groupBy("key").agg(F.min(F.struct(F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf"))), "role", "text", "tokens")).alias("first"))
    led = firsts.where(F.col("first.role") == "system").select("key", F.col("first.tokens").alias("system_tokens"), F.col("first.text").alias("system_text"))
    inner = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    placed = counted.select("*", F.row_number().over(inner).alias("nth"), F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    blocks = counted.groupBy("key", "block").agg(F.sum("tokens").alias("of_block"), F.count("*").alias("rows"))
    outer = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("of_block").over(outer), F.lit(0)).alias("before"), F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("rows_before"))
    ordered = placed.join(blocks, ["key", "block"]).join(led.select("key", "system_tokens"), "key", "left")
    lead = F.coalesce("system_tokens", F.lit(0))
    is_system = (F.col("nth") + F.col("rows_before") == 1) & F.col("system_tokens").isNotNull()
    ordered = ordered.select(
        "key", "conv", "role", "text", (F.col("nth") + F.col("rows_before")).alias("nth"), is_system.alias("is_system"),
        "tokens", F.when(is_system, 0).otherwise(F.col("before") + F.col("upto") - lead).alias("end"),
        F.greatest(F.lit(budget - history) - F.greatest(lead, F.lit(system)), F.lit(1)).alias("room"),
    ).withColumn("begin", F.when(F.col("is_system"), 0).otherwise(F.col("end") - F.col("tokens")))
    spans = ["key", "from_cut", "to_cut"]
    ordered = written(ordered.select("*", F.expr("begin div room").alias("from_cut"), F.expr("greatest(end - 1, begin) div room").alias("to_cut")), "spans")
    fresh = ordered.select(*spans, "conv", F.lit(2).alias("place"), "nth", "role", "text", "tokens", "begin")
    starts = ordered.groupBy(spans).agg(F.min("begin").alias("start"), F.min("nth").alias("first_nth"), F.first("conv").alias("conv"))
    before = starts.where("start > 0").select(*spans, "conv", "start", F.explode(F.array(F.expr(f"start div {history}"), F.expr(f"start div {history}") - 1)).alias("bucket"))
    past = ordered.where(~F.col("is_system")).select(F.col("key"), F.expr(f"begin div {history}").alias("bucket"), "nth", "role", "text", "tokens", "begin", "end")
    repeated = before.join(past, ["key", "bucket"]).where((F.col("end") <= F.col("start")) & (F.col("begin") >= F.col("start") - history)).select(*spans, "conv", F.lit(1).alias("place"), "nth", "role", "text", "tokens", "begin")
    leads = starts.where("first_nth > 1").join(led, "key").select(*spans, "conv", F.lit(0).alias("place"), F.lit(0).alias("nth"), F.lit("system").alias("role"), F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens"), F.lit(0).alias("begin"))
    rows = fresh.unionByName(repeated).unionByName(leads)
    # A window's rows are bounded by the budget.
    windows = rows.groupBy(spans).agg(F.first("conv").alias("conv"), F.min(F.when(F.col("place") == 2, F.col("begin"))).alias("start"), F.min(F.when(F.col("place") == 2, F.col("nth"))).alias("nth"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("place", "nth", "role", "text"))).alias("turns"))

    def assemble(r: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"formatted": [], "mask": [], "fresh": []}
        for found in r["turns"]:
            texts, mask, at, begins = [], [], 0, None
            for t in found:
                made, a, b = format_turn(t["role"], t["text"])
                if t["place"] == 2:
                    begins = at if begins is None else begins
                    if t["role"] == "assistant" and b > a:
                        mask.append({"begin": at + a, "end": at + b})
                texts.append(made)
                at += len(made)
            out["formatted"].append("".join(texts))
            out["mask"].append(mask)
            out["fresh"].append(begins)
        return {"key": r["key"], "conv": r["conv"], "start": r["start"], "nth": r["nth"], "tokens": r["tokens"], **out}

    return mapped(windows.select("key", "conv", "start", "nth", "tokens", "turns"), assemble, f"key string, conv {kinds[conv]}, start long, nth long, tokens long, formatted string, mask array<struct<begin:int,end:int>>, fresh int", keep="tiktoken").withColumnRenamed("conv", conv)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("the text isn't made of turns")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss masks of each conversation, from its windows alone.

    A digest takes a conversation's texts in order, so its windows pass through one task, but one at a time.
    """
    kind = windows.schema[conv].dataType
    dealt = windows.select("key", F.col(conv).alias("conv"), "nth", "formatted", "mask", "fresh").repartition("key").sortWithinPartitions("key", "nth")
    fields = f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, out, conv_type = None, None, [], None

        def batch_of(found: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], r[6]] for r in found]))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for part in pieces(batch):
                for k, c, formatted, mask, fresh in zip(*(part.column(n).to_pylist() for n in ("key", "conv", "formatted", "mask", "fresh"))):
                    if k != key:
                        if row is not None:
                            out.append(row)
                        key, row = k, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text in parse_turns(formatted[fresh:]):
                        row[1] += 1
                        row[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for span in mask:
                        text = unescape(formatted[span["begin"] : span["end"]])
                        row[3] += len(text)
                        row[4].update(text.encode("utf-8", "surrogatepass"))
                    row[5] += len(formatted)
                    row[6] += 1
                if out:
                    yield batch_of(out)
                    out = []
        if row is not None:
            yield batch_of([row])

    return dealt.mapInArrow(digest, fields).withColumnRenamed("conv", conv)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and one of two turns that hold control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return read_back(budgeted_windows(turns.unionByName(more)))
