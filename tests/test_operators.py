"""Edge cases of operators that the registered queries don't reach, and streams from end to end."""

import decimal
import random
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import masking, tsql
from tidemark.operators import chunking, loads, metadata, relational, validation
from tidemark.sources import scans
from tidemark.streaming import cdc

ROOT = Path(__file__).resolve().parent.parent


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (lambda x: tsql.len_(x), "ab  ", 2), (lambda x: tsql.len_(x), None, None), (lambda x: tsql.datalength(x, wide=True), "é\U0001f600", 6),
        (lambda x: tsql.charindex("b", x), "abcb", 2), (lambda x: tsql.charindex("b", x, 3), "abcb", 4), (lambda x: tsql.charindex("z", x), "abc", 0), (lambda x: tsql.charindex("a", x, -4), "abc", 1),
        (lambda x: tsql.patindex("%[0-9]%", x), "ab7", 3), (lambda x: tsql.patindex("b%", x), "abc", 0), (lambda x: tsql.patindex("%c", x), "abc", 3), (lambda x: tsql.patindex("%_c%", x), "abc", 2), (lambda x: tsql.patindex("%[^a-z]%", x), "ab.c", 3),
        (lambda x: tsql.substring(x, 0, 3), "abcd", "ab"), (lambda x: tsql.substring(x, -5, 3), "abcd", ""), (lambda x: tsql.right(x, 2), "a", "a"), (lambda x: tsql.right(x, 0), "abc", ""),
        (lambda x: tsql.stuff(x, 9, 1, "z"), "abc", None), (lambda x: tsql.stuff(x, 1, 0, "z"), "abc", "zabc"), (lambda x: tsql.concat(x, F.lit("b")), None, "b"), (lambda x: tsql.concat_plus(x, F.lit("b")), None, None),
        (lambda x: tsql.quotename(x), "a]b", "[a]]b]"), (lambda x: tsql.isnumeric(x), " -1.5e3", 1), (lambda x: tsql.isnumeric(x), "1,2", 0), (lambda x: tsql.isnumeric(x), None, 0), (lambda x: tsql.try_cast(x, "int"), "x", None),
        (lambda x: tsql.str_(x.cast("double"), 6, 1), "12.34", "  12.3"), (lambda x: tsql.str_(x.cast("double"), 3, 1), "1234.5", "***"), (lambda x: tsql.choose(x.cast("int"), "a", "b"), "3", None), (lambda x: tsql.choose(x.cast("int"), "a", "b"), "0", None),
        (lambda x: tsql.isjson(x), "{}", 1), (lambda x: tsql.isjson(x), "{", 0), (lambda x: tsql.isjson(x), None, None), (lambda x: tsql.json_query(x, "$.a"), '{"a": 1}', None), (lambda x: tsql.format_number(x.cast("double"), "C2"), "-1234.5", "-$1,234.50"),
        (lambda x: tsql.datediff("week", x.cast("timestamp_ntz"), F.lit("2024-01-07").cast("timestamp_ntz")), "2024-01-06", 1), (lambda x: tsql.datediff("hour", x.cast("timestamp_ntz"), F.lit("1969-12-31 23:00:00").cast("timestamp_ntz")), "1969-12-31 22:59:59", 1),
        (lambda x: tsql.dateadd("month", 1, x).cast("string"), "2024-01-31", "2024-02-29 00:00:00"), (lambda x: tsql.dateadd("quarter", -1, x).cast("string"), "2024-05-31", "2024-02-29 00:00:00"), (lambda x: tsql.datepart("week", x.cast("timestamp_ntz")), "2024-01-07", 2),
        (lambda x: masking.partial_email(x), "a@b@c.d", "a***@b@c.d"), (lambda x: masking.partial_email(x), "@b.c", "*@b.c"), (lambda x: masking.partial_email(x), "none", masking.REDACTED), (lambda x: masking.partial_email(x), None, None),
        (lambda x: masking.last_four(x), "12", "****"), (lambda x: masking.last_four(x), "1-2345", "****2345"), (lambda x: masking.fpe_numeric(x), "none", "***REDACTED***"), (lambda x: masking.last_four(x), None, None), (lambda x: masking.money_to_decimal(x), "$1,234.5", decimal.Decimal("1234.5000")), (lambda x: masking.money_to_decimal(x), "free", None),
        (lambda x: masking.strip_trailing_nulls(x), "a\u0000b\u0000", "a\u0000b"), (lambda x: masking.redact(x), None, None), (lambda x: cdc.lsn_text(cdc.lsn_hex(x)), "0xA:1:2", "0x0000000a:00000001:0002"),
    ],
)
def test_functions(spark, make, value, want):
    assert one(spark, value).select(make(F.col("x"))).first()[0] == want


def test_fpe_keeps_the_shape_and_is_stable(spark):
    df = spark.createDataFrame([("12-34 ab",), ("",), (None,), ("9999",)], "x string").select("x", masking.fpe_numeric(F.col("x")).alias("a"), masking.fpe_numeric(F.col("x"), "salt").alias("b"))
    for x, a, b in df.collect():
        assert (x is None) == (a is None)
        assert x is None or [c if not c.isdigit() else "9" for c in x] == [c if not c.isdigit() else "9" for c in a]
        assert not x or not x.isdigit() or a != x or b != x


def test_mask_policy_is_strict():
    with pytest.raises(ValueError, match="email"):
        masking.mask_policy(["email"], "strict", {"email": "identity"})
    assert masking.mask_policy(["email", "id"], "auto", {}) == {"email": "hash"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-50, 200), min_size=1, max_size=20), st.integers(1, 60))
def test_chunks_tile_their_keys(spark, keys, size):
    rows = chunking.int_chunks(spark.createDataFrame([(k,) for k in keys], "k long"), "k", size).orderBy("chunk_id").collect()
    assert rows[0]["start"] == min(keys) and rows[-1]["end"] == max(keys)
    assert all(a["end"] + 1 == b["start"] for a, b in zip(rows, rows[1:]))
    assert all(0 <= r["end"] - r["start"] < size for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, v double, s string")
    assert chunking.int_chunks(none, "k", 10).collect() == []
    assert scans.scan_delta(none, none, "k").collect() == []
    assert validation.count_level(none, none).first()["status"] == "PASSED"
    assert [r["status"] for r in validation.aggregate_level(none, none, ["v"]).collect()] == ["PASSED"]
    assert validation.range_level(none, none, "k", 10, ["v"]).collect() == []
    assert relational.equal_ranges(none, "k", 4).collect() == []
    assert relational.top_with_ties(none, 3, F.col("k")).collect() == []
    assert relational.pivot_found(none, ["k"], "s", F.sum("v")).collect() == []


def test_pieces_of_long_texts(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "ab" * 5000)], "k long, t string")
    back = {r["k"]: r["t"] for r in scans.join_pieces(scans.read_in_pieces(df, "k", "t", 3), "k", "t").collect()}
    assert back == {1: "abcdefg", 2: "", 4: "ab" * 5000}


def test_merge_with_nulls_and_deletes(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, None)], "k long, n string, v double")
    s = spark.createDataFrame([(2, "x", None), (4, "new", 4.0)], "k long, n string, v double")
    assert sorted(map(tuple, loads.merge(t, s, ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "b", None), (3, None, None), (4, "new", 4.0)]
    assert sorted(map(tuple, loads.merge(t, s, ["k"], ["n", "v"], delete_unmatched=True).collect())) == [(2, "x", None), (4, "new", 4.0)]


def test_differences_know_nulls(spark):
    s = spark.createDataFrame([(1, None), (2, 1.0), (3, None)], "k long, v double")
    t = spark.createDataFrame([(1, None), (2, None), (4, 1.0)], "k long, v double")
    assert {r["k"]: r["state"] for r in relational.keyed_difference(s, t, ["k"], ["v"]).collect()} == {1: "match", 2: "changed", 3: "missing_in_target", 4: "missing_in_source"}
    assert validation.result_difference(s.select("v"), t.select("v")).collect() == []
    assert {r["status"] for r in validation.aggregate_level(s, t.limit(0), ["v"]).collect()} == {"FAILED"}


def test_estimated_counts(spark):
    df = spark.range(1000)
    assert validation.count_level(df, df, estimate=1090).first()["status"] == "PASSED"
    assert validation.count_level(df, df, estimate=1101).first()["status"] == "FAILED"


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("x", "x")], "src string, dst string")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    assert sorted(map(tuple, metadata.cycles(edges).collect())) == [("a", "a"), ("b", "a")]
    assert {r["node"]: r["level"] for r in metadata.levels(nodes, edges.where("src <> dst")).collect()} == {"d": 0, "e": 1, "x": 0}
    assert metadata.topological_order(nodes, edges).collect() == []


def test_states_refuse_unknown_events():
    with pytest.raises(ValueError, match="RESUME"):
        cdc.run_states(["START", "RESUME"])
    with pytest.raises(ValueError, match="FAILED"):
        cdc.run_states(["START", "FAIL", "CATCHUP_DONE"])
    assert cdc.run_states(["START", "FAIL", "CATCHUP_DONE"], failed_may_catch_up=True)[-1][3] == "CDC_CATCHUP"


CHANGE = "k long, v string, operation int, lsn string, seq long, table_name string"


def write_changes(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, v, op, f"{lsn:020x}", seq, "t") for k, v, op, lsn, seq in rows], CHANGE).coalesce(1).write.mode("append").parquet(f"{folder}")


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    first = [[(1, "a", 2, 1, 1), (2, "b", 2, 1, 2), (3, "c", 2, 2, 1)], [(1, "old", 3, 3, 1), (1, "a2", 4, 3, 2), (2, "b", 1, 4, 1), (2, "b", 1, 4, 1)]]
    second = [[(2, "again", 2, 9, 1), (3, "late", 4, 1, 9), (4, "d", 2, 9, 2)]]
    source, target, points = (str(tmp_path / n) for n in ("source", "target", "points"))
    run = lambda: cdc.run_stream(spark, source, CHANGE, target, points, ["k"], ["v"], files_per_batch=1).awaitTermination()
    write_changes(spark, source, first)
    run()
    write_changes(spark, source, second)
    run()
    run()
    versions = sorted(int(p.name.split("=")[1]) for p in Path(target).iterdir())
    assert versions == [0, 1, 2]
    found = {r["k"]: r["v"] for r in cdc.current_rows(spark, target, versions[-1], ["k"], ["v"]).collect()}
    events = cdc.deduplicate(cdc.decode(spark.read.parquet(source)))
    batch = {r["k"]: r["v"] for r in cdc.apply_changes(spark.createDataFrame([], "k long, v string"), events, ["k"], ["v"]).collect()}
    assert found == batch == {1: "a2", 2: "again", 3: "c", 4: "d"}


@pytest.mark.parametrize("fold", [1, 2, 3])
def test_folded_versions_hold_the_whole_log(spark, tmp_path, fold):
    source, target, points = (str(tmp_path / n) for n in ("source", "target", "points"))
    parts = [[(k, f"v{n}", 4, n + 1, 1) for k in range(n % 2, 10, 2)] for n in range(5)]
    write_changes(spark, source, [*parts, [(3, "gone", 1, 9, 1)]])
    cdc.run_stream(spark, source, CHANGE, target, points, ["k"], ["v"], files_per_batch=1, fold=fold).awaitTermination()
    found = {r["k"]: r["v"] for r in cdc.current_rows(spark, target, 5, ["k"], ["v"], fold=fold).collect()}
    assert found == {k: "v3" if k % 2 else "v4" for k in range(10) if k != 3}


def test_pages_number_all_events_of_each_table(spark):
    rows = [(t, None if n % 50 == 0 else f"{(n * 7919) % 997 << (40 if t == 'a' else 0):020x}", n) for t in ("a", "b", None) for n in range(500)]
    found = cdc.pages(spark.createDataFrame(rows, "table_name string, lsn string, seq long"), 30, ranges=8).collect()
    for t in ("a", "b", None):
        own = sorted((r for r in found if r["table_name"] == t), key=lambda r: (r["lsn"] is not None, r["lsn"] or "", r["seq"]))
        assert [r["page"] for r in own] == [i // 30 for i in range(500)]


@pytest.mark.parametrize(("rows", "wanted"), [(0, 0), (7, 7), (400, 300)])
def test_hash_sample_has_its_size(spark, rows, wanted):
    df = spark.range(300).withColumnRenamed("id", "k")
    found = [r["k"] for r in relational.hash_sample(df, "k", rows, 300).collect()]
    assert len(found) == len(set(found)) == wanted
    assert relational.hash_sample(df.where("k < 0"), "k", rows, 0).collect() == []


def test_checksum_tells_nulls_and_separators_apart(spark):
    sums = {str(r): relational.checksum(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first()["checksum"] for r in ((None, "x"), ("", "x"), ("a|b", "c"), ("a", "b|c"), ("-", "x"))}
    assert len(set(sums.values())) == 5


def test_late_events_do_not_bring_deleted_rows_back(spark):
    empty = spark.createDataFrame([], "k long, v string, last_lsn string, last_seq long, deleted boolean")
    event = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, op string, lsn string, seq long")
    target = cdc.apply_idempotent(empty, event((1, "a", "DELETE", "05", 1)), ["k"], ["v"])
    target = cdc.apply_idempotent(target, event((1, "a", "UPDATE", "04", 1)), ["k"], ["v"])
    assert target.where("NOT deleted").collect() == []


def test_filters_and_columns_reach_the_scan(spark):
    plan = scans.scan_key_range(scans.table(spark, "/root/testdata/sf0.001", "orders"), "o_orderkey", 5, 9, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", "metastore_db"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'val_l3_chunk' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_equal_ranges_are_exact_on_large_and_repeated_keys(spark):
    n = 1_500_000
    shuffled = spark.range(n).select(((F.col("id") * 700_001) % n).alias("k"))
    found = sorted(tuple(r) for r in relational.equal_ranges(shuffled, "k", 8).collect())
    assert found == [(b + 1, b * n // 8, (b + 1) * n // 8 - 1, n // 8) for b in range(8)]
    assert sorted(tuple(r) for r in relational.equal_ranges(shuffled, "k", 8, unique=True).collect()) == found
    keys = sorted([5] * 11 + [7] * 3 + [1, 2, 9])
    found = sorted(tuple(r) for r in relational.equal_ranges(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 4).collect())
    cut = [[k for i, k in enumerate(keys) if i * 4 // len(keys) == b] for b in range(4)]
    assert found == [(b + 1, x[0], x[-1], len(x)) for b, x in enumerate(cut)]


def test_keys_beyond_doubles(spark):
    keys = [2**60 + k for k in range(0, 1000, 7)] + [-(2**60) - 3, -1, 0]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r["k"]: r["c"] for r in df.select("k", relational.floor_div(F.col("k"), 200).alias("c")).collect()}
    assert found == {k: k // 200 for k in keys}


def test_events_of_several_tables_stay_apart(spark):
    rows = [("orders", "00a", 1, "INSERT", 1), ("lines", "00a", 1, "INSERT", 2), ("orders", "00a", 1, "INSERT", 1), ("orders", None, 1, "INSERT", 1), ("orders", None, 1, "INSERT", 2), ("orders", None, 1, "INSERT", 2)]
    df = spark.createDataFrame(rows, "table_name string, lsn string, seq long, op string, k int")
    assert sorted(map(repr, map(tuple, cdc.deduplicate(df).collect()))) == sorted(map(repr, set(rows)))


def test_every_uuid_is_in_a_band(spark):
    found = {r["band"]: r["rows"] for r in chunking.uuid_chunks(spark.createDataFrame([("zz",), ("0a",), (None,), ("0B",), ("",)], "u string"), "u").collect()}
    assert found == {"other": 2, "0": 2, "null": 1}


def test_values_at_exact_places(spark):
    draw = random.Random(5)
    rows = [(g, draw.choice([None, *range(40)]) if g else draw.random()) for g in (0, 1, None) for _ in range(500)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g int, v double")
    n = F.col("n")
    found = {r["g"]: (r["low"], r["mid"], r["top"]) for r in relational.values_at(df, "g", "v", low=n * 0, mid=F.floor(n * 0.5), top=n - 1).collect()}
    for g in (0, 1, None):
        values = sorted(float(v) for h, v in rows if h == g and v is not None)
        assert found[g] == (values[0], values[len(values) // 2], values[-1])


def test_key_samples_see_rows_of_either_side(spark):
    s = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 2.0, "y"), ("c", None, 3.0, None)], "p string, q int, v double, w string")
    t = spark.createDataFrame([("a", 1, 1.0, "z"), ("c", None, 3.0 + 1e-12, None), ("d", 2, 1.0, "n")], "p string, q int, v double, w string")
    found = sorted((r["p"], r["state"], r["columns"]) for r in validation.key_sample(s, t, ["p", "q"], 1.0, ["v", "w"], ["v"]).collect())
    assert found == [("a", "mismatch", "w"), ("b", "missing_in_target", ""), ("c", "match", ""), ("d", "missing_in_source", "")]


def test_migration_rules_take_nulls_and_any_case(spark):
    columns = spark.createDataFrame([("a", "NText"), ("a", None), ("b", "GEOGRAPHY")], "table_name string, type string")
    tables = spark.createDataFrame([("a", None, None), ("b", True, 1)], "table_name string, has_key boolean, triggers int")
    found = sorted(map(tuple, metadata.premigration_issues(columns, tables).collect()))
    assert found == [("a", "deprecated_type"), ("a", "no_primary_key"), ("b", "active_triggers"), ("b", "unsupported_type")]
    assert metadata.premigration_issues(columns.limit(0), tables.limit(0)).collect() == []
    plan = spark.createDataFrame([("f", "FOREIGN_KEY"), ("i", "index"), ("x", None)], "name string, kind string")
    assert sorted(map(tuple, metadata.constraint_plan(plan).collect())) == [("f", "disable"), ("i", "drop_and_rebuild"), ("x", "keep")]
    kinds = "name string, type string, nullable boolean, target_type string, target_nullable boolean"
    rows = [("a", "int", None, "int", False), ("b", "int", True, "int", None), ("c", None, False, None, None), ("d", "alias_type", False, "int", False)]
    found = dict(map(tuple, metadata.transfer_preflight(spark.createDataFrame(rows, kinds)).collect()))
    assert found == {"a": "blocker:nulls", "b": "ok", "c": "blocker:missing", "d": "warning:alias"}


def test_pages_join_no_table_on_one_task(spark):
    rows = [("a", f"{n:020x}", 1) for n in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cdc.pages(spark.createDataFrame(rows, "table_name string, lsn string, seq long"), 30)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
