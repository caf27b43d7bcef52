"""Comparisons, loads, graphs, chunk plans and assessments against brute force and on odd rows."""

import datetime
import hashlib
import json
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import masking, tsql
from tidemark.operators import chunking, graphs, loads, metadata, relational, validation
from tidemark.catalog import ORACLE_SQL, QUERIES
from tidemark.sources import scans

SF = "/root/testdata/sf0.001"
nan, inf = float("nan"), float("inf")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- digests and comparisons


def test_stream_hash_tells_nulls_and_separators_apart(spark):
    kind = "k long, a string, b string"
    tables = [[(1, "a|b", "c")], [(1, "a", "b|c")], [(1, None, "c")], [(1, "\\N", "c")], [(1, "", "c")], [(2, "a", "c")], [(1, "a", "c")], [(1, "a", "c"), (1, "a", "c")], [(None, "a", "c")]]
    found = [relational.stream_hash(spark.createDataFrame(t, kind), ["k"], ["a", "b"]).first()["digest"] for t in tables]
    assert len(set(found)) == len(tables)
    rows = [(i if i % 5 else None, f"v{i}", None) for i in range(200)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    a, b = (relational.stream_hash(spark.createDataFrame(r, kind).repartition(n), ["k"], ["a", "b"], block=7).first()["digest"] for r, n in ((rows, 2), (shuffled, 5)))
    assert a == b


def test_a_table_with_null_keys_equals_itself(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (1, None, 2.0), (2, "z", nan), (3, "w", inf)], "k long, v string, d double")
    assert {r["state"] for r in relational.keyed_difference(df, df, ["k"], ["v", "d"]).collect()} == {"match"}
    assert [tuple(r) for r in validation.hash_level(df, df, "k", ["v", "d"]).collect()] == [("match", 4)]
    assert {r["status"] for r in validation.range_level(df, df, "k", 10, ["d"]).collect()} == {"PASSED"}


@pytest.mark.parametrize(("source", "target", "status"), [(nan, None, "FAILED"), (nan, nan, "PASSED"), (inf, -inf, "FAILED"), (1e26, 1e26, "PASSED"), (1e26, 2e26, "FAILED"), (1e26, None, "FAILED"), (5.0, 5.0, "PASSED"), (None, None, "PASSED")])
def test_ranges_tell_odd_doubles_apart(spark, source, target, status):
    s, t = (spark.createDataFrame([(1, x), (2, 3.5)], "k long, v double") for x in (source, target))
    assert [r["status"] for r in validation.range_level(s, t, "k", 10, ["v"]).collect()] == [status]


def test_digests_find_what_a_join_finds(spark):
    draw = random.Random(2)
    rows = {k: (f"v{draw.randrange(9)}", draw.randrange(5)) for k in draw.sample(range(-3000, 200_000), 900)}
    other = dict(rows)
    for k in draw.sample(sorted(rows), 6):
        other.pop(k) if k % 2 else other.__setitem__(k, ("new", rows[k][1]))
    other[500_000] = ("more", 1)
    kind = "k long, v string, n int"
    s, t = (spark.createDataFrame([(k, *v) for k, v in d.items()] + [(None, "x", 1)], kind).repartition(3) for d in (rows, other))
    wrong = {k: "missing_in_target" if k not in other else "missing_in_source" if k not in rows else "changed" for k in {*rows, *other} if rows.get(k) != other.get(k)}
    found = validation.compare_by_digests(s, t, ["k"], ["v", "n"], 10).first()
    assert found["status"] == "FAILED" and found["differences"] == len(wrong) and found["first_k"] == min(wrong) and found["first_state"] == wrong[min(wrong)]
    assert found["differing_ranges"] == len({k // 10 for k in wrong}) and found["rows_compared"] <= 20 * len(wrong)
    assert found["source_rows"] == 901 and len(validation.digest_tree(s, ["k"], ["v"], 10).levels) >= 3
    same = validation.compare_by_digests(s, s.repartition(5), ["k"], ["v", "n"], 10).first()
    assert same["status"] == "PASSED" and same["rows_compared"] == same["differences"] == same["differing_ranges"] == 0 and same["first_k"] is None
    texts = [df.select(F.col("k").cast("string").alias("k"), "v", "n") for df in (s, t)]
    assert validation.compare_by_digests(*texts, ["k"], ["v", "n"]).first()["differences"] == len(wrong)
    empty = validation.compare_by_digests(s.limit(0), s.limit(0), ["k"], ["v"]).first()
    assert empty["status"] == "PASSED" and empty["source_digest"] is None


def test_values_at_places_are_those_of_a_sort(spark):
    draw = random.Random(6)
    groups = {g: [draw.choice([draw.randrange(50), draw.randrange(10_000), 7]) for _ in range(n)] for g, n in (("a", 3000), ("b", 1), (None, 400), ("same", 0))}
    groups["same"] = [5] * 200
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    found = relational.values_at(spark.createDataFrame(rows, "g string, v long").repartition(4), "g", "v", 16, low=F.lit(0), mid=F.call_function("div", F.col("n"), F.lit(2)), far=F.floor(F.col("n") * 0.95), beyond=F.col("n")).collect()
    assert {r["g"]: tuple(r)[1:] for r in found} == {g: (x[0], x[len(x) // 2], x[int(len(x) * 0.95)], None) for g, x in ((g, sorted(v)) for g, v in groups.items())}
    assert relational.values_at(spark.createDataFrame([("a", 1)], "g string, v long"), "g", "v", at=F.lit(9)).collect() == [("a", None)]


# ---- loads and functions


def test_repeated_keys_of_a_load_are_refused_or_the_last_counts(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    staged = spark.createDataFrame([(1, None, 1), (1, "z", 2), (3, "c", 1)], "k long, v string, at int")
    for load in (lambda s, **m: loads.upsert(target, s, ["k"], **m), lambda s, **m: loads.merge(target, s, ["k"], ["v"], **m)):
        with pytest.raises(Exception, match="repeated key"):
            load(staged.drop("at")).collect()
        assert sorted(map(tuple, load(staged, last_by="at").select("k", "v").collect())) == [(1, "z"), (2, "b"), (3, "c")]
        assert sorted(map(tuple, load(staged.drop("at").where("k <> 1")).collect())) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize(
    ("text", "key", "value", "want"),
    [
        ('{"k": 87, "o": {"a": 1}}', "t", lambda: F.lit("x"), {"k": 87, "o": {"a": 1}, "t": "x"}), ('{"k": 87, "b": true, "n": null, "l": [1, "2"]}', "k", lambda: F.lit(5), {"k": 5, "b": True, "n": None, "l": [1, "2"]}),
        ('{"k": 1, "t": 2}', "t", lambda: F.lit(None).cast("string"), {"k": 1}), ("{}", "a", lambda: F.array(F.lit(1), F.lit(2)), {"a": [1, 2]}), ("[1]", "a", lambda: F.lit(1), None), ("broken", "a", lambda: F.lit(1), None), (None, "a", lambda: F.lit(1), None),
    ],
)
def test_json_modify_keeps_types(spark, text, key, value, want):
    found = spark.createDataFrame([(text,)], "x string").select(tsql.json_modify(F.col("x"), key, value())).first()[0]
    assert (json.loads(found) if found else found) == want


def test_numbers_are_masked_by_their_digits_alone(spark):
    df = spark.createDataFrame([("4111-1111",), ("4111 1111",), ("41111111",), (None,), ("",)], "x string")
    a, b, c, d, e = (r[0] for r in df.select(masking.fpe_numeric(F.col("x"))).collect())
    assert a.replace("-", "") == b.replace(" ", "") == c != "41111111" and a[4] == "-" and d is None and e == ""


def test_csv_html_and_offload(spark):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "<&>", "x\ny")], "k long, v string, w string")
    assert loads.as_csv_lines(df).first()[0] == '1,"a ""b"", c",'
    assert [r[0] for r in loads.as_html_rows(df).collect()][1].startswith("<tr><td>2</td><td>&lt;&amp;&gt;</td>")
    tables = spark.createDataFrame([("rows", 2_000_000, None, False), ("mb", 1, 256.0, None), ("small", 1_999_999, 255.9, False), ("near", 10**9, 1e6, True), ("unknown", None, None, None)], "table_name string, rows long, mb double, same_server boolean")
    assert {r[0]: r[1] for r in loads.offload_plan(tables).collect()} == {"rows": "files", "mb": "files", "small": "copy", "near": "copy", "unknown": "copy"}
    assert {r[1] for r in loads.offload_plan(tables, enabled=False).collect()} == {"copy"}


def test_long_texts_stay_in_their_rows(spark):
    df = scans.in_pieces(spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "k long, t string"), "t", 3)
    found = {r["k"]: r["pieces"] for r in df.collect()}
    assert found[1] == ["abc", "def", "g"] and found[2] == [""] and found[3] in (None, [None])
    assert "Exchange" not in plan_of(QUERIES["scan_lob_chunks"](spark, SF))


def test_maps_pivot_any_number_of_values(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    rows = relational.pivot_map(df, ["g"], "k", F.count("*")).collect()
    assert sum(len(r["values"]) for r in rows) == 5000
    with pytest.raises(ValueError, match="pivot_map"):
        relational.pivot_found(df, ["g"], "k", F.count("*"))


def test_table_functions_become_joins(spark):
    plan = plan_of(QUERIES["udtf_lateral"](spark, SF))
    assert "Join" in plan and "Python" not in plan and "Nested" not in plan
    assert "EqualTo(o_custkey,7)" in plan_of(QUERIES["udtf_inline"](spark, SF))


# ---- chunks


def test_weighted_chunks_tile_skewed_keys(spark):
    keys = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 1000).when(F.col("id") % 7 == 0, 77_777).otherwise(F.col("id") * 31 - 5000).alias("k"))
    chunks = chunking.rows_by_chunk(chunking.weighted_chunks(keys, "k", 20), keys, "k").orderBy("start").collect()
    assert all(b["start"] == a["end"] + 1 for a, b in zip(chunks, chunks[1:])) and sum(r["rows"] for r in chunks) == 200_000
    assert sorted(r["rows"] for r in chunks)[-2] < 1.3 * 10_000 and max(r["rows"] for r in chunks) < 14_286 + 1.3 * 10_000
    odd = spark.createDataFrame([(5,), (5,), (None,)], "k long")
    assert [tuple(r) for r in chunking.rows_by_chunk(chunking.weighted_chunks(odd, "k", 4), odd, "k").collect()] == [(0, 5, 5, 2)]
    assert chunking.weighted_chunks(odd.limit(0), "k", 4).collect() == []
    counted = chunking.measured(chunking.int_chunks(odd, "k", 3), odd, "k", 3).collect()
    assert [tuple(r) for r in counted] == [(0, 5, 5, 2)]


# ---- graphs


def reach(edges, nodes):
    """All nodes that a path of at least one edge leads to, by node."""
    found = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        found = {n: found[n].union(*(found[m] for m in found[n])) for n in nodes}
    return found


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=26))
def test_components_and_levels_of_any_graph(spark, edges):
    frame = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    nodes = sorted({x for e in edges for x in e})
    below = reach(set(edges), nodes)
    mutual = {n: {m for m in below[n] if n in below[m]} | {n} for n in nodes}
    want = {n: min(c) for n, c in mutual.items() if len(c) > 1}
    assert {r["member"]: r["component"] for r in graphs.cycles(frame).collect()} == want
    looped = {n for n in nodes if n in below[n]}
    stuck = looped | {m for n in looped for m in below[n]}
    level = {}
    for _ in nodes:
        level = {n: 1 + max((level.get(a, 0) for a, b in set(edges) if b == n), default=-1) for n in nodes if n not in stuck}
    found = {r["node"]: r["level"] for r in graphs.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), frame).collect()}
    assert found == level


def test_order_numbers_levels_without_one_window(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "dcbae"], "node string")
    assert [(r["node"], r["position"]) for r in graphs.topological_order(nodes, edges).orderBy("position").collect()] == [("a", 1), ("b", 2), ("e", 3), ("c", 4), ("d", 5)]
    many = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"))
    assert graphs.numbered(many.repartition(7), "k").where("position <> k + 1").count() == 0


def test_severities_of_a_deep_chain_reach_its_root(spark):
    n = 1000
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "blocker" if i == n - 1 else "match") for i in range(n)]
    more = [("leaf", "n3", "warning"), ("orphan", "nobody", "info"), ("x", "y", "warning"), ("y", "x", "match"), (None, "n1", "blocker"), ("twice", "n5", "info"), ("twice", "n5", "unknown")]
    found = {r["id"]: r["worst"] for r in graphs.worst_below(spark.createDataFrame(chain + more, "id string, parent string, severity string")).collect()}
    assert all(found[f"n{i}"] == "blocker" for i in range(n))
    assert (found["leaf"], found["orphan"], found["nobody"], found["x"], found["y"], found["twice"]) == ("warning", "info", "info", "warning", "warning", "info") and None not in found


# ---- assessments


def test_tables_are_blocked_warned_of_or_safe(spark):
    tables = [("safe", False, False, 100, True), ("typed", False, False, 100, True), ("keyless", None, None, None, None), ("temporal", True, False, 0, True), ("huge", False, False, 200_000_000, True), ("large", False, False, 5000, True), ("bare", False, False, 10, False)]
    columns = [("safe", "id", "int", 4, None, False), ("typed", "h", "hierarchyid", 8, None, False), ("keyless", "x", "int", 4, None, None), ("temporal", "x", "int", 4, None, False), ("huge", "x", "int", 4, None, False), ("large", "doc", "nvarchar", -1, None, False), ("large", "email", "varchar", 50, "latin1_general_ci_as", True)]
    found = {r["table_name"]: (r["score"], r["tier"], r["blockers"], r["warnings"], r["minutes"]) for r in metadata.assess_tables(spark.createDataFrame(tables, "table_name string, is_temporal boolean, in_memory boolean, row_count long, has_key boolean"), spark.createDataFrame(columns, "table_name string, column_name string, type string, max_length int, collation_name string, is_computed boolean")).collect()}
    assert found == {"safe": (0, "SAFE", 0, 0, 0.1), "typed": (40, "BLOCKER", 1, 0, 0.1), "keyless": (50, "BLOCKER", 1, 0, 0.1), "temporal": (20, "WARNING", 0, 1, 0.1), "huge": (20, "WARNING", 0, 1, 3333.33), "large": (21, "WARNING", 0, 4, 1.0), "bare": (0, "SAFE", 0, 0, 0.1)}


@pytest.mark.parametrize(
    ("body", "function", "want"),
    [
        ("SELECT 1", False, ("simple", 10, 2.0, 0, "SAFE")), ("SELECT 1", True, ("simple", 10, 2.0, 0, "WARNING")), ("SELECT 'CURSOR ''MERGE'''", False, ("simple", 10, 2.0, 0, "SAFE")),
        ("EXEC dbo.p", False, ("moderate", 35, 5.0, 0, "WARNING")), ("declare c cursor for select 1", False, ("complex", 55, 15.0, 0, "WARNING")), ("exec sp_executesql @q", False, ("extreme", 100, 30.0, 1, "BLOCKER")),
        ("create assembly a", False, ("simple", 25, 2.0, 1, "BLOCKER")), ("select * from #t", False, ("moderate", 35, 5.0, 0, "WARNING")), ("select ##t", False, ("moderate", 35, 5.0, 0, "WARNING")),
        ("UNPIVOT (x)", False, ("complex", 55, 15.0, 0, "WARNING")), ("select x for json path", False, ("simple", 10, 2.0, 0, "WARNING")), (None, False, ("extreme", 100, 0.0, 1, "BLOCKER")), ("  ", True, ("extreme", 100, 0.0, 1, "BLOCKER")),
        ("@x int OUTPUT", False, ("complex", 55, 15.0, 0, "WARNING")), ("select @OutputFormat from sys.dm_exec_connections", False, ("simple", 10, 2.0, 0, "SAFE")),
    ],
)
def test_routines_are_as_hard_as_their_hardest_pattern(spark, body, function, want):
    row = metadata.assess_routines(spark.createDataFrame([("r", body, function)], "name string, body string, is_function boolean")).first()
    assert (row["difficulty"], row["score"], row["minutes"], row["blockers"], row["tier"]) == want


def test_compatibility_by_the_worst_issue(spark):
    rows = [("a", "view", "select 1", [], False), ("b", "procedure", "select 1", [], False), ("c", "trigger", "x", [], False), ("d", "view", "WAITFOR; merge", [], False), ("e", "view", "use clr", [], True), ("f", "table", "", ["Geometry", "int"], False), ("g", "view", "x", None, True), ("h", None, None, None, None)]
    found = {r["name"]: (r["issues"], r["status"], r["auto_percent"]) for r in metadata.analyze_compatibility(spark.createDataFrame(rows, "name string, kind string, definition string, types array<string>, slow boolean")).collect()}
    assert found == {"a": (0, "auto_convertible", 100.0), "b": (1, "auto_convertible", 90.0), "c": (1, "partial", 90.0), "d": (2, "partial", 80.0), "e": (2, "unsupported", 80.0), "f": (1, "risky", 90.0), "g": (1, "performance_risk", 90.0), "h": (0, "auto_convertible", 100.0)}


def test_phases_follow_the_weeks(spark):
    weeks = spark.createDataFrame([(2,), (24,)], "weeks int")
    assert [(r["phase"], r["weeks"]) for r in metadata.phases(weeks).collect()] == [(1, 1), (2, 2), (3, 1), (4, 2), (1, 6), (2, 12), (3, 6), (4, 2)]


def test_dates_are_told_in_reports(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 2), 1.5)], "d date, x double")
    assert loads.as_csv_lines(df).first()[0] == "2024-01-02,1.5"


def test_numbers_of_more_than_five_digits_are_masked_by_all_of_them(spark, tmp_path):
    keys = [1, 89_999, 90_000, 90_001, 899_999, 12_345_678, 9]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    moved = {k: "".join(str(int(h, 16) % 10) for h in hashlib.sha256(str(k + 10_000).encode()).hexdigest()[:5]) for k in keys}
    want = {k: "***REDACTED***" if k % 9 == 0 else f"{v[:2]}-{v[2:]} x" for k, v in moved.items()}
    assert {r["c_custkey"]: r["v"] for r in QUERIES["mask_fpe_digits"](spark, str(tmp_path)).collect()} == want


def test_alerts_reach_back_to_the_microsecond(spark, tmp_path):
    now = datetime.datetime(2024, 1, 30, 12, 0, 0, 500_000)
    back = [datetime.timedelta(0), datetime.timedelta(hours=72), datetime.timedelta(hours=72, microseconds=1), datetime.timedelta(hours=72, microseconds=400_000), datetime.timedelta(hours=71)]
    spark.createDataFrame([(12 * i, 1, now - b) for i, b in enumerate(back)], "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in QUERIES["ops_alerts"](spark, str(tmp_path)).collect()] == [("warning", 3)]


def test_the_root_digest_is_that_of_all_ranges_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("v"))
    tree = validation.digest_tree(df, ["k"], ["v"], 10)
    leaves = sorted((r["node"], r["digest"]) for r in tree.levels[0].collect())
    assert len(leaves) > validation.FANOUT
    assert tree.root == (hashlib.sha256(",".join(f"{n}:{d}" for n, d in leaves).encode()).hexdigest(), 1000)


def test_a_routine_is_searched_once_from_the_hardest_pattern_down(spark):
    texts = ["exec sp_executesql @q", "merge into t", "select 1 for json path", "select 1", None, "", "'cursor'", "goto a; fetch next"]
    df = spark.createDataFrame([(i, t, i == 3) for i, t in enumerate(texts)], "name int, body string, is_function boolean")
    found = metadata.assess_routines(df)
    assert [(r["difficulty"], r["tier"]) for r in found.orderBy("name").collect()] == [("extreme", "BLOCKER"), ("complex", "WARNING"), ("simple", "WARNING"), ("simple", "WARNING"), ("extreme", "BLOCKER"), ("extreme", "BLOCKER"), ("simple", "SAFE"), ("complex", "WARNING")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= len(metadata.ROUTINE_PATTERNS)


def test_levels_take_edges_as_they_are(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), (None, "a"), ("c", None)], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "cabd"], "node string")
    monkeypatch.setattr(graphs, "clean", lambda edges: pytest.fail("a shuffle of all edges"))
    found, whole = graphs.levels_found(nodes, edges)
    assert whole and {r["node"]: r["level"] for r in found.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    found, whole = graphs.levels_found(nodes, edges.unionByName(spark.createDataFrame([("c", "b")], edges.schema)))
    assert not whole and {r["node"] for r in found.collect()} == {"a", "d"}


def test_masked_numbers_keep_all_their_digits(spark, tmp_path):
    keys = [1, 89_999, 90_001, 899_999, 12_345_679, 9_000_000_000_000_000_001]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    want = {}
    for text in (str(k + 10_000) for k in keys):
        moved = "".join(str(int(h, 16) % 10) for h in hashlib.sha256(text.encode()).hexdigest()[: len(text)])
        want[int(text) - 10_000] = f"{moved[:2]}-{moved[2:]} x"
    assert {r["c_custkey"]: r["v"] for r in QUERIES["mask_fpe_digits"](spark, str(tmp_path)).collect()} == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        assert dict(con.execute(ORACLE_SQL["mask_fpe_digits"]).fetchall()) == want
