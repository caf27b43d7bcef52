"""Change capture end to end: stored target and positions, polls, snapshots, repeats and late events, with failures between."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.scratch import new_folder
from tidemark.streaming import cdc
from tidemark.streaming.poll import START, ChangeFiles, PollReader, pages_of, poll, poll_into
from tidemark.streaming.store import StoredTable, take_snapshot

EVENT = "k long, v string, op string, lsn string, seq long, table_name string"


def events(spark, *rows, table="t"):
    return spark.createDataFrame([(k, v, op, f"{lsn:020x}", seq, table) for k, v, op, lsn, seq in rows], EVENT)


def stored(spark, buckets=8):
    return StoredTable(spark, new_folder(spark, "test"), "k long, v string", ["k"], buckets)


def rows_of(table):
    return {r["k"]: r["v"] for r in table.rows().collect()}


def random_events(n, keys, seed):
    draw = random.Random(seed)
    return [(draw.randrange(keys), f"v{i}", draw.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), i // 3 + 1, i % 3) for i in range(n)]


def applied(rows):
    state = {}
    for k, v, op, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        state.pop(k, None) if op == "DELETE" else state.__setitem__(k, v)
    return state


def fail():
    raise OSError("lost")


def test_batches_in_any_order_end_alike(spark):
    rows, target = random_events(120, 20, 1), stored(spark)
    parts = [rows[i::3] for i in range(3)]
    random.Random(2).shuffle(parts)
    for i, part in enumerate(parts):
        assert target.apply(events(spark, *part), batch=i)
        assert not target.apply(events(spark, *rows), batch=i)
    assert rows_of(target) == applied(rows)


def test_a_failed_batch_leaves_the_version_before(spark):
    target = stored(spark)
    target.apply(events(spark, (1, "a", "INSERT", 1, 1), (2, "b", "INSERT", 2, 1)), batch=0)
    before, places = rows_of(target), target.positions().collect()
    with pytest.raises(OSError):
        target.apply(events(spark, (1, "x", "UPDATE", 3, 1), (3, "c", "INSERT", 4, 1)), batch=1, before_commit=fail)
    again = StoredTable(spark, target.path, "k long, v string", ["k"])
    assert rows_of(again) == before and again.positions().collect() == places and again.buckets == 8
    assert again.apply(events(spark, (1, "x", "UPDATE", 3, 1), (3, "c", "INSERT", 4, 1)), batch=1)
    assert rows_of(again) == {1: "x", 2: "b", 3: "c"}
    assert [tuple(r) for r in again.positions().collect()] == [("t", f"{4:020x}", 1, 4)]


def test_cost_goes_by_touched_buckets_and_old_versions_go(spark):
    target = stored(spark, 16)
    target.apply(events(spark, *[(k, "a", "INSERT", 1, k) for k in range(400)]))
    first = target.manifest()["folders"]
    target.apply(events(spark, (7, "b", "UPDATE", 2, 0)))
    second = target.manifest()["folders"]
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    assert len(files.names(spark, f"{target.path}/data/v2")) <= 4  # one bucket, and the marks of a finished write
    for i in range(3, 8):
        target.apply(events(spark, (7, f"c{i}", "UPDATE", i, 0)))
    there = {f"{v}/{b}" for v in files.names(spark, f"{target.path}/data") for b in files.names(spark, f"{target.path}/data/{v}") if b.startswith("_bucket")}
    assert there == {*target.manifest()["folders"].values(), *target.manifest(target.versions()[-2])["folders"].values()} and len(target.versions()) == 2
    assert target.rows().count() == 400 and rows_of(target)[7] == "c7"
    assert {r["k"]: r["v"] for r in target.rows(target.versions()[0]).collect()}[7] == "c6"


def test_tombstones_go_behind_the_horizon_and_hold_back_older_events(spark):
    target = stored(spark, 1)
    target.apply(events(spark, (1, "a", "DELETE", 5, 0), (2, "b", "INSERT", 5, 1)))
    target.apply(events(spark, (1, "old", "UPDATE", 4, 0)))
    assert rows_of(target) == {2: "b"} and target._stored(target.manifest()["folders"]).where("deleted").count() == 1
    target.apply(events(spark, (2, "c", "UPDATE", 9, 0)), horizon=f"{8:020x}")
    assert rows_of(target) == {2: "c"} and target._stored(target.manifest()["folders"]).where("deleted").count() == 0
    target.apply(events(spark, (2, "c", "DELETE", 10, 0)), horizon=f"{11:020x}")
    assert rows_of(target) == {} and target.manifest()["folders"] == {}


def test_ordered_sources_skip_what_is_stored_by_table(spark):
    target = stored(spark)
    both = events(spark, (1, "a", "INSERT", 3, 0)).unionByName(events(spark, (2, "b", "INSERT", 1, 0), table="u"))
    target.apply(both, ordered=True)
    target.apply(events(spark, (1, "old", "UPDATE", 2, 9), (3, "c", "INSERT", 3, 1)).unionByName(events(spark, (2, "d", "UPDATE", 2, 0), table="u")), ordered=True)
    assert rows_of(target) == {1: "a", 2: "d", 3: "c"}
    assert {r["table_name"]: (r["last_lsn"], r["last_seq"], r["rows_applied"]) for r in target.positions().collect()} == {"t": (f"{3:020x}", 1, 2), "u": (f"{2:020x}", 0, 2)}


def test_null_keys_empty_batches_and_repeats(spark):
    target = stored(spark)
    target.apply(events(spark))
    assert target.rows().collect() == [] and target.positions().collect() == []
    target.apply(events(spark, (None, "a", "INSERT", 1, 0), (None, "a", "INSERT", 1, 0), (None, "b", "UPDATE", 2, 0), (4, None, "INSERT", 3, 0)))
    assert rows_of(target) == {None: "b", 4: None} and target.positions().first()["rows_applied"] == 3


# ---- polls


def write_log(spark, rows, path, parts=3):
    events(spark, *rows).repartitionByRange(parts, "lsn").sortWithinPartitions("lsn", "seq").write.mode("append").parquet(path)


def test_polls_cut_the_log_by_position(spark):
    path, rows = new_folder(spark, "log"), random_events(100, 9, 3)
    write_log(spark, rows, path)
    found, at, pages = ChangeFiles(path), START, []
    while places := found.next_places(at, 7):
        pages.append(len(places))
        at = places[-1]
    assert pages == [7] * 14 + [2]
    ties = [(i, "x", "INSERT", 200, 5) for i in range(10)]
    write_log(spark, ties, path, 1)
    assert len(ChangeFiles(path).next_places(at, 3)) == 10  # events of one position are never parted
    reader = PollReader({"path": path, "limit": "30", "splits": "4"}, None)
    parts = reader.partitions({"lsn": "", "seq": -1}, {"lsn": f"{10:020x}", "seq": 2})
    read = [(b["lsn"].as_py(), b["seq"].as_py()) for p in parts for x in found.read(p.units, p.low, p.high, ["lsn", "seq"]) for b in [dict(zip(x.schema.names, r)) for r in zip(*x.columns)]]
    assert len(parts) == 4 and sorted(read) == [(f"{lsn:020x}", seq) for _, _, _, lsn, seq in rows[:30]]


def test_polls_into_a_table_survive_a_failure_between_rows_and_position(spark, monkeypatch):
    path, target, points, rows = new_folder(spark, "log"), stored(spark), new_folder(spark, "points"), random_events(90, 12, 4)
    write_log(spark, rows[:60], path)
    heard, broken = [], {2}
    whole = StoredTable.apply

    def sometimes(self, found, **more):
        if more["batch"] in broken:
            broken.discard(more["batch"])
            return whole(self, found, before_commit=fail, **more)
        return whole(self, found, **more)

    monkeypatch.setattr(StoredTable, "apply", sometimes)
    run = lambda: poll_into(target, poll(spark, path, 20, EVENT), points, 20, lambda *x: heard.append(x))
    stream = run()
    with pytest.raises(Exception, match="lost"):
        stream.processAllAvailable()
    write_log(spark, rows[60:], path)
    stream = run()
    stream.processAllAvailable()
    stream.stop()
    assert rows_of(target) == applied(rows) and target.positions().first()["rows_applied"] == 90
    assert [n for _, n, _ in heard] == [20, 20, 20, 20, 10] and [s for _, _, s in heard] == ["CDC_CATCHUP"] * 4 + ["CDC_STREAMING"]


# ---- snapshots


def test_snapshot_beside_a_running_log_and_after_an_interruption(spark):
    draw, rows, log = random.Random(5), {k: f"s{k}" for k in range(40)}, []
    clock = [0]

    def change(n):
        for _ in range(n):
            clock[0] += 1
            k, op = draw.randrange(50), draw.choice(["INSERT", "UPDATE", "DELETE"])
            log.append((k, f"c{clock[0]}", op, clock[0], 0))
            rows.pop(k, None) if op == "DELETE" else rows.__setitem__(k, f"c{clock[0]}")

    def position():
        change(4)
        return f"{clock[0]:020x}", 0

    def read(low, high):
        change(4)
        found = spark.createDataFrame([(k, v) for k, v in rows.items() if low <= k <= high], "k long, v string")
        if low == 25 and not interrupted:
            interrupted.append(True)
            raise OSError("lost")
        return found

    def between(after, until):
        return events(spark, *[e for e in log if after < (f"{e[3]:020x}", e[4]) <= until])

    interrupted, target, chunks = [], stored(spark), [(0, 12), (13, 24), (25, 37), (38, 60)]
    with pytest.raises(OSError):
        take_snapshot(target, "orders", chunks, read, position, between)
    take_snapshot(target, "orders", chunks, read, position, between)
    take_snapshot(target, "orders", chunks, read, position, between)  # nothing is left to do
    end = tuple(target.manifest()["positions"]["orders#3"][:2])
    change(5)
    target.apply(between(end, ("f" * 20, 0)))
    assert rows_of(target) == rows


# ---- repeats and late events


def batches(spark, path, *parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id long, ts timestamp").coalesce(1).write.parquet(f"{path}/part={i}")


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_repeats_go_and_state_stays_small(spark):
    path, to = new_folder(spark, "days"), new_folder(spark, "once")
    parts = [[(i * 10 + j, day(i)) for j in range(10)] + [((i - 1) * 10 + j, day(i - 1)) for j in range(4) if i] for i in range(12)]
    batches(spark, path, *parts)
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    query = cdc.drop_repeats(stream, "ts", "2 days", ["id"]).writeStream.format("parquet").option("path", to).option("checkpointLocation", new_folder(spark, "points")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(to).collect()) == list(range(120))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 50


def test_late_events_are_kept_apart_and_none_is_lost(spark):
    path, to, points = new_folder(spark, "days"), new_folder(spark, "late"), new_folder(spark, "points")
    parts = [[(1, day(1)), (2, day(5))], [(3, day(4)), (4, day(2)), (5, None)], [(6, day(20))], [(7, day(5)), (8, day(18))]]
    stream = lambda: spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    batches(spark, path, *parts[:2])
    cdc.keep_late(stream(), "ts", datetime.timedelta(days=2), to, points).awaitTermination()
    for i in (2, 3):
        spark.createDataFrame(parts[i], "id long, ts timestamp").coalesce(1).write.parquet(f"{path}/part={i}")
    cdc.keep_late(stream(), "ts", datetime.timedelta(days=2), to, points).awaitTermination()
    ids = lambda name: sorted(r["id"] for r in spark.read.schema("id long").parquet(f"{to}/{name}/batch=*").collect())
    assert ids("late") == [4, 7] and ids("on_time") == [1, 2, 3, 5, 6, 8]


def test_change_folders_of_files_apply_once(spark):
    source, target, points, rows = new_folder(spark, "files"), stored(spark), new_folder(spark, "points"), random_events(60, 8, 6)
    codes = {"DELETE": 1, "INSERT": 2, "UPDATE": 4}
    change = "k long, v string, operation int, lsn string, seq long"
    frame = spark.createDataFrame([(k, v, codes[op], f"{lsn:020x}", seq) for k, v, op, lsn, seq in rows] + [(1, "before", 3, f"{99:020x}", 0)], change)
    frame.repartition(4).write.parquet(source)
    for _ in range(2):
        cdc.apply_files(spark, source, change, target, points, files_per_batch=1).awaitTermination()
    assert rows_of(target) == applied(rows) and target.versions()[-1] == 4
    assert target.positions().select(F.col("table_name")).first()[0] == "changes"


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_batch_of_many_polls_ends_where_single_polls_do(spark, monkeypatch, shuffled):
    path, rows = new_folder(spark, "log"), random_events(1000, 9, 8) + [(1, "tie", "INSERT", 334, 7)] * 3
    if shuffled:
        random.Random(1).shuffle(rows)
        events(spark, *rows).coalesce(5).write.parquet(path)
    else:
        events(spark, *rows).repartitionByRange(9, "lsn").sortWithinPartitions("lsn", "seq").write.parquet(path)
    events(spark, (1, "none", "INSERT", 1, 1)).withColumn("lsn", F.lit(None).cast("string")).write.mode("append").parquet(path)
    ordered = sorted((f"{e[3]:020x}", e[4]) for e in rows)
    for at_driver in (1_000_000, 60):
        monkeypatch.setattr("tidemark.streaming.poll.AT_DRIVER", at_driver)
        found, at, passed = ChangeFiles(path), START, 0
        while end := found.end_of_polls(at, 20, 7):
            read = sorted((r["lsn"], r["seq"]) for p in PollReader({"path": path, "limit": "20", "polls": "7", "splits": "3"}, None).partitions(dict(zip(("lsn", "seq"), at)), dict(zip(("lsn", "seq"), end))) for b in found.read(p.units, p.low, p.high, ["lsn", "seq"]) for r in b.to_pylist())
            assert read == ordered[passed : passed + len(read)] and (len(read) % 20 == 0 and 0 < len(read) <= 140 or passed + len(read) == len(ordered))
            assert at_driver == 60 or len(read) == 140 or passed + len(read) == len(ordered)
            at, passed = end, passed + len(read)
        assert passed == len(ordered)


def test_many_polls_take_few_batches(spark):
    path, to, rows = new_folder(spark, "log"), new_folder(spark, "polls"), random_events(1000, 9, 9)
    write_log(spark, rows[:905], path, 5)
    points = new_folder(spark, "points")
    for more in (None, rows[905:]):
        if more:
            write_log(spark, more, path, 1)
        stream = pages_of(spark, poll(spark, path, 10, EVENT, polls=40), to, points, 10)
        stream.processAllAvailable()
        stream.stop()
    pages = sorted((r["lsn"], r["seq"], r["page"]) for r in spark.read.schema(f"{EVENT}, page int").parquet(f"{to}/poll=*").collect())
    assert [p for _, _, p in pages] == [*[i // 10 for i in range(905)], *[91 + i // 10 for i in range(95)]]
    assert len([n for n in files.names(spark, to) if n.startswith("poll=")]) == 4


def test_state_of_repeats_lies_on_disk(spark):
    path, to = new_folder(spark, "days"), new_folder(spark, "once")
    batches(spark, path, *[[(i * 10 + j, day(i)) for j in range(10)] + [((i - 1) * 10 + j, day(i - 1)) for j in range(4) if i] for i in range(4)])
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    kept = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kept)
    with cdc.state_on_disk(spark):
        query = cdc.drop_repeats(stream, "ts", "2 days", ["id"]).writeStream.format("parquet").option("path", to).option("checkpointLocation", new_folder(spark, "points")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(to).collect()) == list(range(40))
    assert any("rocksdb" in k for p in query.recentProgress for s in p["stateOperators"] for k in s["customMetrics"]) and spark.conf.get(kept) == before


def test_a_small_batch_is_kept_in_few_parts(spark, monkeypatch):
    target, parts, whole = stored(spark), [], StoredTable._write
    changed, shuffled = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "spark.sql.shuffle.partitions"
    before = spark.conf.get(changed), spark.conf.get(shuffled)

    def write(self, version, fresh, *more):
        parts.append(fresh.rdd.getNumPartitions())
        whole(self, version, fresh, *more)

    monkeypatch.setattr(StoredTable, "_write", write)
    rows = random_events(200, 30, 11)
    try:
        spark.conf.set(shuffled, "64")
        for i in range(2):
            target.apply(events(spark, *rows[i::2], *rows[i::4]), batch=i)
    finally:
        spark.conf.set(shuffled, before[1])
    assert max(parts) <= 8 and spark.conf.get(changed) == before[0]
    assert rows_of(target) == applied(rows) and target.positions().first()["rows_applied"] == 200


def test_files_of_a_batch_are_read_by_all_cores(spark, monkeypatch):
    from tidemark.plans import queries_data

    seen, whole = {}, cdc.apply_files

    def apply_files(session, source, schema, target, *more, **named):
        seen.update(source=source, target=target, files=named["files_per_batch"])
        return whole(session, source, schema, target, *more, **named)

    monkeypatch.setattr(cdc, "apply_files", apply_files)
    queries_data.cdc_stream_apply(spark, "/root/testdata/sf0.001").count()
    width = spark.sparkContext.defaultParallelism
    written = spark.read.parquet(seen["source"]).withColumn("file", F.input_file_name())
    assert seen["files"] == width and written.select("file").distinct().count() == 4 * width and seen["target"].versions()[-1] == 4
    copies = written.groupBy("lsn", "seq").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).where("n = 2")
    assert copies.where("files = 2").count() > 0.9 * copies.count() > 0
