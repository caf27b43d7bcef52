"""Relational operators with T-SQL semantics: APPLY, ties, paging, pivots, null order, generated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_name(schema: str, name: str, tables: dict[str, str], schemas: dict[str, str]) -> str:
    """Where a table goes: by a map of tables, else of schemas, else as it is; maps have lower-case keys."""
    found = tables.get(f"{schema}.{name}".lower())
    return found or f"{schemas.get(schema.lower(), schema)}.{name}"


def floor_div(value: Column, n: int) -> Column:
    """The floor of an integer column over ``n``, exact for all integers."""
    return F.call_function("div", value - F.pmod(value, F.lit(n)), F.lit(n))


def not_in(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """NOT IN over the one column of ``values``: no row if it has a null; null keys only pass if it has no row."""
    name = values.columns[0]
    seen = values.agg(F.count("*").alias("_n"), F.count(F.when(F.col(name).isNull(), 1)).alias("_nulls"))
    kept = df.join(values.select(F.col(name).alias("_v")), F.col(key) == F.col("_v"), "left_anti")
    return kept.join(F.broadcast(seen)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_n", "_nulls")


def sort_rows(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Sort by (column, ascending) pairs with nulls lowest, as T-SQL orders them."""
    return df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order])


def top_with_ties(df: DataFrame, n: int, order: Column) -> DataFrame:
    """The first ``n`` rows and all that tie with the last of them.

    The n-th value comes from a distributed top-k, so no window over the whole table is needed.
    """
    name = "_order"
    keyed = df.withColumn(name, order)
    last = keyed.select(name).orderBy(F.col(name).desc_nulls_last()).limit(n).agg(F.min(name).alias("_last"))
    return keyed.join(F.broadcast(last), F.col(name) >= F.col("_last")).drop(name, "_last")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def pivot_fixed(df: DataFrame, by: Sequence[str], key: str, values: Sequence[object], value: Column) -> DataFrame:
    """Sums by listed values of ``key`` as columns, 0 where a group has none; one shuffle."""
    return df.groupBy(*by).pivot(key, list(values)).agg(value).na.fill(0)


def pivot_found(df: DataFrame, by: Sequence[str], key: str, value: Column, most: int = 1000) -> DataFrame:
    """As ``pivot_fixed``, for the values that the data has; there may be ``most`` of them, each a column. ``pivot_map`` takes any number."""
    values = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{key} has more than {most} values; pivot_map has them in a map")
    return pivot_fixed(df, by, key, values, value)


def pivot_map(df: DataFrame, by: Sequence[str], key: str, value: Column) -> DataFrame:
    """A row a group with a map ``values`` from each value of ``key`` that it has to the aggregate: for any number of values, none of which passes through the driver."""
    cells = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(value.alias("_v"))
    return cells.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias("values"))


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns as rows, without nulls."""
    return df.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, sum and mean of each numeric column, in one pass."""
    aggs = [f(F.col(c).cast("double")).alias(f"{c}:{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("avg", F.avg))]
    wide = df.agg(F.count("*").alias("rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.round(F.col(f"`{c}:{n}`"), 6).alias(f"{n}_value") for n in ("min", "max", "sum", "avg")]) for c in columns])
    return wide.select("rows", F.inline(rows))


def full_by_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full outer join of (keys, s) and (keys, t); null keys meet null keys."""
    a, b = source.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "s"), target.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "t")
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}"))
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"_s{i}", f"_t{i}").alias(k) for i, k in enumerate(keys)], "s", "t")


def keyed_difference(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys with their state: match, changed, missing_in_target, missing_in_source; one full outer join. A null key is a key like any other."""
    s, t = (df.select(*keys, F.struct(*columns).alias(n)) for df, n in ((source, "s"), (target, "t")))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    state = F.when(F.col("t").isNull(), "missing_in_target").when(F.col("s").isNull(), "missing_in_source").when(same, "match").otherwise("changed")
    return full_by_keys(s, t, keys).select(*keys, state.alias("state"))


def row_digest(columns: Sequence[str], casts: dict[str, str] | None = None) -> Column:
    """MD5 of the columns' texts, each after its length and null apart from empty, alike on both sides; floats as fixed decimals."""
    texts = [F.col(c).cast((casts or {}).get(c, "string")).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *[F.when(x.isNull(), "-").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x)) for x in texts]))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and an order-free checksum of rows: the sum of 60 bits of each row's digest, exact in decimals."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("decimal(20,0)")).alias("checksum"))


def digest_sum(columns: Sequence[str]) -> Column:
    """An aggregate over rows in any order: the sum of 60 bits of each row's digest, as a decimal text."""
    return F.sum(F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")


def stream_hash(df: DataFrame, order: Sequence[str], columns: Sequence[str], block: int = 10_000) -> DataFrame:
    """A digest of rows with their order keys: of blocks of ``block`` keys, then of as many of these, level by level.

    A block's rows are counted and summed as they are read, so repeated and null keys, of which one block has all, cost
    no more than others. Each value goes in after its length, and null apart from any text.
    """
    rows = [*order, *[c for c in columns if c not in order]]
    leaf = F.concat(F.count("*").cast("string"), F.lit(":"), digest_sum(rows))
    digests = df.groupBy(floor_div(F.col(order[0]), block).alias("block")).agg(F.sha2(leaf, 256).alias("digest"))
    for _ in range(4):
        row = F.struct(F.coalesce(F.col("block").cast("string"), F.lit("-")).alias("of"), "block", "digest")
        joined = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(r["of"], F.lit(":"), r["digest"]))
        # At most ``block`` rows, and one of null keys.
        digests = digests.groupBy(floor_div(F.col("block"), block).alias("block")).agg(F.sha2(F.array_join(joined, "\n"), 256).alias("digest"))
    # What is left is a row for each 10^20 keys or more.
    row = F.struct(F.coalesce(F.col("block").cast("string"), F.lit("-")), "digest")
    return digests.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["digest"]), "\n"), 256).alias("digest"))


def values_at(df: DataFrame, group: str, value: str, ranges: int = 64, **places: Column) -> DataFrame:
    """The group's values at exact places, from 0, each an expression of its number of values ``n``, as columns.

    Approximate quantiles deal each group's values to ranges, which are counted; only values of the ranges that hold a
    wanted place are shuffled and ranked. Null values have no place.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_of"), F.col(value).alias("_v"))
    bounds = known.groupBy(F.col("_of").alias("_g")).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000).alias("_bounds"), F.count("*").alias("n"))
    dealt = known.join(bounds, F.col("_of").eqNullSafe(F.col("_g"))).select("_g", "_v", "n", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_place"))
    sizes = dealt.groupBy("_g", "_place").agg(F.count("*").alias("_size"), F.first("n").alias("n"))  # at most ``ranges`` rows a group
    placed = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("_g").orderBy("_place")) - F.col("_size"))
    held = F.col("_before") == 0  # so that each group comes back, with nulls for places beyond its values
    for place in places.values():
        held = held | ((place >= F.col("_before")) & (place < F.col("_before") + F.col("_size")))
    wanted = placed.where(held).select(F.col("_g").alias("_wg"), F.col("_place").alias("_wp"), "_before")
    times = dealt.join(wanted, F.col("_g").eqNullSafe(F.col("_wg")) & (F.col("_place") == F.col("_wp"))).groupBy("_g", "_place", "_before", "n", "_v").agg(F.count("*").alias("_times"))
    first = F.col("_before") + F.sum("_times").over(Window.partitionBy("_g", "_place").orderBy("_v")) - F.col("_times")
    ranked = times.withColumn("_first", first)
    found = [F.max(F.when((place >= F.col("_first")) & (place < F.col("_first") + F.col("_times")), F.col("_v"))).alias(name) for name, place in places.items()]
    return ranked.groupBy(F.col("_g").alias(group)).agg(*found)


def equal_ranges(df: DataFrame, key: str, n: int, ranges: int = 32, unique: bool = False) -> DataFrame:
    """(bucket, low, high, rows) of ``n`` buckets by the exact rank of the key, with NTILE's sizes: the first ones have a row more.

    Approximate quantiles only deal the distinct keys to ``ranges``; ranks are counted within each range, after
    the rows of the ranges before it, so nothing is sorted on one task. Equal keys can lie in several buckets.
    Null keys come last. Keys that are known to be ``unique`` are ranked as they are, others counted first.
    """
    bounds = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000).alias("bounds"))
    place = F.when(F.col("_key").isNull(), ranges).otherwise(F.size(F.filter("bounds", lambda b: b < F.col("_key"))))
    counted = df.select(F.col(key).alias("_key"), F.lit(1).cast("long").alias("_n")) if unique else df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    keys = counted.join(F.broadcast(bounds)).select("_key", "_n", place.alias("_place"))
    sizes = keys.groupBy("_place").agg(F.sum("_n").alias("_size"))  # one row a range
    before = sizes.select("_place", (F.sum("_size").over(Window.orderBy("_place")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    ahead = F.sum("_n").over(Window.partitionBy("_place").orderBy(F.col("_key").asc_nulls_last())) - F.col("_n")
    ranked = keys.select("*", ahead.alias("_ahead")).join(F.broadcast(before), "_place").select("_key", "_n", "_all", (F.col("_before") + F.col("_ahead")).alias("_first"))
    base, extra = F.expr(f"_all div {n}"), F.expr(f"_all % {n}")
    sized = ranked.select("*", base.alias("_base"), extra.alias("_extra"), (extra * (base + 1)).alias("_cut"))

    def bucket(at: str) -> Column:
        return F.expr(f"if({at} < _cut, ({at}) div (_base + 1), _extra + ({at} - _cut) div greatest(_base, 1))")

    spread = sized.select("*", F.explode(F.sequence(bucket("_first"), bucket("_first + _n - 1"))).alias("_b"))
    start = lambda b: F.expr(f"{b} * _base + least({b}, _extra)")
    rows = F.least(F.expr("_first + _n"), start("(_b + 1)")) - F.greatest(F.col("_first"), start("_b"))
    return spread.groupBy((F.col("_b") + 1).cast("int").alias("bucket")).agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.sum(rows).alias("rows"))


def hash_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 7) -> DataFrame:
    """``rows`` of the ``total`` rows: those of the least hashes of key and seed, and any that share the last one's hash.

    Hashes beyond twice the expected cut are left out as rows are read; the cut among the others is exact, by
    ranks within ranges, so that neither the table nor the sample is sorted or limited on one task.
    """
    hashed = df.withColumn("_hash", F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long"))
    near = hashed.where(F.col("_hash") < int(min(1.0, 2 * rows / max(total, 1)) * 2**60))
    near = near if near.count() >= min(rows, total) else hashed
    cut = values_at(near.withColumn("_all", F.lit(0)), "_all", "_hash", cut=F.lit(rows - 1)).select("cut")
    return near.join(F.broadcast(cut), F.col("cut").isNull() | (F.col("_hash") <= F.col("cut"))).drop("_hash", "cut")
