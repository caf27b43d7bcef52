"""Metadata analytics: object and schema diffs, readiness scores, dependency graphs, reports, operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.masking import CLASSES
from tidemark.operators.graphs import closure, cycles, levels, topological_order, worst_below  # noqa: F401  (graphs of a catalog)

# --- diffs --------------------------------------------------------------------------------------

def diff_objects(source: DataFrame, target: DataFrame) -> DataFrame:
    """Of (name, definition) rows, matched by name in any case: exact, partial, source_only, target_only."""
    s, t = source.select(F.lower("name").alias("name"), F.col("definition").alias("s")), target.select(F.lower("name").alias("name"), F.col("definition").alias("t"))
    state = F.when(F.col("t").isNull(), "source_only").when(F.col("s").isNull(), "target_only").when(F.col("s") == F.col("t"), "exact").otherwise("partial")
    return s.join(t, "name", "full_outer").select("name", state.alias("state"))


def diff_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, property, severity) of columns that differ; names by case. Rows: name, type, precision, nullable, default_value."""
    s = source.select("name", F.struct("type", "precision", "nullable", "default_value").alias("s"))
    t = target.select("name", F.struct("type", "precision", "nullable", "default_value").alias("t"))
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    found = [F.struct(F.when(F.col("s").isNull() | F.col("t").isNull(), "existence").alias("property"), F.lit("blocker").alias("severity"))]
    for p, severity in (("type", "blocker"), ("precision", "info"), ("nullable", "warning"), ("default_value", "info")):
        found.append(F.struct(F.when(both & ~F.col(f"s.{p}").eqNullSafe(F.col(f"t.{p}")), p).alias("property"), F.lit(severity).alias("severity")))
    return s.join(t, "name", "full_outer").select("name", F.inline(F.array(*found))).where("property IS NOT NULL")


def diff_indexes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, issue) of non-primary indexes: key columns in order, and uniqueness that is lost. Rows: name, columns, is_unique."""
    s = source.select(F.lower("name").alias("name"), F.struct("columns", "is_unique").alias("s"))
    t = target.select(F.lower("name").alias("name"), F.struct("columns", "is_unique").alias("t"))
    issue = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s.columns") != F.col("t.columns"), "key_columns").when(F.col("s.is_unique") & ~F.col("t.is_unique"), "uniqueness_lost")
    return s.join(t, "name", "full_outer").select("name", issue.alias("issue")).where("issue IS NOT NULL")


def diff_constraints(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, issue) of (name, kind) rows."""
    s, t = source.select(F.lower("name").alias("name"), F.col("kind").alias("s")), target.select(F.lower("name").alias("name"), F.col("kind").alias("t"))
    issue = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") != F.col("t"), "kind_changed")
    return s.join(t, "name", "full_outer").select("name", issue.alias("issue")).where("issue IS NOT NULL")


def schema_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """Concerns of a stream: rows are (table_name, column_name, is_key), names in any case."""
    low = lambda df, n: df.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), F.col("is_key").alias(n))
    s, t = low(source, "s"), low(target, "t")
    there = t.select("table_name").distinct().withColumn("there", F.lit(True))
    lost = s.select("table_name").distinct().join(there, "table_name", "left_anti").select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("missing_table").alias("concern"), F.lit("blocker").alias("severity"))
    both = s.join(t, ["table_name", "column_name"], "full_outer").join(there, "table_name")
    concern = F.when(F.col("t").isNull(), "missing_column").when(F.col("s").isNull(), "extra_column").when(F.col("s") != F.col("t"), "key_mismatch")
    found = both.select("table_name", "column_name", concern.alias("concern")).where("concern IS NOT NULL")
    return lost.unionByName(found.withColumn("severity", F.when(F.col("concern") == "extra_column", "info").otherwise("warning")))


# --- readiness ----------------------------------------------------------------------------------

# Types that block a table, types of large objects, and the weights of the score.
BLOCKED_TYPES = ("hierarchyid", "geography", "geometry", "sql_variant")
LARGE_TYPES = ("text", "ntext", "image", "xml")
DEPRECATED_TYPES = ("text", "ntext", "image")
WEIGHTS = {"blocked": 40, "large": 8, "ci_collation": 5, "computed": 5, "no_key": 50, "temporal": 20, "in_memory": 15, "over_1m_rows": 10, "over_100m_rows": 10, "sensitive": 3}


def is_sensitive(name: Column) -> Column:
    out = F.lit(False)
    for pattern, _, _ in CLASSES:
        out = out | name.rlike(pattern)
    return out


def tier_of(blocked: Column, warned: Column, score: Column) -> Column:
    """BLOCKER with any blocker or 80 points, WARNING with any warning or 30, else SAFE."""
    return F.when(blocked | (score >= 80), "BLOCKER").when(warned | (score >= 30), "WARNING").otherwise("SAFE")


#: Rows a minute of plain tables and of those with large objects.
ROWS_A_MINUTE, LARGE_ROWS_A_MINUTE = 60_000, 5_000


def assess_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, score, blockers, warnings, tier, minutes): tables have is_temporal, in_memory, row_count, has_key; columns have type, max_length, collation_name, is_computed.

    Blockers are unsupported types and a missing key; warnings computed, large, case-insensitive and sensitive columns,
    temporal and in-memory tables and over 100 million rows. Unknown flags count as false, an unknown key as none and
    unknown rows as 0. A table without columns has no key to miss.
    """
    kind = F.lower("type")
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    large = kind.isin(*LARGE_TYPES) | (kind.isin("varchar", "nvarchar", "varbinary") & (F.col("max_length") == -1))
    by_table = columns.groupBy("table_name").agg(
        one(kind.isin(*BLOCKED_TYPES)).alias("blocked"), one(large).alias("large"), one(F.upper(F.coalesce("collation_name", F.lit(""))).contains("_CI_")).alias("ci_collation"),
        one(F.col("is_computed")).alias("computed"), one(is_sensitive(F.col("column_name"))).alias("sensitive"), F.count("*").alias("columns"),
    )
    joined = tables.join(by_table, "table_name", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False))
    no_key, rows = ~flag("has_key") & (n("columns") > 0), n("row_count")
    points = F.least(F.lit(15), WEIGHTS["sensitive"] * n("sensitive"))
    for name in ("blocked", "large", "ci_collation", "computed"):
        points = points + WEIGHTS[name] * n(name)
    for name, test in (("no_key", no_key), ("temporal", flag("is_temporal")), ("in_memory", flag("in_memory")), ("over_1m_rows", rows > 1_000_000), ("over_100m_rows", rows > 100_000_000)):
        points = points + F.when(test, WEIGHTS[name]).otherwise(0)
    blockers = n("blocked") + F.when(no_key, 1).otherwise(0)
    warnings = n("computed") + sum((F.when(t, 1).otherwise(0) for t in (n("large") > 0, n("ci_collation") > 0, n("sensitive") > 0, flag("is_temporal"), flag("in_memory"), rows > 100_000_000)), F.lit(0))
    minutes = F.floor(F.greatest(F.lit(0.1), rows / F.when(n("large") > 0, LARGE_ROWS_A_MINUTE).otherwise(ROWS_A_MINUTE)) * 100 + 0.5) / 100
    told = joined.select("table_name", F.least(F.lit(100), points).cast("int").alias("score"), blockers.cast("int").alias("blockers"), warnings.cast("int").alias("warnings"), minutes.alias("minutes"))
    return told.withColumn("tier", tier_of(F.col("blockers") > 0, F.col("warnings") > 0, F.col("score")))


# What a routine's text can hold, and how hard that is to convert (1 moderate, 2 complex, 3 extreme; 0 only told).
ROUTINE_PATTERNS = (
    ("exec_text", r"\b(exec|execute)\s*\(", 2),
    ("exec", r"\b(exec|execute)\s+[@\[\w]", 1),
    ("sp_executesql", r"\bsp_executesql\b", 3),
    ("cursor", r"\bcursor\b", 2),
    ("fetch", r"\bfetch\b", 1),
    ("try", r"\btry\b", 1),
    ("catch", r"\bcatch\b", 1),
    ("raiserror", r"\braiserror\b", 1),
    ("merge", r"\bmerge\b", 2),
    ("output", r"\boutput\s+(inserted|deleted|into|\$action)\b|@\w+(\s+\w+(\([^)]*\))?)*\s+output\b", 2),
    ("cross_apply", r"\bcross\s+apply\b", 1),
    ("outer_apply", r"\bouter\s+apply\b", 1),
    ("unpivot", r"\bunpivot\b", 2),
    ("pivot", r"\bpivot\b", 2),
    ("system_variable", r"@@\w+", 1),
    ("temporary", r"(^|[^#\w])#\w+|##\w+", 1),
    ("goto", r"\bgoto\b", 2),
    ("waitfor", r"\bwaitfor\b", 1),
    ("xml", r"\b(as|for)\s+xml\b|\.(value|query|exist|modify|nodes)\s*\(", 2),
    ("for_json", r"\bfor\s+json\b", 0),
    ("openquery", r"\bopenquery\b", 0),
    ("openrowset", r"\bopenrowset\b", 0),
    ("linked_server", r"\blinked\s+server\b", 0),
)
# Texts that no routine can be converted with, and points and minutes by difficulty.
ROUTINE_BLOCKERS = ("EXTERNAL NAME", "CREATE ASSEMBLY", "SERVICE_BROKER")
DIFFICULTIES = ("simple", "moderate", "complex", "extreme")
ROUTINE_SCORES = (10, 35, 55, 85)
ROUTINE_MINUTES = (2.0, 5.0, 15.0, 30.0)


def assess_routines(routines: DataFrame) -> DataFrame:
    """(name, difficulty, score, minutes, blockers, tier) of (name, body, is_function) rows.

    The hardest pattern outside quotes decides; each blocker adds 15 points. A routine without a text can't be read,
    which is a blocker of its own.
    """
    text = F.trim(F.coalesce("body", F.lit("")))
    outside, upper, read = F.col("_outside"), F.upper(text), text != ""
    # The hardest first, so that a text is searched once at most, up to its first hit; -1 without a hit.
    hardest = F.coalesce(*[F.when(outside.rlike(p), d) for _, p, d in sorted(ROUTINE_PATTERNS, key=lambda r: -r[2])], F.lit(-1))
    level, found = F.greatest(F.lit(0), F.col("_hardest")), F.col("_hardest") >= 0
    blockers = sum((F.when(upper.contains(m), 1).otherwise(0) for m in ROUTINE_BLOCKERS), F.lit(0)) + F.when(level == 3, 1).otherwise(0)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), level + 1)
    # Each text once, and in steps that Spark doesn't merge, as what they make is used more than once.
    own = routines.select("name", "body", "is_function", F.lower(F.regexp_replace(text, "'(''|[^'])*'", "''")).alias("_outside")).withColumn("_hardest", hardest)
    told = own.select(
        "name", F.when(read, pick(DIFFICULTIES)).otherwise("extreme").alias("difficulty"), F.when(read, F.least(F.lit(100), pick(ROUTINE_SCORES) + 15 * blockers)).otherwise(100).cast("int").alias("score"),
        F.when(read, pick(ROUTINE_MINUTES)).otherwise(0.0).alias("minutes"), F.when(read, blockers).otherwise(1).cast("int").alias("blockers"), (found | F.coalesce("is_function", F.lit(False))).alias("_warned"),
    )
    return told.withColumn("tier", tier_of(F.col("blockers") > 0, F.col("_warned"), F.col("score"))).drop("_warned")


def routine_dependencies(routines: DataFrame, uses: DataFrame, tables: DataFrame) -> DataFrame:
    """(name, missing, tier): a routine that needs a table that isn't there is blocked."""
    there = tables.select(F.lower("table_name").alias("used"), F.lit(1).alias("there"))
    lost = uses.select("name", F.lower("used").alias("used")).join(there, "used", "left").groupBy("name").agg(F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).cast("int").alias("missing"))
    return routines.join(lost, "name", "left").select("name", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.coalesce("missing", F.lit(0)) > 0, "BLOCKER").otherwise(F.col("tier")).alias("tier"))


# What definitions are searched for, in any place, and types whose behaviour differs.
UNSUPPORTED_FEATURES = ("CLR", "SERVICE_BROKER", "LINKED_SERVER", "SQL_AGENT")
MANUAL_FEATURES = (
    "EXEC", "MERGE", "CROSS APPLY", "OUTER APPLY", "OUTPUT", "PIVOT", "UNPIVOT", "TRY", "RAISERROR", "PRINT", "WAITFOR", "IDENTITY", "@@ROWCOUNT", "NEWID",
    "GETDATE", "ISNULL", "TOP", "LEN",
)
RISKY_TYPES = ("SQL_VARIANT", "HIERARCHYID", "GEOGRAPHY", "GEOMETRY", "ROWVERSION", "TIMESTAMP")
STATUSES = ("auto_convertible", "performance_risk", "risky", "partial", "unsupported")


def analyze_compatibility(objects: DataFrame) -> DataFrame:
    """(name, issues, status, auto_percent) of (name, kind, definition, types, slow) rows.

    Unsupported features come first, then what needs work by hand (features, and every trigger), then risky types of
    columns, then what is only slow. A procedure has an issue that doesn't change its status. Each issue takes 10 % off.
    """
    text, kind = F.upper(F.coalesce("definition", F.lit(""))), F.lower("kind")
    count = lambda tests: sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    unsupported, manual = count(text.contains(f) for f in UNSUPPORTED_FEATURES), count([*(text.contains(f) for f in MANUAL_FEATURES), kind == "trigger"])
    risky = F.coalesce(F.size(F.filter("types", lambda t: F.upper(t).isin(*RISKY_TYPES))), F.lit(0))
    slow, low = F.when(F.coalesce("slow", F.lit(False)), 1).otherwise(0), F.when(kind == "procedure", 1).otherwise(0)
    status = F.when(unsupported > 0, "unsupported").when(manual > 0, "partial").when(risky > 0, "risky").when(slow > 0, "performance_risk").otherwise("auto_convertible")
    issues = (unsupported + manual + risky + slow + low).cast("int")
    return objects.select("name", issues.alias("issues"), status.alias("status"), F.greatest(F.lit(0.0), F.lit(100.0) - 10.0 * issues).alias("auto_percent"))


# --- reports ------------------------------------------------------------------------------------


def _by_status(results: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return results.agg(F.count("*").alias("total"), n("auto_convertible").alias("auto"), n("partial").alias("partial"), n("unsupported").alias("unsupported"), n("risky").alias("risky"), n("performance_risk").alias("performance_risk"))


def migration_report(results: DataFrame) -> DataFrame:
    """Counts by status, percent converted, hours of effort (0.1, 2, 4 and 1 an object) and minutes of downtime."""
    r = _by_status(results)
    hours = F.col("auto") * 0.1 + F.col("partial") * 2.0 + F.col("unsupported") * 4.0 + F.col("risky") * 1.0
    return r.select("*", F.round(F.col("auto") / F.col("total") * 100, 1).alias("auto_percent"), F.round(hours, 1).alias("effort_hours"), F.least(F.col("total") * 2, F.lit(480)).alias("downtime_minutes"))


def executive_report(results: DataFrame, blockers: int = 0) -> DataFrame:
    """Person-days (0.1, 2, 8 and 4 hours an object), risk up to 100, and weeks between 2 and 24."""
    r = _by_status(results)
    percent = F.round(F.col("auto") / F.col("total") * 100, 1)
    days = F.round((F.col("auto") * 0.1 + F.col("partial") * 2.0 + F.col("unsupported") * 8.0 + F.col("risky") * 4.0) / 8, 1)
    risk = F.least(F.lit(100), F.floor(F.col("unsupported") * 8 + F.col("partial") * 3 + F.col("risky") * 5 + blockers * 10 + F.greatest(F.lit(0), 100 - percent)))
    weeks = F.greatest(F.lit(2), F.least(F.lit(24), F.floor(days / 5) + (1 if blockers else 0)))
    return r.select(percent.alias("auto_percent"), days.alias("person_days"), risk.cast("int").alias("risk"), weeks.cast("int").alias("weeks"))


def phases(report: DataFrame) -> DataFrame:
    """(phase, name, weeks) of an executive report's weeks: a quarter to plan, half to migrate, a quarter to cut over, and two more."""
    quarter, half = F.floor(F.col("weeks") / 4), F.floor(F.col("weeks") / 2)
    told = F.array(*[F.struct(F.lit(i).alias("phase"), F.lit(n).alias("name"), w.cast("int").alias("weeks")) for i, n, w in ((1, "Assess & Plan", F.greatest(F.lit(1), quarter)), (2, "Migrate Waves", F.greatest(F.lit(2), half)), (3, "Validate & Cutover", F.greatest(F.lit(1), quarter)), (4, "Stabilize", F.lit(2)))])
    return report.select(F.inline(told))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """(name, kind, value) rows as lines of a text exposition."""
    lines = F.array(F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"), F.concat("name", F.lit(" "), F.col("value").cast("string")))
    return metrics.select(F.explode(lines).alias("line"))


# --- operations ---------------------------------------------------------------------------------


def alerts(jobs: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Failed jobs of the last hours, to the microsecond, by severity: more than three retries are critical. Both times are of one type."""
    recent = jobs.where((F.col("status") == "FAILED") & (F.col("ended") >= now - F.make_dt_interval(hours=F.lit(hours))))
    return recent.groupBy(F.when(F.col("retries") > 3, "critical").otherwise("warning").alias("severity")).agg(F.count("*").alias("n"))


def expired(jobs: DataFrame, today: Column, days: int, keep_newest: int) -> DataFrame:
    """Jobs to clean up: old enough, not running, failed or stopped, and not among the newest of their project."""
    exempt = F.upper("status").isin("RUNNING", "IN_PROGRESS", "PAUSED", "FAILED", "STOPPED")
    placed = jobs.withColumn("_place", F.row_number().over(Window.partitionBy("project").orderBy(F.col("ended").desc(), "job_id")))
    return placed.where(~exempt & (F.date_diff(today, F.col("ended").cast("date")) >= days) & (F.col("_place") > keep_newest)).drop("_place")


def dry_run(tables: DataFrame, chunk: int) -> DataFrame:
    """(table_name, row_count, chunks, reachable) of (table_name, row_count) rows; a null count can't be reached."""
    return tables.select("table_name", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.ceil(F.coalesce("row_count", F.lit(0)) / chunk).cast("long").alias("chunks"), F.col("row_count").isNotNull().alias("reachable"))


def create_table(name: str, df: DataFrame, keys: tuple[str, ...] = ()) -> str:
    """DDL of a DataFrame's schema."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "string": "TEXT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "boolean": "BOOLEAN", "date": "DATE", "binary": "BYTEA"}
    columns = [f'"{f.name}" {kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper())}{"" if f.nullable and f.name not in keys else " NOT NULL"}' for f in df.schema.fields]
    return f'CREATE TABLE "{name}" (' + ", ".join([*columns, *([f"PRIMARY KEY ({', '.join(keys)})"] if keys else [])]) + ")"


def premigration_issues(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, issue) of columns (table_name, type) and tables (table_name, has_key, triggers); an unknown key counts as none."""
    kind = F.lower("type")
    of_column = F.when(kind.isin(*BLOCKED_TYPES), "unsupported_type").when(kind.isin(*DEPRECATED_TYPES), "deprecated_type")
    of_table = F.array(F.when(~F.coalesce("has_key", F.lit(False)), "no_primary_key"), F.when(F.col("triggers") > 0, "active_triggers"))
    return columns.select("table_name", of_column.alias("issue")).unionByName(tables.select("table_name", F.explode(of_table).alias("issue"))).where("issue IS NOT NULL")


def constraint_plan(constraints: DataFrame) -> DataFrame:
    """(name, action) of constraints (name, kind) for the time of a load; kinds that aren't known are kept."""
    kind = F.lower("kind")
    return constraints.select("name", F.when(kind.isin("foreign_key", "check", "trigger"), "disable").when(kind == "index", "drop_and_rebuild").otherwise("keep").alias("action"))


def transfer_preflight(columns: DataFrame) -> DataFrame:
    """(name, verdict) of columns (name, type, nullable, target_type, target_nullable); unknown nullability counts as nullable."""
    nulls = F.coalesce("nullable", F.lit(True)) & ~F.coalesce("target_nullable", F.lit(True))
    verdict = F.when(F.col("target_type").isNull(), "blocker:missing").when(nulls, "blocker:nulls").when(F.lower("type") == "alias_type", "warning:alias").otherwise("ok")
    return columns.select("name", verdict.alias("verdict"))
