"""Scalar functions with T-SQL semantics, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit


# --- strings ------------------------------------------------------------------------------------


def len_(x: Column) -> Column:
    """Characters without trailing spaces."""
    return F.length(F.rtrim(x))


def datalength(x: Column, wide: bool = False) -> Column:
    """Bytes of a text; two a UTF-16 unit for NVARCHAR."""
    return F.octet_length(F.encode(x, "UTF-16LE")) if wide else F.octet_length(x)


def charindex(find: str | Column, x: Column, start: int | Column = 1) -> Column:
    """Place of a text in another from ``start`` on, counted from 1; 0 if it isn't there."""
    start = F.greatest(lit(start) if isinstance(start, int) else start, lit(1))
    return F.call_function("locate", lit(find) if isinstance(find, str) else find, x, start)


def like_to_regex(pattern: str) -> str:
    """A LIKE pattern with %, _, [set] and [^set] as a Java regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out += "[" + ("^" if body[:1] == "^" else "") + body.lstrip("^").replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def patindex(pattern: str, x: Column) -> Column:
    """Place of the first match of a LIKE pattern, counted from 1; 0 without one."""
    head, tail = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    core = like_to_regex(pattern[1 if head else 0 : -1 if tail else None])
    whole = f"(?s)^({'.*?' if head else ''}){core}{'' if tail else '$'}"
    return F.when(x.rlike(whole), F.length(F.regexp_extract(x, whole, 1)) + 1).otherwise(F.when(x.isNotNull(), 0))


def substring(x: Column, start: int, length: int) -> Column:
    """A start before 1 takes from the length."""
    length = length + min(0, start - 1)
    return F.substring(x, max(start, 1), max(length, 0))


def left(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def right(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.substring(x, -n, n)) if n else F.when(x.isNotNull(), "")


def stuff(x: Column, start: int, length: int, new: str) -> Column:
    """``length`` characters from ``start`` replaced; null if that isn't within the text."""
    return F.when((lit(start) >= 1) & (F.length(x) >= start), F.overlay(x, lit(new), start, length))


def replicate(x: Column, n: int) -> Column:
    return F.when(lit(n) >= 0, F.repeat(x, n))


def space(n: Column | int) -> Column:
    return F.repeat(lit(" "), lit(n) if isinstance(n, int) else n)


def concat(*xs: Column) -> Column:
    """Nulls as empty texts."""
    return F.concat(*[F.coalesce(x.cast("string"), lit("")) for x in xs])


def concat_plus(*xs: Column) -> Column:
    """The + of texts: null if any is."""
    return F.concat(*xs)


def str_(x: Column, width: int = 10, decimals: int = 0) -> Column:
    """A number right-aligned in ``width`` characters; asterisks if it doesn't fit."""
    text = F.round(x.cast("decimal(38,10)"), decimals).cast(f"decimal(38,{decimals})").cast("string")
    return F.when(F.length(text) > width, "*" * width).otherwise(F.lpad(text, width, " "))


def quotename(x: Column) -> Column:
    return F.concat(lit("["), F.replace(x, lit("]"), lit("]]")), lit("]"))


def string_split(x: Column, separator: str) -> Column:
    """An array; explode it for rows."""
    return F.split(x, re.escape(separator))


# --- dates --------------------------------------------------------------------------------------

UNITS = {"yy": "year", "yyyy": "year", "qq": "quarter", "q": "quarter", "mm": "month", "m": "month", "dy": "dayofyear", "y": "dayofyear", "dd": "day", "d": "day", "wk": "week", "ww": "week", "dw": "weekday", "hh": "hour", "mi": "minute", "n": "minute", "ss": "second", "s": "second", "ms": "millisecond", "mcs": "microsecond", "isowk": "iso_week", "isoww": "iso_week"}
SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def unit_name(unit: str) -> str:
    return UNITS.get(unit.lower(), unit.lower())


def dateadd(unit: str, n: int | Column, x: Column) -> Column:
    """Units added to a time; months end at the last day of shorter ones."""
    unit = unit_name(unit)
    n = lit(n) if isinstance(n, int) else n
    x = x.cast("timestamp_ntz")
    months = {"year": 12, "quarter": 3, "month": 1}
    if unit in months:
        return x + F.make_ym_interval(lit(0), (n * months[unit]).cast("int"))
    days = {"week": 7, "day": 1, "dayofyear": 1, "weekday": 1}
    if unit in days:
        return x + F.make_dt_interval((n * days[unit]).cast("int"))
    seconds = n * SECONDS[unit] if unit in SECONDS else n / {"millisecond": 1e3, "microsecond": 1e6}[unit]
    return x + F.make_dt_interval(lit(0), lit(0), lit(0), seconds.cast("decimal(18,6)"))


def days_of(x: Column) -> Column:
    return F.unix_date(x.cast("date"))


def datediff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed from ``a`` to ``b``; weeks begin on Sunday."""
    unit = unit_name(unit)
    months = lambda x: F.year(x) * 12 + F.month(x)
    if unit == "year":
        return F.year(b) - F.year(a)
    if unit == "quarter":
        return (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
    if unit == "month":
        return months(b) - months(a)
    if unit in ("day", "dayofyear", "weekday"):
        return days_of(b) - days_of(a)
    if unit == "week":  # 1900-01-07 was a Sunday, 25561 days before 1970
        week = lambda x: F.floor((days_of(x) + 25561) / 7)
        return (week(b) - week(a)).cast("int")
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    size = SECONDS[unit] * 1_000_000 if unit in SECONDS else {"millisecond": 1000, "microsecond": 1}[unit]
    place = lambda x: F.floor(micros(x) / size)
    return (place(b) - place(a)).cast("long")


def datepart(unit: str, x: Column) -> Column:
    """A part as a number: weekday 1 (Sunday) to 7, week 1 from January 1 on with Sundays as borders."""
    unit = unit_name(unit)
    if unit == "week":
        first = F.trunc(x.cast("date"), "year")
        return (F.floor((F.dayofyear(x) + F.dayofweek(first) - 2) / 7) + 1).cast("int")
    if unit == "millisecond":
        return F.floor(F.date_format(x, "SSSSSS").cast("int") / 1000).cast("int")
    if unit == "microsecond":
        return F.date_format(x, "SSSSSS").cast("int")
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "dayofyear": F.dayofyear, "day": F.dayofmonth, "weekday": F.dayofweek, "iso_week": F.weekofyear, "hour": F.hour, "minute": F.minute, "second": F.second}
    return parts[unit](x)


def eomonth(x: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(x.cast("date"), months))


def datename(unit: str, x: Column) -> Column:
    unit = unit_name(unit)
    return F.date_format(x, {"month": "MMMM", "weekday": "EEEE"}[unit]) if unit in ("month", "weekday") else datepart(unit, x).cast("string")


def datefromparts(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


NET_TO_JAVA = {"d": "MM/dd/yyyy", "D": "EEEE, MMMM d, yyyy", "yyyy-MM-dd": "yyyy-MM-dd", "s": "yyyy-MM-dd'T'HH:mm:ss", "t": "h:mm a", "T": "h:mm:ss a", "M": "MMMM d", "Y": "MMMM yyyy"}


def format_date(x: Column, pattern: str) -> Column:
    """FORMAT of a time by a named or a .NET pattern."""
    java = NET_TO_JAVA.get(pattern) or pattern.replace("tt", "a").replace("dddd", "EEEE").replace("ddd", "EEE").replace("fff", "SSS")
    return F.date_format(x, java)


def format_number(x: Column, pattern: str) -> Column:
    """FORMAT of a number: N, C and P with decimals."""
    kind, places = pattern[0].upper(), int(pattern[1:] or 2)
    x = x.cast("decimal(38,10)")
    if kind == "C":
        return F.concat(F.when(x < 0, "-").otherwise(""), lit("$"), F.format_number(F.abs(x), places))
    if kind == "P":
        return F.concat(F.format_number(x * 100, places), lit(" %"))
    return F.format_number(x, places)


STYLES = {101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 23: "yyyy-MM-dd"}


def convert_style(x: Column, style: int) -> Column:
    """A time as text by a CONVERT style."""
    return F.date_format(x, STYLES[style])


# --- numbers, conditions, casts -----------------------------------------------------------------


def isnumeric(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$").cast("int"), lit(0))


def iif(when: Column, a: object, b: object) -> Column:
    return F.when(when, a).otherwise(b)


def choose(index: Column, *values: object) -> Column:
    """The index-th value, counted from 1; null out of range."""
    return F.get(F.array(*[v if isinstance(v, Column) else lit(v) for v in values]), index - 1)


def square(x: Column) -> Column:
    return x * x


def try_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def default_value(x: Column, default: object) -> Column:
    return F.coalesce(x, lit(default))


# --- JSON, XML, hashes --------------------------------------------------------------------------


def json_value(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def json_query(x: Column, path: str) -> Column:
    """An object or array as text; null for scalars."""
    found = F.get_json_object(x, path)
    return F.when(found.rlike(r"^\s*[\[{]"), found)


def isjson(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.get_json_object(x, "$").isNotNull().cast("int"))


def json_modify(x: Column, key: str, value: Column) -> Column:
    """A top-level key of an object set to a value of its own type; others keep their types and what is nested in them.

    A null value takes the key out. Keys come out in order of their names. Texts that aren't an object give null.
    """
    fields = F.map_filter(F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>"), lambda k, _: k != key)
    return F.to_json(F.when(value.isNull(), fields).otherwise(F.map_concat(fields, F.create_map(lit(key), value.cast("variant")))))
