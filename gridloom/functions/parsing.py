"""Text as numbers, booleans and timestamps: column expressions, never UDFs.

Each family takes what its users' rules accept and gives null for the rest. A column that is typed already is only
cast. Timestamps are without a time zone; the session's zone should be UTC, as epoch numbers count in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
# Texts that stand for true and false, and for a missing cell.
TRUE, FALSE = ("true", "1", "yes", "y", "是"), ("false", "0", "no", "n", "否")
MORE_TRUE, MORE_FALSE = ("t", "on", "开"), ("f", "off", "关")
NULL_MARKERS = ("", "null", "NULL", "NaN", "N/A", "NA", "None", "无", "-")
# Patterns of dates and times.
DATE_TIMES = ("y-M-d H:m:s", "y/M/d H:m:s", "y-M-d H:m", "y/M/d H:m", "y-M-d", "y/M/d")
_FRACTIONS = ("y-M-d H:m:s.S", "y/M/d H:m:s.S", "y.M.d H:m:s", "y.M.d", "y-M-d'T'H:m:s", "y-M-d'T'H:m", "y/M/d'T'H:m:s")
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$"


def trimmed(c: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_of(c: Column) -> Column:
    return c.cast("string")


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def blank(df: DataFrame, name: str) -> Column:
    """Null, or text of white space only."""
    c = F.col(name)
    return c.isNull() | ~c.rlike(r"(?U)\S") if is_text(df, name) else c.isNull()


def as_number(c: Column, drop: str = "") -> Column:
    """The number a text holds once the characters of `drop` are gone; white space at the ends counts only if `drop` is empty."""
    t = F.translate(c, drop, "") if drop else trimmed(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


#: What each family of numeric texts leaves out before parsing.
STRICT, LENIENT, FUSION, CHART = "", ",， ", ", ", ","


def number(df: DataFrame, name: str, family: str = LENIENT) -> Column:
    c = F.col(name)
    if is_text(df, name):
        return as_number(c, family)
    return c.cast("double") if is_number(df, name) else F.lit(None).cast("double")


def as_boolean(c: Column, more: bool = True) -> Column:
    t = F.lower(trimmed(c))
    yes, no = TRUE + MORE_TRUE * more, FALSE + MORE_FALSE * more
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def _at(t: Column, pattern: str) -> Column:
    return F.try_to_timestamp(t, F.lit(pattern)).cast("timestamp_ntz")


def as_plain_time(c: Column) -> Column:
    """Eight patterns; the offset of an ISO text is dropped."""
    t = trimmed(c)
    plain = F.when(t.rlike(r"^[0-9]{1,6}[-/]"), F.coalesce(*(_at(t, p) for p in DATE_TIMES)))
    compact = F.when(t.rlike(r"^[0-9]{8}$"), _at(t, "yyyyMMdd"))
    return F.coalesce(plain, compact, F.when(t.rlike(_ISO), t.try_cast("timestamp_ntz")))


def as_epoch(c: Column) -> Column:
    """Whole numbers: from 1e18 on nanoseconds, from 1e15 microseconds, from 1e12 milliseconds, else seconds."""
    t = trimmed(c)
    x = F.when(t.rlike(r"^-?[0-9]+$"), t.try_cast("bigint"))
    size = F.abs(x)
    micros = F.when(size >= F.lit(10**18), F.floor(x.cast("decimal(20,0)") / 1000)).when(size >= F.lit(10**15), x).when(size >= F.lit(10**12), x * 1000).otherwise(x * 1000000)
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def as_time(c: Column) -> Column:
    return F.coalesce(as_plain_time(c), as_epoch(c))


def as_fusion_time(c: Column) -> Column:
    """Like `as_time`, but an ISO text with an offset is taken to UTC, and fractions, dots and T are known too."""
    t = trimmed(c)
    iso = F.when(t.rlike(_ISO), t.try_cast("timestamp").cast("timestamp_ntz"))
    more = F.when(t.rlike(r"^[0-9]{1,6}[-/.]"), F.coalesce(*(_at(t, p) for p in (*DATE_TIMES, *_FRACTIONS)), t.try_cast("timestamp_ntz")))
    return F.coalesce(iso, more, F.when(t.rlike(r"^[0-9]{8}$"), _at(t, "yyyyMMdd")), as_epoch(c))


def time(df: DataFrame, name: str, parse=as_time) -> Column:
    c = F.col(name)
    if is_time(df, name):
        return c.cast("timestamp_ntz")
    return parse(c.cast("string"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)
