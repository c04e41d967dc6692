"""Cells of one column: text, numbers, types, times and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.parsing import LENIENT, STRICT, as_boolean, as_epoch, as_number, blank, is_text, is_time, number, text_of, time, trimmed
from ..plans.table import Table, at_positions, carried, quantile
from .columns import fresh
from .registry import operation


def _text(t: Table, column: str, make) -> Table:
    t.require(column)
    return t.with_column(column, make(text_of(F.col(column))))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


# --- text


@operation("TrimTextValues")
def trim_text_values(t: Table) -> Table:
    """All text columns; cells of white space only become null."""
    names = [c for c in t.columns if is_text(t.df, c)]
    return t.with_df(t.df.withColumns({c: _or_null(trimmed(F.col(c))) for c in names})) if names else t


@operation("TransformTextCase")
def transform_text_case(t: Table, column: str, mode: str = "upper") -> Table:
    return _text(t, column, F.lower if mode.strip().lower() in ("lower", "小写") else F.upper)


@operation("ReplaceText")
def replace_text(t: Table, column: str, from_: str, to: str = "") -> Table:
    if not from_:
        raise ValueError("the text to replace must not be empty")
    return _text(t, column, lambda c: F.replace(c, F.lit(from_), F.lit(to)))


@operation("SqueezeTextWhitespace")
def squeeze_text_whitespace(t: Table, column: str) -> Table:
    return _text(t, column, lambda c: _or_null(trimmed(F.regexp_replace(c, r"(?U)\s+", " "))))


@operation("RemoveTextPattern")
def remove_text_pattern(t: Table, column: str, pattern: str) -> Table:
    return replace_text(t, column, pattern, "")


@operation("ExtractTextBefore")
def extract_text_before(t: Table, column: str, delimiter: str) -> Table:
    """Before the first delimiter, trimmed; without one, the whole text."""
    if not delimiter:
        raise ValueError("a delimiter is needed")
    return _text(t, column, lambda c: _or_null(trimmed(F.substring_index(c, delimiter, 1))))


@operation("ExtractTextAfter")
def extract_text_after(t: Table, column: str, delimiter: str) -> Table:
    if not delimiter:
        raise ValueError("a delimiter is needed")
    at = lambda c: F.locate(delimiter, c)
    return _text(t, column, lambda c: _or_null(trimmed(F.when(at(c) > 0, F.substring(c, at(c) + len(delimiter), F.length(c))).otherwise(c))))


@operation("KeepDigitsOnly")
def keep_digits_only(t: Table, column: str) -> Table:
    return _text(t, column, lambda c: _or_null(F.regexp_replace(c, "[^0-9]", "")))


@operation("AddTextAffix")
def add_text_affix(t: Table, column: str, prefix: str = "", suffix: str = "") -> Table:
    return _text(t, column, lambda c: F.concat(F.lit(prefix), c, F.lit(suffix)))


@operation("TruncateText")
def truncate_text(t: Table, column: str, max_chars: int) -> Table:
    if max_chars <= 0:
        raise ValueError("max_chars must be above 0")
    return _text(t, column, lambda c: F.substring(c, 1, max_chars))


# --- numbers; what is no number becomes null


def _number(t: Table, column: str, make, family: str = STRICT) -> Table:
    t.require(column)
    return t.with_column(column, make(number(t.df, column, family)))


@operation("RoundNumeric")
def round_numeric(t: Table, column: str, digits: int) -> Table:
    return _number(t, column, lambda c: F.round(c, digits))


@operation("ScaleNumeric")
def scale_numeric(t: Table, column: str, factor: float) -> Table:
    return _number(t, column, lambda c: c * float(factor))


@operation("ShiftNumeric")
def shift_numeric(t: Table, column: str, offset: float) -> Table:
    return _number(t, column, lambda c: c + float(offset))


@operation("ClampNumeric")
def clamp_numeric(t: Table, column: str, min: float | None = None, max: float | None = None) -> Table:
    if min is None and max is None or min is not None and max is not None and min > max:
        raise ValueError("a bound is needed, and the lower must not be above the upper")

    def clamp(c: Column) -> Column:
        low = c if min is None else F.greatest(c, F.lit(float(min)))
        high = low if max is None else F.least(low, F.lit(float(max)))
        return F.when(c.isNotNull(), high)

    return _number(t, column, clamp)


# --- types


@operation("ConvertStringToNumeric")
def convert_string_to_numeric(t: Table, column: str, keep_raw: bool = False) -> Table:
    """With keep_raw the texts stay in <column>__raw, as those that hold no number are lost."""
    t.require(column)
    if keep_raw:
        t = t.with_column(f"{column}__raw", F.col(column))
    return _number(t, column, lambda c: c, LENIENT)


@operation("ConvertIntegerToFloat")
def convert_integer_to_float(t: Table, column: str) -> Table:
    t.require(column)
    return t.with_column(column, F.col(column).try_cast("bigint").cast("double") if is_text(t.df, column) else F.col(column).cast("double"))


@operation("ConvertToBoolean")
def convert_to_boolean(t: Table, column: str) -> Table:
    return _text(t, column, as_boolean)


# --- times


@operation("NormalizeDateTimeFormat")
def normalize_date_time_format(t: Table, column: str) -> Table:
    t.require(column)
    return t.with_column(column, F.date_trunc("second", time(t.df, column)).cast("timestamp_ntz"))


@operation("ConvertStringToDateTime")
def convert_string_to_date_time(t: Table, column: str) -> Table:
    return normalize_date_time_format(t, column)


@operation("TimestampToDateTime")
def timestamp_to_date_time(t: Table, column: str) -> Table:
    """Epoch numbers only."""
    t.require(column)
    c = F.col(column).cast("timestamp_ntz") if is_time(t.df, column) else as_epoch(text_of(F.col(column)))
    return t.with_column(column, F.date_trunc("second", c).cast("timestamp_ntz"))


@operation("ShiftDateTimeByMinutes")
def shift_date_time_by_minutes(t: Table, column: str, minutes: int) -> Table:
    t.require(column)
    return t.with_column(column, F.timestamp_add("MINUTE", F.lit(minutes), F.date_trunc("second", time(t.df, column)).cast("timestamp_ntz")))


@operation("SplitDateTimeParts")
def split_date_time_parts(t: Table, column: str, prefix: str = "") -> Table:
    t.require(column)
    base, at = prefix.strip() or column, time(t.df, column)
    parts = {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at)}
    return t.with_df(t.df.withColumns({fresh(t, f"{base}_{k}"): c.cast("bigint") for k, c in parts.items()}))


def _extract(t: Table, column: str, target: str, make) -> Table:
    t.require(column)
    return t.with_column(fresh(t, target), make(time(t.df, column)))


@operation("ExtractDateToColumn")
def extract_date_to_column(t: Table, column: str, target: str) -> Table:
    return _extract(t, column, target, F.to_date)


@operation("ExtractYearToColumn")
def extract_year_to_column(t: Table, column: str, target: str) -> Table:
    return _extract(t, column, target, lambda c: F.year(c).cast("bigint"))


@operation("ExtractMonthToColumn")
def extract_month_to_column(t: Table, column: str, target: str) -> Table:
    return _extract(t, column, target, lambda c: F.month(c).cast("bigint"))


@operation("ExtractDayToColumn")
def extract_day_to_column(t: Table, column: str, target: str) -> Table:
    return _extract(t, column, target, lambda c: F.dayofmonth(c).cast("bigint"))


@operation("ExtractHourToColumn")
def extract_hour_to_column(t: Table, column: str, target: str) -> Table:
    return _extract(t, column, target, lambda c: F.hour(c).cast("bigint"))


# --- missing values


@operation("FillNullText")
def fill_null_text(t: Table, column: str, value: str) -> Table:
    """A value that the column's type cannot hold leaves its cells null."""
    t.require(column)
    v = F.lit(value) if is_text(t.df, column) else F.lit(value).try_cast(t.df.schema[column].dataType)
    return t.with_column(column, F.when(blank(t.df, column), v).otherwise(F.col(column)))


def _fill(t: Table, column: str, forward: bool) -> Table:
    t.require(column)
    rows = carried(t.numbered(), {"__carried": F.when(~blank(t.df, column), F.col(column))}, forward=forward)
    keep = F.when(blank(t.df, column) & F.col("__carried").isNotNull(), F.col("__carried")).otherwise(F.col(column))
    return t.with_df(rows.withColumn(column, keep).drop("__carried"))


@operation("FillNullForward")
def fill_null_forward(t: Table, column: str) -> Table:
    return _fill(t, column, True)


@operation("FillNullBackward")
def fill_null_backward(t: Table, column: str) -> Table:
    return _fill(t, column, False)


@operation("FillNullStatistic")
def fill_null_statistic(t: Table, column: str, strategy: str = "mean") -> Table:
    """Mean or median of the column's numbers, or its most frequent value, of several the least."""
    t.require(column)
    kind = {"median": "median", "中位数": "median", "mode": "mode", "众数": "mode"}.get(strategy.strip().lower(), "mean")
    if kind == "mode":
        seen = t.df.filter(~blank(t.df, column)).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
        one = seen.agg(F.max(F.struct("__n")).alias("m"))
        top = seen.join(F.broadcast(one), seen["__n"] == one["m.__n"]).agg(F.min(column).alias("__value"))
    elif kind == "median":
        x = number(t.df, column, STRICT)
        middle = at_positions(t, x, [], lambda n: {"a": F.floor((n - 1) / 2), "b": F.ceil((n - 1) / 2)})
        top = middle.agg(F.first(quantile("a", "b", F.col("n"), 0.5)).alias("__value"))
    else:
        top = t.df.agg(F.avg(number(t.df, column, STRICT)).alias("__value"))
    value = top.first()[0]
    if value is None:
        raise ValueError(f"column {column!r} has no value to take the {kind} of")
    fill = F.lit(value)
    if kind != "mode" and is_text(t.df, column):
        return t.with_column(column, F.when(blank(t.df, column), fill).otherwise(number(t.df, column, STRICT)))
    cell = F.col(column) if kind == "mode" or is_text(t.df, column) else F.col(column).cast("double")
    return t.with_column(column, F.when(blank(t.df, column), fill).otherwise(cell))


@operation("EmptyStringToNull")
def empty_string_to_null(t: Table, column: str) -> Table:
    t.require(column)
    return t.with_column(column, F.when(~blank(t.df, column), F.col(column)))


@operation("ZeroToNull")
def zero_to_null(t: Table, column: str) -> Table:
    t.require(column)
    return t.with_column(column, F.when(F.coalesce(number(t.df, column, STRICT), F.lit(1.0)) != 0, F.col(column)))


@operation("ReplaceExactValue")
def replace_exact_value(t: Table, column: str, from_: str, to: str = "") -> Table:
    """Cells equal to a value, both trimmed, get another; a blank one stands for null."""
    t.require(column)
    kind = t.df.schema[column].dataType
    text = is_text(t.df, column)
    new = F.lit(to if to.strip() else None).cast("string") if text else F.lit(to.strip() or None).cast("string").try_cast(kind)
    same = trimmed(text_of(F.col(column))) == from_.strip()
    if not text:
        same = same | (as_number(text_of(F.col(column))) == as_number(F.lit(from_)))
    return t.with_column(column, F.when(F.coalesce(same, F.lit(False)), new).otherwise(F.col(column)))


