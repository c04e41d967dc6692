"""Row selection."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.parsing import as_time, blank, is_text, text_of, time
from ..plans.selection import POSITIONS, row_range, rows_at
from ..plans.table import Table
from .registry import filled, operation

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(t: Table, name: str) -> Column:
    """A grouping key in which null and the empty text are one."""
    return F.coalesce(F.col(name), F.lit("")) if is_text(t.df, name) else F.col(name)


@operation("Reinspect")
def reinspect(t: Table) -> Table:
    return t


@operation("DropEmptyRows")
def drop_empty_rows(t: Table) -> Table:
    return t.filter(~reduce(and_, (blank(t.df, c) for c in t.columns)))


def first_of_each(t: Table, names: list[str]) -> Table:
    """The first row, in the table's order, of each combination of values. Tasks keep one row for each before any row
    moves, so a combination with very many rows is no burden."""
    t.require(*names)
    rising = all(k.ascending and k.nulls_first for k in t.order)
    df = t.df if rising else t.numbered()
    place = F.struct(*(k.name for k in t.order)) if rising else F.col("__pos")
    groups = [key(t, c).alias(f"__g{i}") for i, c in enumerate(names)]
    first = df.groupBy(*groups).agg(F.min_by(F.struct(*t.df.columns), place).alias("__row"))
    return t.with_df(first.select(*(F.col("__row")[c].alias(c) for c in t.df.columns)))


@operation("DeduplicateRows")
def deduplicate_rows(t: Table) -> Table:
    return first_of_each(t, t.columns)


@operation("DeduplicateByColumns")
def deduplicate_by_columns(t: Table, columns: list[str]) -> Table:
    if not columns:
        raise ValueError("columns to compare are needed")
    return first_of_each(t, columns)


def _contains(t: Table, column: str, keyword: str) -> Column:
    t.require(filled(column, "column"))
    word = filled(keyword, "keyword").translate(str.maketrans(_UPPER, _LOWER))
    return F.coalesce(F.translate(text_of(F.col(column)), _UPPER, _LOWER).contains(word), F.lit(False))


@operation("FilterRowsContains")
def filter_rows_contains(t: Table, column: str, keyword: str) -> Table:
    """Keeps rows whose cell holds the keyword; A-Z and a-z are alike."""
    return t.filter(_contains(t, column, keyword))


@operation("DropRowsNotContains")
def drop_rows_containing(t: Table, column: str, keyword: str) -> Table:
    """Drops rows whose cell holds the keyword, which the operation's name does not say; null cells stay."""
    return t.filter(~_contains(t, column, keyword))


def _range(t: Table, start: int, end: int, keep: bool) -> Table:
    if not 1 <= start <= end:
        raise ValueError("a row range needs 1 <= start <= end")
    return row_range(t, start, end, keep)


@operation("KeepRowRange")
def keep_row_range(t: Table, start: int, end: int) -> Table:
    return _range(t, start, end, True)


@operation("DropRowRange")
def drop_row_range(t: Table, start: int, end: int) -> Table:
    return _range(t, start, end, False)


@operation("KeepTopRows")
def keep_top_rows(t: Table, count: int) -> Table:
    """The first rows in order: sorting and the limit are one step, which keeps `count` rows of each task."""
    if count <= 0:
        raise ValueError("count must be above 0")
    return t.with_df(t.df.orderBy(*t.sort).limit(count))


@operation("SampleRows")
def sample_rows(t: Table, count: int) -> Table:
    """Rows at even steps from the first to the last; all rows if there are no more than `count`."""
    if count <= 0:
        raise ValueError("count must be above 0")
    n = t.df.count()
    if count >= n:
        return t
    step = max(count - 1, 1)
    if count <= POSITIONS:
        rows = rows_at(t, sorted({k * (n - 1) // step + 1 for k in range(count)}), n)
        if rows is not None:
            return t.with_df(rows.drop("__place"))
    rows = t.numbered()
    at = rows.sparkSession.range(count).select((F.floor(F.col("id") * (n - 1) / step) + 1).alias("__pos")).distinct()
    return t.with_df(rows.join(at, "__pos", "left_semi"))


def _missing(t: Table, columns: list[str]) -> Column:
    t.require(*columns)
    return reduce(or_, (blank(t.df, c) for c in columns or t.columns))


@operation("KeepRowsWithMissing")
def keep_rows_with_missing(t: Table, columns: list[str] = ()) -> Table:
    return t.filter(_missing(t, list(columns)))


@operation("DropRowsWithMissing")
def drop_rows_with_missing(t: Table, columns: list[str] = ()) -> Table:
    return t.filter(~_missing(t, list(columns)))


@operation("FilterRowsByTimeWindow")
def filter_rows_by_time_window(t: Table, column: str, start: str, end: str) -> Table:
    """Times from start to end, both included; cells that hold no time go."""
    t.require(column)
    low, high = t.df.sparkSession.range(1).select(as_time(F.lit(start)), as_time(F.lit(end))).first()
    if low is None or high is None or low > high:
        raise ValueError("a time window needs two times, the first not after the second")
    at = time(t.df, column)
    return t.filter(at.between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
