"""Sorting and ranks. A sort changes the order that a table carries; rows move when the order is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.compare import matches
from ..functions.parsing import is_text, number, time
from ..plans.table import Table
from .columns import fresh
from .registry import operation


def sort_keys(t: Table, columns: list[str], ascending: list[bool] = ()) -> list[tuple[Column, bool, bool]]:
    """Rising: null last; falling: null first. Missing directions are rising. A text column that was labelled a number
    sorts by number, those that are none before the others."""
    t.require(*columns)
    if not columns:
        raise ValueError("a column to sort by is needed")
    out = []
    for i, c in enumerate(columns):
        asc = ascending[i] if i < len(ascending) else True
        if is_text(t.df, c) and t.labels.get(c) in ("integer", "float"):
            x = number(t.df, c, "")
            out += [(F.when(F.col(c).isNotNull(), x.isNotNull()), asc, not asc), (x, asc, asc)]
        else:
            out.append((F.col(c), asc, not asc))
    return out


@operation("SortBy")
def sort_by(t: Table, column: str, ascending: bool = True) -> Table:
    return t.sorted_by(sort_keys(t, [column], [ascending]))


@operation("MultiSort")
def multi_sort(t: Table, columns: list[str], ascending: list[bool] = ()) -> Table:
    return t.sorted_by(sort_keys(t, columns, list(ascending)))


@operation("PrioritySort")
def priority_sort(t: Table, column: str, operator: str, value: str, placement: str = "first", columns: list[str] = (), ascending: list[bool] = ()) -> Table:
    """Rows that match come first, or last, and within both parts the secondary columns sort."""
    t.require(column)
    last = placement.strip().lower() in ("last", "优先置后")
    rest = sort_keys(t, list(columns), list(ascending)) if columns else []
    return t.sorted_by([(matches(t.df, column, operator, value), last, True), *rest])


@operation("AddRankColumn")
def add_rank_column(t: Table, target: str, columns: list[str], ascending: list[bool] = ()) -> Table:
    """The place that each row would have after sorting, 1, 2, 3 and so on; ties follow the table's order, which stays."""
    name = fresh(t, target)
    ranked = t.sorted_by(sort_keys(t, columns, list(ascending)))
    rows = ranked.numbered().withColumn(name, F.col("__pos"))
    return t.with_df(rows.drop("__pos", "__part", *(k.name for k in ranked.order if k not in t.order)))


@operation("SortByDateTime")
def sort_by_date_time(t: Table, column: str, ascending: bool = True) -> Table:
    """Cells without a time come first if rising and last if falling, unlike in other sorts."""
    t.require(column)
    return t.sorted_by([(time(t.df, column), ascending, ascending)])
