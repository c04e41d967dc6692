"""Grouped aggregation and windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import exact
from ..functions.parsing import LENIENT, STRICT, blank, number, text_of
from ..plans.table import Table, in_blocks, running_sum
from .columns import fresh
from .ordering import sort_keys
from .registry import operation
from .rows import key

FUNCTIONS = {
    "sum": "sum", "求和": "sum", "mean": "mean", "avg": "mean", "average": "mean", "平均值": "mean", "max": "max", "min": "min",
    "nunique": "nunique", "count_distinct": "nunique", "去重计数": "nunique",
}
_TINY = 2.220446049250313e-16


def function_of(name: str) -> str:
    return FUNCTIONS.get(name.strip().lower(), "count")


def aggregate(df: DataFrame, target: str, function: str, compat: bool = False) -> Column:
    """Sum and mean take numbers only, to four decimals; max and min compare in the column's type, or as text if
    `compat`; nunique counts distinct cells that are not blank; count counts rows."""
    if function == "count":
        return F.count(F.lit(1))
    cell = F.when(~blank(df, target), F.col(target))
    if function == "nunique":
        return F.count_distinct(cell)
    if function in ("sum", "mean"):
        x = number(df, target, STRICT)
        return F.round(F.sum(x) if function == "sum" else F.avg(x), 4)
    return {"max": F.max, "min": F.min}[function](text_of(cell) if compat else cell)


@operation("GroupAggregate")
def group_aggregate(t: Table, group_columns: list[str], target: str = "", function: str = "count", compat: bool = False) -> Table:
    """One row per group, in the groups' order: the group columns and count, or <function>_<target>."""
    if not group_columns:
        raise ValueError("a column to group by is needed")
    f = function_of(function)
    t.require(*group_columns, *([target] if target or f != "count" else []))
    name = "count" if f == "count" else f"{f}_{target}"
    df = t.df.withColumns({c: key(t, c) for c in group_columns})
    out = df.groupBy(*group_columns).agg(aggregate(t.df, target, f, compat).alias(name))
    return Table.of(out, *group_columns)


def _numbered(t: Table, order: list[str], groups: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows numbered by group and order, and the hidden columns that this took."""
    t.require(*groups)
    sorted_ = t.sorted_by([*((key(t, c), True, True) for c in groups), *sort_keys(t, order)])
    return sorted_.numbered(), ["__pos", "__part", *(k.name for k in sorted_.order if k not in t.order)]


def _windowed(t: Table, order: list[str], groups: list[str], reach: int, make, name: str) -> Table:
    """Adds make(window). The rows are numbered, and windows run over blocks of positions with copies of the `reach`
    rows before each, so that a group of any size, or the whole table as one, is dealt over many tasks."""
    rows, spare = _numbered(t, order, groups)
    w = Window.partitionBy("__block", *(key(t, c) for c in groups)).orderBy("__pos")
    rows = in_blocks(rows, reach).withColumn(name, make(w)).filter(~F.col("__copy"))
    return t.with_df(rows.drop("__block", "__copy", *spare))


@operation("RollingAggregate")
def rolling_aggregate(t: Table, group_columns: list[str], order_column: str, target: str, window_size: int, function: str, output: str, compat: bool = False) -> Table:
    """Over each row and the window_size - 1 rows before it, in the order of a column. What a row costs does not depend
    on the window's size: frames are told from running sums, extremes of chunks and values' last places."""
    if window_size < 1:
        raise ValueError("window_size must be above 0")
    f = function_of(function)
    t.require(order_column, *([target] if target or f != "count" else []))

    groups, name = [key(t, c) for c in group_columns], fresh(t, output)
    rows, spare = _numbered(t, [order_column], list(group_columns))
    rows = in_blocks(rows, window_size - 1)
    w = Window.partitionBy("__block", *groups).orderBy("__pos")
    rows = rows.withColumn("__nth", F.row_number().over(w) - 1)  # also deals the rows out, for all windows below
    if f == "count":
        rows = rows.withColumn(name, F.least(F.col("__nth") + 1, F.lit(window_size)).cast("long"))
    elif f in ("sum", "mean"):
        rows = _rolling_sum(rows, w, number(t.df, target, STRICT), window_size, f == "mean", name)
    elif f == "nunique":
        rows = _rolling_distinct(rows, groups, w, F.when(~blank(t.df, target), F.col(target)), window_size, name)
    else:
        cell = F.when(~blank(t.df, target), F.col(target))
        rows = _rolling_extreme(rows, groups, w, text_of(cell) if compat else cell, window_size, f, name)
    return t.with_df(rows.filter(~F.col("__copy")).drop("__block", "__copy", "__nth", *spare))


def _rolling_sum(rows: DataFrame, w: Window, x: Column, size: int, mean: bool, name: str) -> DataFrame:
    """A frame's sum is the running sum up to its end less that up to its start."""
    parts = exact.amounts(x)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__{k}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in parts.items()})
    rows = rows.withColumns({f"__was_{k}": F.lag(f"__{k}", size).over(w) for k in parts})
    of = lambda k: F.col(f"__{k}") - F.coalesce(f"__was_{k}", F.lit(0))
    value = exact.total(of) / of("n") if mean else exact.total(of)
    return rows.withColumn(name, F.when(of("n") > 0, F.round(value, 4))).drop(*(x for k in parts for x in (f"__{k}", f"__was_{k}")))


def _rolling_extreme(rows: DataFrame, groups: list[Column], w: Window, cell: Column, size: int, f: str, name: str) -> DataFrame:
    """Rows are cut into chunks as long as the frame. A frame ends in one chunk and starts in the one before it: its
    extreme is that of the first chunk from the frame's start on and of the second up to the frame's end."""
    best, both = (F.max, F.greatest) if f == "max" else (F.min, F.least)
    rows = rows.withColumns({"__cell": cell, "__chunk": F.expr(f"__nth div {size}")})
    inside = Window.partitionBy("__block", *groups, "__chunk")
    head = best("__cell").over(inside.orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    tail = best("__cell").over(inside.orderBy(F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__head": head, "__tail": tail}).withColumn("__tail", F.lag("__tail", size - 1).over(w))
    return rows.withColumn(name, both("__head", "__tail")).drop("__cell", "__chunk", "__head", "__tail")


def _rolling_distinct(rows: DataFrame, groups: list[Column], w: Window, cell: Column, size: int, name: str) -> DataFrame:
    """A value counts in a frame where it stands there last: from its row on, until it comes again or the frame has left
    it behind. So a frame's number of values is a running sum of what enters less what leaves at each row."""
    rows = rows.withColumn("__cell", cell)
    alike = Window.partitionBy("__block", *groups, "__cell").orderBy("__pos")
    rows = rows.withColumns({"__before": F.lag("__nth").over(alike), "__after": F.lead("__nth").over(alike)})
    there = F.col("__cell").isNotNull()
    again = there & F.coalesce(F.col("__nth") - F.col("__before") <= size, F.lit(False))
    stays = there & F.coalesce(F.col("__after") - F.col("__nth") > size, F.lit(True))
    rows = rows.withColumn("__left", F.coalesce(F.lag(stays.cast("int"), size).over(w), F.lit(0)))
    change = there.cast("int") - again.cast("int") - F.col("__left")
    return rows.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__cell", "__before", "__after", "__left")


@operation("MovingAverage")
def moving_average(t: Table, order_column: str, target: str, window_size: int, output: str, group_columns: list[str] = ()) -> Table:
    return rolling_aggregate(t, list(group_columns), order_column, target, window_size, "mean", output)


@operation("CumulativeSum")
def cumulative_sum(t: Table, order_column: str, target: str, output: str, group_columns: list[str] = ()) -> Table:
    """Null until the first number. Runs of positions are summed each on their own and start at what the runs before
    them hand on."""
    t.require(order_column, target)
    name = fresh(t, output)
    rows, spare = _numbered(t, [order_column], list(group_columns))
    rows = running_sum(rows, name, number(t.df, target, LENIENT), [key(t, c) for c in group_columns])
    return t.with_df(rows.drop(*spare))


MODES = {"rate": "rate", "变化率": "rate", "increase": "increase", "是否上升": "increase", "decrease": "decrease", "是否下降": "decrease"}


@operation("CompareAdjacent")
def compare_adjacent(t: Table, order_column: str, target: str, mode: str, output: str, group_columns: list[str] = ()) -> Table:
    """With the row before: difference, rate of change, or whether it rose or fell. The first row has none. Rise and
    fall compare numbers, or texts where a cell is no number; null is below everything."""
    t.require(order_column, target)
    kind, x, cell = MODES.get(mode.strip().lower(), "difference"), number(t.df, target, LENIENT), F.col(target)

    def make(w: Window) -> Column:
        before = F.lag(x).over(w)
        if kind == "difference":
            return x - before
        if kind == "rate":
            return F.when(F.abs(before) >= _TINY, F.try_divide(x - before, before))
        was = F.lag(cell).over(w)
        first = F.lag(F.lit(1)).over(w).isNull()
        up, down = (x > before, x < before)
        text_up, text_down = text_of(cell) > text_of(was), text_of(cell) < text_of(was)
        both = x.isNotNull() & before.isNotNull()
        if kind == "increase":
            rose = F.when(both, up).when(cell.isNull(), False).when(was.isNull(), True).otherwise(text_up)
        else:
            rose = F.when(both, down).when(was.isNull(), False).when(cell.isNull(), True).otherwise(text_down)
        return F.when(~first, rose)

    return _windowed(t, [order_column], list(group_columns), 1, make, fresh(t, output))
