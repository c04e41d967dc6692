"""The tables behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import CHART, is_number, is_text, is_time, number, text_of, time, trimmed
from ..plans.table import Table, at_positions, quantile
from .profile import kind_of

EMPTY = "空值"


def xy_points(t: Table, x: str, y: str) -> DataFrame:
    """x and y: x a number, else seconds of a time, else the row's number from 1. Rows without a y go."""
    rows = t if is_number(t.df, x) and not t.df.filter(F.col(x).isNull()).limit(1).count() else t.with_df(t.numbered())
    if rows is t:  # no row's number is asked for
        return t.df.select(F.col(x).cast("double").alias("x"), number(t.df, y, CHART).alias("y")).filter("y is not null")
    at = F.coalesce(number(rows.df, x, CHART), F.unix_timestamp(time(rows.df, x).cast("timestamp")).cast("double"), F.col("__pos").cast("double"))
    return rows.df.select(at.alias("x"), number(rows.df, y, CHART).alias("y")).filter("y is not null")


def category_totals(t: Table, label: str, value: str, floor_at_zero: bool = False) -> DataFrame:
    """label and total, in the labels' order; a blank label is one of its own. Funnels take no total below 0."""
    name = F.coalesce(F.nullif(trimmed(text_of(F.col(label))), F.lit("")), F.lit(EMPTY))
    out = t.df.groupBy(name.alias("label")).agg(F.coalesce(F.sum(number(t.df, value, CHART)), F.lit(0.0)).alias("total"))
    return out.withColumn("total", F.greatest("total", F.lit(0.0))) if floor_at_zero else out


def histogram(t: Table, column: str, bins: int = 12) -> DataFrame:
    """bin, low, high, count of equal widths from least to largest, half a unit to either side if they are the same."""
    bins = min(max(bins, 1), 100)
    x = number(t.df, column, CHART)
    rows = t.df.select(x.alias("x")).filter("x is not null and not isnan(x)")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = t.df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counted, "bin", "left")
    return out.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def box_groups(t: Table, value: str, group: str | None = None) -> DataFrame:
    """group, count, minimum, quartiles and maximum; without a group column all rows are one group."""
    name = F.coalesce(F.nullif(trimmed(text_of(F.col(group))), F.lit("")), F.lit(EMPTY)) if group else F.lit("样本组")
    x = number(t.df, value, CHART)
    parts = {"q1": 0.25, "median": 0.5, "q3": 0.75}

    def places(n: Column) -> dict[str, Column]:
        of = {f"{k}_{side}": f((n - 1) * F.lit(q)) for k, q in parts.items() for side, f in (("low", F.floor), ("high", F.ceil))}
        return {"minimum": F.lit(0), **of, "maximum": n - 1}

    found = at_positions(t, x, [name], places)
    middle = [quantile(f"{k}_low", f"{k}_high", F.col("n"), q).alias(k) for k, q in parts.items()]
    return found.select(F.col("k0").alias("group"), F.col("n").alias("count"), "minimum", *middle, "maximum")


def heatmap(t: Table, columns: list[str] = (), rows: int = 80) -> DataFrame:
    """The first rows and up to six numeric columns; what is no number is 0."""
    names = list(columns or [c for c in t.columns if kind_of(t.df, c) in ("integer", "float")])[:6]
    return t.df.orderBy(*t.sort).limit(rows).select(*(F.coalesce(number(t.df, c, CHART), F.lit(0.0)).alias(c) for c in names))


def suggest_fields(t: Table) -> dict[str, str | None]:
    """Columns to begin a chart with: x (a time, else a text), y (the first number), group (the first text)."""
    times = [c for c in t.columns if is_time(t.df, c) or "time" in c.lower() or "date" in c.lower()]
    numbers = [c for c in t.columns if kind_of(t.df, c) in ("integer", "float") and not c.lower().endswith(("id", "key"))]
    texts = [c for c in t.columns if is_text(t.df, c) and c not in times]
    return {"x": next(iter(times or texts), None), "y": next(iter(numbers), None), "group": next(iter(texts), None)}
