"""Comparison of a cell with a text: as numbers if both are, else as times if both are, else as trimmed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import as_number, as_time, blank, is_text, number, text_of, time, trimmed

OPERATORS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "contains": "contains", "包含": "contains", "empty": "empty", "is_empty": "empty", "为空": "empty"}


def matches(df: DataFrame, name: str, operator: str, value: str) -> Column:
    """True or false, never null. A null cell equals nothing and is unequal to everything; `contains` heeds case."""
    op = OPERATORS.get(operator.strip().lower(), "=")
    c = F.col(name)
    if op == "empty":
        return blank(df, name)
    text = trimmed(text_of(c))
    if op == "contains":
        return F.coalesce(text_of(c).contains(value.strip()), F.lit(False))
    v = F.lit(value)
    x, y = number(df, name), as_number(v, ",， ")
    if not is_text(df, name) and x is not None:
        x = F.coalesce(x, as_number(text_of(c), ",， "))
    s, e = time(df, name), as_time(v)
    to = {"=": Column.__eq__, "!=": Column.__eq__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}[op]
    # Spark holds NaN equal to itself; here it compares with nothing.
    as_numbers = F.when(x.isNotNull() & y.isNotNull(), to(x, y) & ~F.isnan(x) & ~F.isnan(y))
    as_times = F.when(s.isNotNull() & e.isNotNull(), to(s, e))
    found = F.coalesce(as_numbers, as_times, to(text, trimmed(v)), F.lit(False))
    return ~found if op == "!=" else found
