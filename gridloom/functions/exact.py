"""Sums of numbers that can be subtracted from one another without losing digits.

A running sum of doubles forgets small numbers behind large ones, and infinity or NaN would stay in it for ever. So a
number is summed as a decimal; what is too large for that, and what is not finite, is kept apart and counted, so that it
matters only where it is. Only large numbers among themselves are sums of doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,12)"
#: Numbers from here on are summed as doubles: the decimals above would not hold many of them.
LARGE = 1e15


def amounts(x: Column, whole: bool = False) -> dict[str, Column]:
    """What is summed for a double: n (how many), s (decimals) and, unless all are whole numbers, l and k (large ones, and how many), u
    (how many are no number), p and m (how many are infinite, above and below)."""
    if whole:
        return {"n": F.when(x.isNotNull(), 1).cast("long"), "s": x.cast(EXACT)}
    small = F.abs(x) < LARGE
    return {
        "n": F.when(x.isNotNull(), 1).cast("long"), "s": F.when(small, x).cast(EXACT), "l": F.when(~small & (F.abs(x) < float("inf")), x), "k": F.when(~small & (F.abs(x) < float("inf")), 1).cast("long"),
        "u": F.when(F.isnan(x), 1).cast("long"), "p": F.when(x == float("inf"), 1).cast("long"), "m": F.when(x == float("-inf"), 1).cast("long"),
    }


def total(of: Callable[[str], Column], whole: bool = False) -> Column:
    """The sum as a double, from the sums of the amounts (0 where there was none)."""
    out = of("s").cast("double")
    if whole:
        return out
    up, down = of("p") > 0, of("m") > 0
    return F.when((of("u") > 0) | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(F.when(of("k") > 0, out + of("l")).otherwise(out))
