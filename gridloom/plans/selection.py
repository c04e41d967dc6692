"""Rows by position, without moving the table: the keys at given positions are found by counting, and rows are then
chosen by comparing keys.

A sample of the keys gives bounds, one pass over the key columns counts the rows between them, and only the stretches
that hold a wanted position are cut again, until they are short enough to be sorted by a task each. Nothing is written,
no whole row is shuffled, and what is found is a filter, which reaches the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .table import Table

#: Bounds in a pass, positions looked for at once, keys sampled in a pass, and rows that a task sorts.
BOUNDS, POSITIONS, SAMPLED, SORTED = 64, 64, 4000, 200_000
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

Bound = tuple  # a key's parts as text, None for null


@dataclass(frozen=True)
class Stretch:
    """Rows from a bound on and before another (None: from the first, to the last), how many come before, how many there are."""

    low: Bound | None
    high: Bound | None
    start: int
    size: int


class Keys:
    """The order of a table, for comparison of its rows with keys."""

    def __init__(self, t: Table):
        self.t, self.order = t, t.order
        self.types = [t.df.schema[k.name].dataType for k in t.order]

    @property
    def plain(self) -> bool:
        """Whether each part of the key can be told as text and read back equal."""
        return bool(self.order) and all(isinstance(k, _PLAIN) for k in self.types)

    def texts(self) -> list[Column]:
        return [F.col(k.name).cast("string").alias(f"k{i}") for i, k in enumerate(self.order)]

    def before(self, bound: Bound, same: bool = False) -> Column:
        """Whether a row comes before the bound, or is at it, if `same` counts."""
        out, equal = [], []
        for k, kind, text in zip(self.order, self.types, bound, strict=True):
            c = F.col(k.name)
            if text is None:
                less = F.lit(False) if k.nulls_first else c.isNotNull()
                alike = c.isNull()
            else:
                value = F.lit(text).cast(kind)
                less = F.when(c.isNull(), F.lit(k.nulls_first)).otherwise(c < value if k.ascending else c > value)
                alike = F.coalesce(c == value, F.lit(False))
            out.append(reduce(and_, [*equal, less]))
            equal.append(alike)
        if same:
            out.append(reduce(and_, equal))
        return reduce(or_, out)

    def inside(self, s: Stretch) -> Column:
        out = F.lit(True)
        if s.low is not None:
            out = out & ~self.before(s.low)
        return out if s.high is None else out & self.before(s.high)

    def at(self, bound: Bound) -> Column:
        parts = zip(self.order, self.types, bound, strict=True)
        return reduce(and_, (F.col(k.name).eqNullSafe(F.lit(text).cast(kind)) for k, kind, text in parts))


def _numbered_stretches(keys: Keys, stretches: list[Stretch]) -> DataFrame:
    """The rows of the stretches with __of, the number of theirs."""
    of = reduce(lambda c, x: c.when(keys.inside(x[1]), x[0]), list(enumerate(stretches))[1:], F.when(keys.inside(stretches[0]), 0))
    return keys.t.df.select(*(k.name for k in keys.order), of.alias("__of")).filter("__of is not null")


def _cut(keys: Keys, stretches: list[Stretch], each: int) -> list[Stretch]:
    """The stretches, each cut at up to `each` sampled keys."""
    rows = _numbered_stretches(keys, stretches)
    total = sum(s.size for s in stretches)
    sample = rows.sample(min(1.0, SAMPLED / total), 7).orderBy(*keys.t.sort).select("__of", *keys.texts()).collect()
    cuts: list[list[Bound]] = []
    for n in range(len(stretches)):
        own = [tuple(r[1:]) for r in sample if r[0] == n]
        cuts.append(list(dict.fromkeys(own[(k + 1) * len(own) // (each + 1)] for k in range(each) if own)))
    bounds = [F.when(F.col("__of") == n, sum((F.when(keys.before(b), 0).otherwise(1) for b in own), F.lit(0))) for n, own in enumerate(cuts)]
    counted = {(r[0], r[1]): r[2] for r in rows.groupBy("__of", F.coalesce(*bounds).alias("piece")).count().collect()}
    out = []
    for n, (s, own) in enumerate(zip(stretches, cuts, strict=True)):
        edges, start = [s.low, *own, s.high], s.start
        for k in range(len(own) + 1):
            size = counted.get((n, k), 0)
            out.append(Stretch(edges[k], edges[k + 1], start, size))
            start += size
    return out


def keys_at(keys: Keys, positions: list[int], rows: int) -> dict[int, Bound] | None:
    """The keys of the rows at positions from 1, of which there are `rows`; None where keys do not tell these rows
    apart, or cannot be compared as text."""
    if not keys.plain or len(positions) > POSITIONS:
        return None
    found = [Stretch(None, None, 0, rows)]
    while (largest := max(s.size for s in found)) > SORTED:
        small = [s for s in found if s.size <= SORTED]
        large = [s for s in found if s.size > SORTED]
        pieces = _cut(keys, large, max(2, BOUNDS // len(large)))
        found = small + [s for s in pieces if any(s.start < p <= s.start + s.size for p in positions)]
        if max(s.size for s in found) == largest:
            return None
    place = F.row_number().over(Window.partitionBy("__of").orderBy(*keys.t.sort))
    first = reduce(lambda c, x: c.when(F.col("__of") == x[0], x[1].start), list(enumerate(found))[1:], F.when(F.col("__of") == 0, found[0].start))
    alike = F.count(F.lit(1)).over(Window.partitionBy("__of", *(k.name for k in keys.order)))
    numbered = _numbered_stretches(keys, found).withColumns({"__place": (place + first).cast("long"), "__alike": alike})
    picked = numbered.filter(F.col("__place").isin(positions)).select("__place", "__alike", *keys.texts()).collect()
    if any(r["__alike"] > 1 for r in picked):
        return None
    return {r["__place"]: tuple(r[2:]) for r in picked}


def row_range(t: Table, start: int, end: int, keep: bool = True) -> Table:
    """The rows from one position to another, both from 1 and included, or all but these."""
    keys, rows = Keys(t), t.df.count()
    last = min(end, rows)
    if start > rows:
        return t.filter(F.lit(not keep))
    if start <= 1 and last == rows:
        return t.filter(F.lit(keep))
    at = keys_at(keys, sorted({start, last}), rows)
    if at is None:
        inside = F.col("__pos").between(start, end)
        return t.with_df(t.numbered().filter(inside if keep else ~inside))
    inside = keys.before(at[last], same=True)
    if start > 1:
        inside = inside & ~keys.before(at[start])
    return t.filter(inside if keep else ~inside)


def rows_at(t: Table, positions: list[int], rows: int) -> DataFrame | None:
    """The rows at positions from 1 with __place, their place in the list; None as for `keys_at`."""
    keys = Keys(t)
    at = keys_at(keys, sorted(set(positions)), rows)
    if at is None:
        return None
    if not positions:
        return t.df.filter(F.lit(False)).withColumn("__place", F.lit(0))
    place = reduce(lambda c, x: c.when(keys.at(at[x[1]]), x[0]), list(enumerate(positions))[1:], F.when(keys.at(at[positions[0]]), 0))
    return t.df.withColumn("__place", place).filter("__place is not null")
