"""Equi-joins of two ordered tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import is_text, text_of
from ..plans.table import Key, Table

KINDS = {"inner": "inner", "内连接": "inner", "outer": "full_outer", "full": "full_outer", "外连接": "full_outer"}


def kind_of(name: str) -> str:
    return KINDS.get(name.strip().lower(), "left")


def _key(df: DataFrame, name: str, as_text: bool) -> Column:
    return F.coalesce(text_of(F.col(name)), F.lit("")) if as_text else F.col(name)


def _check(left: Table, right: Table, left_keys: list[str], right_keys: list[str]) -> list[bool]:
    """Whether each pair of keys is compared as text, in which null equals the empty text."""
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("both sides need as many keys, one at least")
    left.require(*left_keys)
    right.require(*right_keys)
    pairs = zip(left_keys, right_keys, strict=True)
    return [is_text(left.df, a) or is_text(right.df, b) or left.df.schema[a].dataType != right.df.schema[b].dataType for a, b in pairs]


def right_names(left: list[str], right: list[str], right_keys: list[str], conflict: str) -> dict[str, str]:
    """The right side's columns in the result, without its keys, and their names there."""
    out: dict[str, str] = {}
    for c in right:
        if c in right_keys:
            continue
        name = c
        if c in left:
            if conflict == "keep_left_only":
                continue
            name = f"right_{c}" if conflict == "right_prefix" else f"{c}_right"
        while name in left or name in out.values():
            name += "_r"
        out[c] = name
    return out


def join_tables(left: Table, right: Table, left_keys: list[str], right_keys: list[str], kind: str = "left", conflict: str = "suffix") -> Table:
    """Left columns, then the right ones but its keys. A null key equals a null key, and the empty text. In an outer
    join a right row without partner has nulls for all left columns, keys included. Rows keep the left side's order,
    matches the right side's; right rows without partner come last."""
    as_text = _check(left, right, left_keys, right_keys)
    names = right_names(left.columns, right.columns, right_keys, conflict)
    keys = [f"__key{i}" for i in range(len(left_keys))]
    a = left.df.select(
        *(_key(left.df, c, t).alias(k) for c, t, k in zip(left_keys, as_text, keys, strict=True)), *left.columns,
        *(F.col(k.name).alias(f"__l{i}") for i, k in enumerate(left.order)), F.lit(0).alias("__in_left"),
    )
    b = right.df.select(
        *(_key(right.df, c, t).alias(f"{k}r") for c, t, k in zip(right_keys, as_text, keys, strict=True)),
        *(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)), *(F.col(k.name).alias(f"__r{i}") for i, k in enumerate(right.order)),
    )
    on = reduce(and_, (a[k].eqNullSafe(b[f"{k}r"]) for k in keys))
    outer = kind_of(kind) == "full_outer"
    rows = a.join(b, on, "left" if outer else kind_of(kind))
    if outer:  # Spark splits a key of very many rows in a left join and in an anti-join, but not in a full outer one
        known = a.select(*keys).distinct()
        alone = b.join(known, reduce(and_, (known[k].eqNullSafe(b[f"{k}r"]) for k in keys)), "left_anti")
        rows = rows.unionByName(alone, allowMissingColumns=True)
    rows = rows.withColumn("__side", F.coalesce("__in_left", F.lit(1)))
    order = [Key("__side")] + [Key(f"__{s}{i}", k.ascending, k.nulls_first) for s, t in (("l", left), ("r", right)) for i, k in enumerate(t.order)]
    hidden = [k.name for k in order]
    rows = rows.select(*left.columns, *(F.col(f"__c{i}").alias(n) for i, n in enumerate(names.values())), *hidden)
    return Table(rows, tuple(order), {**right.labels, **left.labels})


def join_report(left: Table, right: Table, left_keys: list[str], right_keys: list[str], kind: str | None = None) -> DataFrame:
    """One row: matched_pairs, unmatched_left, unmatched_right, conflict_fields and, for a kind of join, data_loss_hint. Both sides are counted per key before
    they meet, so a key with very many rows is one row on each side."""
    as_text = _check(left, right, left_keys, right_keys)
    keys = [f"k{i}" for i in range(len(left_keys))]

    def counted(t: Table, own: list[str], name: str) -> DataFrame:
        cols = [_key(t.df, c, x).alias(k) for c, x, k in zip(own, as_text, keys, strict=True)]
        return t.df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))

    a, b = counted(left, left_keys, "nl"), counted(right, right_keys, "nr")
    both = a.join(b, reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys)), "full_outer")
    clash = sorted(set(left.columns) & (set(right.columns) - set(right_keys)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = both.agg(
        total(F.col("nl") * F.col("nr")).alias("matched_pairs"), total(F.when(F.col("nr").isNull(), F.col("nl"))).alias("unmatched_left"),
        total(F.when(F.col("nl").isNull(), F.col("nr"))).alias("unmatched_right"), F.lit(", ".join(clash)).alias("conflict_fields"),
    )
    if kind is None:
        return out
    row = out.first()
    return out.withColumn("data_loss_hint", F.lit(loss_hint(kind, row.unmatched_left, row.unmatched_right)))


def loss_hint(kind: str, unmatched_left: int, unmatched_right: int) -> str:
    """What a join of this kind loses or fills with nulls, in words."""
    how = kind_of(kind)
    if how == "left":
        return f"左连接未保留右表未匹配记录 {unmatched_right} 条" if unmatched_right else "左连接未发现右表未匹配记录"
    if how == "inner":
        return f"内连接丢弃了未匹配记录：左表 {unmatched_left} 条，右表 {unmatched_right} 条" if unmatched_left or unmatched_right else "内连接全部记录均成功匹配"
    return "外连接已保留未匹配记录，结果中可能出现空值列" if unmatched_left or unmatched_right else "外连接未发现未匹配记录"
