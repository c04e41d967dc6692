"""Column selection, names and derived columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arithmetic import arithmetic
from ..functions.compare import matches
from ..functions.parsing import as_boolean, blank, seconds_between, text_of, time, trimmed
from ..plans.table import Table
from .registry import filled, operation

TYPES = {
    "int": "bigint", "integer": "bigint", "整数": "bigint", "float": "double", "double": "double", "浮点": "double",
    "bool": "boolean", "boolean": "boolean", "布尔": "boolean", "datetime": "timestamp_ntz", "time": "timestamp_ntz", "时间": "timestamp_ntz",
}
_LABELS = {"bigint": "integer", "double": "float", "boolean": "boolean", "timestamp_ntz": "datetime", "string": "text"}


def fresh(t: Table, name: str) -> str:
    name = filled(name, "target")
    if name in t.columns:
        raise ValueError(f"column {name!r} exists already")
    return name


def normalised(names: list[str]) -> list[str]:
    """White space becomes single underscores, A-Z lower case, no name column_i; the k-th of a name gets _k."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = "_".join(re.sub(r"[\r\n\t　]", " ", name.strip()).split()) or f"column_{i + 1}"
        base = re.sub("[A-Z]", lambda m: m[0].lower(), base)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def renamed(t: Table, names: dict[str, str]) -> Table:
    new = [names.get(c, c) for c in t.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns would have the same name")
    hidden = [c for c in t.df.columns if c not in t.columns]
    return t.with_df(t.df.select(*(F.col(c).alias(names.get(c, c)) for c in t.columns), *hidden))


@operation("NormalizeColumnNames")
def normalize_column_names(t: Table) -> Table:
    return renamed(t, dict(zip(t.columns, normalised(t.columns), strict=True)))


@operation("RenameColumn")
def rename_column(t: Table, from_: str, to: str) -> Table:
    t.require(from_)
    return renamed(t, {from_: filled(to, "the new name")})


@operation("KeepColumns")
def keep_columns(t: Table, columns: list[str]) -> Table:
    """In the table's order; names it does not have are ignored."""
    left = [c for c in t.columns if c in set(columns)]
    if not left:
        raise ValueError("no column would be left")
    return t.select(left)


@operation("DropColumns")
def drop_columns(t: Table, columns: list[str]) -> Table:
    return keep_columns(t, [c for c in t.columns if c not in set(columns)])


@operation("DropEmptyColumns")
def drop_empty_columns(t: Table) -> Table:
    """Columns without a cell that is not blank go, which one aggregation over all columns finds."""
    found = t.df.agg(*(F.coalesce(F.bool_or(~blank(t.df, c)), F.lit(False)).alias(c) for c in t.columns)).first()
    return keep_columns(t, [c for c in t.columns if found[c]])


@operation("ReorderColumns")
def reorder_columns(t: Table, columns: list[str]) -> Table:
    t.require(*columns)
    first = list(dict.fromkeys(columns))
    return t.select(first + [c for c in t.columns if c not in first])


@operation("AddColumnNameAffix")
def add_column_name_affix(t: Table, prefix: str = "", suffix: str = "") -> Table:
    return renamed(t, {c: f"{prefix}{c}{suffix}" for c in t.columns})


@operation("DuplicateColumn")
def duplicate_column(t: Table, source: str, target: str) -> Table:
    t.require(source)
    return t.with_column(fresh(t, target), F.col(source))


@operation("MergeColumns")
def merge_columns(t: Table, columns: list[str], target: str, separator: str = "") -> Table:
    """The trimmed parts that are not blank, joined; null if there are none."""
    if len(columns) < 2:
        raise ValueError("two columns or more are needed")
    t.require(*columns)
    parts = F.filter(F.array(*(trimmed(text_of(F.col(c))) for c in columns)), lambda x: x.isNotNull() & (x != ""))
    return t.with_column(fresh(t, target), F.when(F.size(parts) > 0, F.concat_ws(separator, parts)))


@operation("ConcatColumns")
def concat_columns(t: Table, columns: list[str], target: str, separator: str = "") -> Table:
    return merge_columns(t, columns, target, separator)


@operation("AddRowNumberColumn")
def add_row_number_column(t: Table, column: str, start: int = 1) -> Table:
    name = fresh(t, column)
    return t.with_df(t.numbered().withColumn(name, F.col("__pos") + F.lit(start - 1)))


def literal(value: str | None) -> Column:
    """A text as the value it spells: whole number, number, truth, or itself."""
    text = (value or "").strip()
    if re.fullmatch(r"[+-]?[0-9]{1,18}", text):
        return F.lit(int(text))
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
        return F.lit(float(text))
    if text.lower() in ("true", "yes", "y", "是", "false", "no", "n", "否"):
        return F.lit(text.lower() in ("true", "yes", "y", "是"))
    return F.lit(value) if text else F.lit(None).cast("string")


@operation("AddConstantColumn")
def add_constant_column(t: Table, target: str, value: str) -> Table:
    return t.with_column(fresh(t, target), literal(value))


@operation("AddExpressionColumn")
def add_expression_column(t: Table, target: str, expression: str) -> Table:
    return t.with_column(fresh(t, target), arithmetic(t.df, filled(expression, "expression")))


@operation("AddConditionalColumn")
def add_conditional_column(t: Table, target: str, source: str, operator: str, value: str, true_value: str, false_value: str) -> Table:
    t.require(source)
    yes, no = literal(true_value), literal(false_value)
    kinds = {type(x) for x in (yes, no)}
    spark = t.df.sparkSession
    types = [f.dataType for f in spark.range(1).select(yes.alias("a"), no.alias("b")).schema if (true_value if f.name == "a" else false_value).strip()]
    if len({str(k) for k in types}) > 1:  # numbers of both kinds become doubles, anything else text
        kind = "double" if all(str(k) in ("IntegerType()", "LongType()", "DoubleType()") for k in types) else "string"
        if kind == "string":
            yes, no = F.lit(true_value), F.lit(false_value)
        yes, no = yes.cast(kind), no.cast(kind)
    elif types and kinds:
        yes, no = yes.cast(types[0]), no.cast(types[0])
    return t.with_column(fresh(t, target), F.when(matches(t.df, source, operator, value), yes).otherwise(no))


UNITS = {"second": 1, "seconds": 1, "秒": 1, "hour": 3600, "hours": 3600, "小时": 3600, "day": 86400, "days": 86400, "天": 86400}


@operation("AddTimeDiffColumn")
def add_time_diff_column(t: Table, start: str, end: str, target: str, unit: str = "minutes") -> Table:
    """Whole seconds from start to end in the unit; minutes are the unit for any other name."""
    t.require(start, end)
    seconds = seconds_between(time(t.df, start), time(t.df, end))
    return t.with_column(fresh(t, target), seconds.cast("double") / float(UNITS.get(unit.strip().lower(), 60)))


@operation("ApplyMappings")
def apply_mappings(t: Table, mappings: list) -> Table:
    """Renames in turn; those of columns the table does not have are ignored."""
    for old, new in mappings:
        if old in t.columns:
            t = renamed(t, {old: filled(new, "the new name")})
    return t


def cast_to(t: Table, column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "boolean":
        return as_boolean(text_of(c))
    return time(t.df, column) if kind == "timestamp_ntz" else c.try_cast(kind)


@operation("CastColumn")
def cast_column(t: Table, column: str, target: str) -> Table:
    """The column in its new type; what does not fit is null."""
    t.require(column)
    kind = TYPES.get(target.strip().lower(), "string")
    out = t.with_column(column, cast_to(t, column, kind))
    return type(t)(out.df, out.order, {**t.labels, column: _LABELS[kind]})
