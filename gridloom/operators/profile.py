"""Profiles of columns and quality checks."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce
from math import gcd
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.parsing import LENIENT, STRICT, as_boolean, as_number, as_plain_time, blank, is_text, is_time, number, text_of, time, trimmed
from ..plans.selection import POSITIONS, row_range, rows_at
from ..plans.table import Table, in_blocks
from .rows import key

# Other names of well-known columns, by their canonical name.
ALIASES = {
    "timestamp": ("time", "时间", "日期", "datetime", "ts"),
    "device_id": ("device", "dev_id", "设备编号", "设备id", "id"),
    "temperature": ("temp", "温度", "temp_c", "temperature_c"),
    "pressure": ("press", "压力"),
    "status": ("state", "状态", "result_status"),
    "batch_id": ("batch", "批次", "batch_no"),
}


@dataclass(frozen=True)
class Rules:
    """What a table is checked against. Shares and limits outside their range are refused."""

    primary_key: str | None = None
    composite_keys: tuple[str, ...] = ()
    time_column: str | None = None
    missing_threshold: float = 0.3
    max_gap_minutes: int | None = None
    ranges: tuple[tuple[str, float | None, float | None], ...] = ()
    max_lengths: tuple[tuple[str, int], ...] = ()

    def checked(self, columns: list[str]) -> Rules:
        named = [c for c in (self.primary_key, self.time_column, *self.composite_keys, *(r[0] for r in self.ranges), *(m[0] for m in self.max_lengths)) if c]
        if missing := [c for c in named if c not in columns]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        if len(self.composite_keys) == 1:
            raise ValueError("a composite key needs two columns or more")
        if not 0.05 <= self.missing_threshold <= 0.95:
            raise ValueError("the missing threshold must be from 0.05 to 0.95")
        if any(lo is not None and hi is not None and lo > hi for _, lo, hi in self.ranges):
            raise ValueError("a range needs a minimum not above its maximum")
        if self.max_gap_minutes is not None and self.max_gap_minutes <= 0 or any(n <= 0 for _, n in self.max_lengths):
            raise ValueError("limits must be above 0")
        return self


def kind_of(df: DataFrame, name: str) -> str:
    d = df.schema[name].dataType
    if isinstance(d, T.IntegralType):
        return "integer"
    if isinstance(d, T.NumericType):
        return "float"
    return "boolean" if isinstance(d, T.BooleanType) else "datetime" if is_time(df, name) else "text"


def profile_columns(t: Table, rules: Rules = Rules()) -> DataFrame:
    """One row per column of a table with rows: column, kind, rows, non_blank, missing, missing_rate, distinct, sample (the
    first value), key_candidate, time_candidate, role.

    Cells are turned to (column, digest of 128 bits) and counted before they move, so the shuffle does not grow with the
    length of texts; samples come from a pass that moves one row for each task."""
    rules = rules.checked(t.columns)
    order = F.struct(*(F.col(k.name) for k in t.order))
    cell = {c: F.when(~blank(t.df, c), trimmed(F.col(c)) if is_text(t.df, c) else text_of(F.col(c))) for c in t.columns}

    def may_be_time(c: str) -> Column:
        """Of numbers only whole ones of eight digits are read as times; that columns of times are is known."""
        return {"text": F.lit(True), "integer": F.length(cell[c]) == 8}.get(kind_of(t.df, c), F.lit(c in t.labels and is_time(t.df, c)))

    cells = t.df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v"), may_be_time(c).alias("may")) for i, (c, v) in enumerate(cell.items())))))
    v, some = F.col("v"), F.col("a").isNotNull()
    digest = (F.when(v.isNotNull(), F.xxhash64(v)).alias("a"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), v, "i")).alias("b"))
    cells = cells.select("i", *digest, F.when(F.col("may"), as_plain_time(v)).isNotNull().cast("int").alias("looks"))
    per = cells.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("looks").alias("looks"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    p = per.groupBy("i").agg(F.sum("n").alias("rows"), total(F.when(some, F.col("n"))).alias("non_blank"), F.count("a").alias("distinct"), total(F.col("n") * F.col("looks")).alias("times"))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v"))))["v"]
    samples = t.df.agg(F.array(*(F.struct(F.lit(i).alias("i"), first(c).alias("sample")) for i, c in enumerate(cell.values()))).alias("x")).select(F.inline("x"))
    p = p.join(samples, "i")  # a row for each column on both sides
    names = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t.labels.get(c, kind_of(t.df, c))).alias("kind")) for c in t.columns))
    p = p.withColumn("x", F.element_at(names, F.col("i") + 1)).withColumn("column", F.col("x.column")).withColumn("kind", F.col("x.kind"))
    p = p.withColumn("missing", F.col("rows") - F.col("non_blank")).withColumn("missing_rate", F.round(F.col("missing") / F.col("rows"), 6))
    p = p.withColumn("key_candidate", (F.col("rows") > 0) & (F.col("missing") == 0) & (F.col("distinct") == F.col("rows")))
    named = F.lower("column").contains("time") | F.lower("column").contains("date")
    p = p.withColumn("time_candidate", (F.col("kind") == "datetime") | named | ((F.col("non_blank") > 0) & (F.col("times") >= 0.7 * F.col("non_blank"))))
    c = F.col("column")
    role = (
        F.when(c == F.lit(rules.primary_key or ""), "主键").when(c.isin(*rules.composite_keys) if rules.composite_keys else F.lit(False), "组合键")
        .when(c == F.lit(rules.time_column or ""), "时间序列").when(F.col("key_candidate"), "主键候选").when(F.col("time_candidate"), "时间字段")
        .when(F.col("kind").isin("integer", "float"), "数值字段").otherwise("普通字段")
    )
    return p.select("column", "kind", "rows", "non_blank", "missing", "missing_rate", "distinct", "sample", "key_candidate", "time_candidate", role.alias("role"))


def _cell_kind(df: DataFrame, name: str) -> Column:
    if not is_text(df, name):
        return F.when(F.col(name).isNotNull(), {"integer": "数值", "float": "数值", "boolean": "布尔", "datetime": "时间"}.get(kind_of(df, name), "文本"))
    t = F.col(name)
    found = F.when(as_number(t, LENIENT).isNotNull(), "数值").when(as_boolean(t, False).isNotNull(), "布尔").when(as_plain_time(t).isNotNull(), "时间").otherwise("文本")
    return F.when(~blank(df, name), found)


def row_keys(t: Table, names: list[str]) -> list[Column]:
    """By which rows are alike: texts trimmed, null as the empty text."""
    return [F.coalesce(trimmed(F.col(c)), F.lit("")).alias(c) if is_text(t.df, c) else key(t, c).alias(c) for c in names]


def duplicate_rows(t: Table, columns: list[str] | None = None, skip_blank: bool = False) -> DataFrame:
    """One row: duplicates, how many rows repeat one before; with skip_blank, among rows without a blank key only."""
    names = columns or t.columns
    rows = t.df.filter(~reduce(or_, (blank(t.df, c) for c in names))) if skip_blank else t.df
    return rows.groupBy(*row_keys(t, names)).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))


def time_steps(t: Table, column: str) -> DataFrame:
    """at and before: each row's time and that of the row before, in the table's order, without rows that have none."""
    at = time(t.df, column, as_plain_time)
    rows = t.with_df(t.df.select(at.alias("__at"), *(k.name for k in t.order)).filter(F.col("__at").isNotNull())).numbered()
    w = Window.partitionBy("__block").orderBy("__pos")
    return in_blocks(rows, 1).withColumn("before", F.lag("__at").over(w)).filter(~F.col("__copy")).select(F.col("__at").alias("at"), "before")


def time_disorder(t: Table, column: str) -> DataFrame:
    return time_steps(t, column).agg(F.count_if(F.col("at") < F.col("before")).alias("disordered"))


def time_gaps(t: Table, column: str, max_minutes: int) -> DataFrame:
    minutes = F.timestamp_diff("MINUTE", F.col("before"), F.col("at"))
    return time_steps(t, column).agg(F.count_if(minutes > max_minutes).alias("gaps"), F.max(F.when(minutes > max_minutes, minutes)).alias("largest"))


def resolved(t: Table, rules: Rules, profile: list) -> tuple[str | None, str | None]:
    """Primary key and time column: the configured ones, else the first candidates."""
    by = {r["column"]: r for r in profile}
    pk = rules.primary_key or next((c for c in t.columns if c in by and by[c]["key_candidate"]), None)
    return pk, rules.time_column or next((c for c in t.columns if c in by and by[c]["time_candidate"]), None)


ISSUES = "category string, severity string, field string, count long, detail string"
COUNTERS = {
    "缺失字段": "high_missing_field_count", "类型异常": "numeric_invalid_column_count", "类型混杂": "mixed_type_column_count", "空记录": "fully_empty_row_count",
    "重复记录": "duplicate_row_count", "主键规则": "primary_key_empty_count", "主键重复": "primary_key_duplicate_count", "组合重复": "composite_duplicate_count",
    "时间规则": "time_order_issue_count", "时间间隔": "time_gap_issue_count", "范围规则": "range_rule_issue_count", "文本长度": "text_length_issue_count",
}


def quality_issues(t: Table, rules: Rules = Rules()) -> DataFrame:
    """category, severity, field, count, detail of what the checks find: a share, the kinds of cells, the longest gap
    in minutes, or the allowed and the longest length. All counts per cell come from one pass."""
    rules = rules.checked(t.columns)
    spark, df = t.df.sparkSession, t.df
    profile = profile_columns(t, rules).collect()  # one row per column
    pk, when = resolved(t, rules, profile)
    by = {r["column"]: r for r in profile}
    found: list[tuple] = []
    for c in t.columns:
        if c in by and by[c]["missing_rate"] >= rules.missing_threshold:
            found.append(("缺失字段", "高" if by[c]["missing_rate"] >= 0.6 else "中", c, by[c]["missing"], f"{by[c]['missing_rate']:.1%}"))
    labelled = {c: t.labels.get(c, kind_of(df, c)) for c in t.columns}
    checks: dict[tuple, Column] = {("空记录", "中", "整表"): F.count_if(reduce(and_, (blank(df, c) for c in t.columns)))}
    details: dict[tuple, Column] = {}
    for c in t.columns:
        if labelled[c] in ("integer", "float") and is_text(df, c):
            checks["类型异常", "高", c] = F.count_if(~blank(df, c) & number(df, c, LENIENT).isNull())
    if pk:
        checks["主键规则", "高", pk] = F.count_if(blank(df, pk))
    for c, low, high in rules.ranges:
        x = number(df, c, STRICT)
        outside = reduce(or_, [x < F.lit(float(low))] * (low is not None) + [x > F.lit(float(high))] * (high is not None) or [F.lit(False)])
        checks["范围规则", "高", c] = F.count_if(outside)
    for c, most in rules.max_lengths:
        length = F.length(trimmed(text_of(F.col(c))))
        checks["文本长度", "中", c] = F.count_if(length > most)
        details["文本长度", "中", c] = F.concat(F.lit(f"{most}/"), F.max(length).cast("string"))
    kinds = {c: F.collect_set(_cell_kind(df, c)) for c in t.columns if is_text(df, c)}  # four values at most
    row = df.agg(
        *(v.alias(f"a{i}") for i, v in enumerate(checks.values())), *(v.alias(f"k{i}") for i, v in enumerate(kinds.values())), *(details[k].alias(f"d{i}") for i, k in enumerate(checks) if k in details)
    ).first()
    found += [(*k, row[f"a{i}"], row[f"d{i}"] if k in details else "") for i, k in enumerate(checks) if row[f"a{i}"]]
    found += [("类型混杂", "高" if labelled[c] in ("integer", "float") else "中", c, len(row[f"k{i}"]), "/".join(sorted(row[f"k{i}"]))) for i, c in enumerate(kinds) if len(row[f"k{i}"]) > 1]

    def one(category: str, severity: str, name: str, result: DataFrame) -> None:
        n = result.first()[0]
        if n:
            found.append((category, severity, name, n, ""))

    if not any(r["key_candidate"] for r in profile):  # a column that tells all rows apart leaves none that repeat
        one("重复记录", "中", "整表", duplicate_rows(t))
    if pk and (again := by[pk]["non_blank"] - by[pk]["distinct"]):  # the profile has counted its values
        found.append(("主键重复", "高", pk, again, ""))
    if len(rules.composite_keys) > 1:
        one("组合重复", "中", ",".join(rules.composite_keys), duplicate_rows(t, list(rules.composite_keys), True))
    if when:  # both checks from one pass over the steps
        minutes = F.timestamp_diff("MINUTE", F.col("before"), F.col("at"))
        far = minutes > (rules.max_gap_minutes or 2**31)
        steps = time_steps(t, when).agg(F.count_if(F.col("at") < F.col("before")), F.count_if(far), F.max(F.when(far, minutes))).first()
        found += [("时间规则", "中", when, steps[0], "")] * bool(steps[0]) + [("时间间隔", "中", when, steps[1], f"{steps[2]}")] * bool(steps[1])
    return spark.createDataFrame([(a, b, c, int(n), d) for a, b, c, n, d in found], ISSUES)


def overview(issues: DataFrame) -> DataFrame:
    """One row with a counter for each category: columns for the three that name columns, else rows."""
    by_column = {"缺失字段", "类型异常", "类型混杂"}
    return issues.agg(*(F.coalesce(F.sum(F.when(F.col("category") == k, F.lit(1) if k in by_column else F.col("count"))), F.lit(0)).cast("bigint").alias(v) for k, v in COUNTERS.items()))


def canonical(name: str) -> str | None:
    """The well-known column that a name stands for."""
    n = name.strip().lower().replace(" ", "_").replace("-", "_")
    return next((k for k, names in ALIASES.items() if n == k or n in names), None)


def mapping_suggestions(columns: list[str]) -> list[tuple[str, str]]:
    """Columns whose name stands for a canonical one, other than itself."""
    return [(c, canonical(c)) for c in columns if canonical(c) not in (None, c)]


def join_suggestions(left: list[str], right: list[str]) -> list[tuple[str, str, str]]:
    """(left, right, kind) of columns that have the same name or stand for the same canonical one; eight at most. Names
    of ids and codes suggest a left join."""
    same = lambda a, b: a == b or canonical(a) is not None and canonical(a) == canonical(b)
    return [(a, b, "left" if a.endswith("id") or "code" in a else "inner") for a in left for b in right if same(a, b)][:8]


def shuffled_places(rows: int, page: int, size: int) -> list[int]:
    """Places from 0 of the rows on a shuffled page, counted from 1. The number of rows decides the first place and a
    step that shares no factor with it, the page where on that walk it begins: pages are the same each time, and
    together show every row once."""
    first, start = (zlib.crc32(f"{rows}/{what}".encode()) for what in ("step", "start"))
    step = next(s for k in range(rows + 1) if gcd(s := (first + k) % rows or 1, rows) == 1) if rows else 1
    return [(start + k * step) % rows for k in range((page - 1) * size, min(page * size, rows))]


def preview(t: Table, page: int, size: int, shuffled: bool = False) -> DataFrame:
    """A page of rows, counted from 1; pages beyond the last are the last. Shuffled pages take rows from all over the
    table."""
    n, size = t.df.count(), max(size, 1)
    page = min(max(page, 1), max(1, -(-n // size)))
    start, end = (page - 1) * size + 1, min(page * size, n)
    if not shuffled:
        return row_range(t, start, end).ordered() if n else t.ordered()
    at = [k + 1 for k in shuffled_places(n, page, size)]
    rows = rows_at(t, at, n) if at and size <= POSITIONS else None
    if rows is None:
        wanted = t.df.sparkSession.createDataFrame(list(enumerate(at)), "__place long, __pos long")
        rows = t.numbered().join(F.broadcast(wanted), "__pos")  # a page of rows
    return rows.orderBy("__place").select(*t.columns)
