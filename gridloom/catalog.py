"""The registered queries on the test tables, each with its DuckDB equivalent where SQL can express it.

Missing values are made from keys by the same rule in both, as the tables have none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import charts, fusion, joins, profile
from .operators.registry import apply
from .plans.table import Table, shared_folder
from .plans.template import Template
from .sources import writers
from .sources.delimited import read_delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the tables that queries start from, as Spark and as SQL

def events(spark: SparkSession, sf_dir: str) -> Table:
    df = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("note"))
    return Table.of(df, "event_id")


EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 3 <> 0 THEN event_type END AS note FROM events)"


def orders(spark: SparkSession, sf_dir: str) -> Table:
    return Table.of(_read(spark, sf_dir, "orders"), "o_orderkey")


def customers(spark: SparkSession, sf_dir: str) -> Table:
    return Table.of(_read(spark, sf_dir, "customer"), "c_custkey")


def parts(spark: SparkSession, sf_dir: str) -> Table:
    return Table.of(_read(spark, sf_dir, "part"), "p_partkey")


def texts(spark: SparkSession, sf_dir: str) -> Table:
    """Events with times and numbers as text of several forms."""
    e, k = _read(spark, sf_dir, "events"), F.col("event_id") % 4
    at = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy/MM/dd HH:mm")).when(k == 2, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).otherwise("none")
    num = F.when(k == 0, F.concat(F.lit("1,"), (F.col("event_id") % 1000).cast("string"))).when(k == 1, F.concat(F.lit(" "), (F.col("event_id") % 50).cast("string"), F.lit(" "))).when(k == 2, F.lit("n/a")).otherwise((F.col("event_id") % 10).cast("string"))
    flag = F.when(k == 0, "Yes").when(k == 1, "off").when(k == 2, "是")
    return Table.of(e.select("event_id", at.alias("seen"), num.alias("num"), flag.alias("flag")), "event_id")


TEXTS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M') WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) ELSE 'none' END AS seen,
CASE event_id % 4 WHEN 0 THEN '1,' || (event_id % 1000) WHEN 1 THEN ' ' || (event_id % 50) || ' ' WHEN 2 THEN 'n/a' ELSE CAST(event_id % 10 AS VARCHAR) END AS num, CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '是' END AS flag,
CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) END AS parsed FROM events)"""


def op(name: str, source: Callable, operation: str, sql: str, /, **args) -> None:
    """Registers one operation on one table."""
    query(name, sql)(lambda spark, sf_dir: apply(source(spark, sf_dir), operation, **args).rows())


# --- flagship

_FLAG_SQL = "SELECT o_orderpriority, round(sum(o_totalprice), 4) AS sum_o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1"


@query("flagship", _FLAG_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = apply(orders(spark, sf_dir), "FilterRowsByTimeWindow", column="o_orderdate", start="1996-01-01", end="1997-12-31")
    return apply(t, "GroupAggregate", group_columns=["o_orderpriority"], target="o_totalprice", function="sum").rows()


# --- rows

op("reinspect", customers, "Reinspect", "SELECT * FROM customer")
query("drop_empty_rows", f"SELECT value, note FROM {EVENTS} WHERE NOT (value IS NULL AND coalesce(trim(note), '') = '')")(lambda s, d: apply(apply(events(s, d), "KeepColumns", columns=["value", "note"]), "DropEmptyRows").rows())
query("deduplicate_rows", "SELECT DISTINCT lang, source FROM documents")(lambda s, d: apply(Table.of(_read(s, d, "documents").select("lang", "source"), "lang", "source"), "DeduplicateRows").rows())
query("deduplicate_documents", "SELECT DISTINCT text, lang, source, n_chars FROM documents")(lambda s, d: apply(Table.of(_read(s, d, "documents"), "doc_id").select(["text", "lang", "source", "n_chars"]), "DeduplicateRows").rows())
op("filter_rows_contains", parts, "FilterRowsContains", "SELECT * FROM part WHERE contains(lower(p_type), 'a')", column="p_type", keyword=" A ")
op("drop_rows_not_contains", events, "DropRowsNotContains", f"SELECT * FROM {EVENTS} WHERE NOT coalesce(contains(lower(note), 'click'), false)", column="note", keyword="CLICK")
op("keep_row_range", orders, "KeepRowRange", "SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 101 AND 900", start=101, end=900)
op("drop_row_range", orders, "DropRowRange", "SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) NOT BETWEEN 101 AND 900", start=101, end=900)
op("keep_top_rows", orders, "KeepTopRows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 120", count=120)
op("sample_rows", orders, "SampleRows", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders), c AS (SELECT count(*) AS n FROM orders) SELECT * EXCLUDE (rn) FROM n WHERE rn IN (SELECT (i * (c.n - 1)) // 49 FROM range(50) t(i), c)", count=50)
op("keep_rows_with_missing", events, "KeepRowsWithMissing", f"SELECT * FROM {EVENTS} WHERE value IS NULL OR coalesce(trim(note), '') = ''", columns=["value", "note"])
op("drop_rows_with_missing", events, "DropRowsWithMissing", f"SELECT * FROM {EVENTS} WHERE value IS NOT NULL AND coalesce(trim(note), '') <> ''", columns=[])
op("deduplicate_by_columns", orders, "DeduplicateByColumns", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", columns=["o_custkey"])
op("filter_rows_by_time_window", texts, "FilterRowsByTimeWindow", f"SELECT event_id, seen, num, flag FROM {TEXTS} WHERE parsed BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'", column="seen", start="2024-01-05", end="2024/01/20 12:00")

# --- columns

query("normalize_column_names", "SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS name_2 FROM customer")(lambda s, d: apply(Table.of(_read(s, d, "customer").select(F.col("c_custkey").alias(" Customer\tKEY"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("name ")), " Customer\tKEY"), "NormalizeColumnNames").rows())
op("rename_column", customers, "RenameColumn", "SELECT * RENAME (c_name AS label) FROM customer", from_="c_name", to=" label ")
op("keep_columns", customers, "KeepColumns", "SELECT c_custkey, c_acctbal FROM customer", columns=["c_acctbal", "c_custkey", "none"])
op("drop_columns", customers, "DropColumns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer", columns=["c_acctbal", "c_name", "none"])
query("drop_empty_columns", "SELECT event_id, event_type FROM events")(lambda s, d: apply(Table.of(_read(s, d, "events").select("event_id", "event_type", F.lit(" ").alias("a"), F.lit(None).cast("double").alias("b")), "event_id"), "DropEmptyColumns").rows())
op("reorder_columns", customers, "ReorderColumns", "SELECT c_acctbal, c_name, c_custkey, c_nationkey, c_mktsegment FROM customer", columns=["c_acctbal", "c_name", "c_acctbal"])
op("add_column_name_affix", customers, "AddColumnNameAffix", "SELECT c_custkey AS x_c_custkey_y, c_name AS x_c_name_y, c_nationkey AS x_c_nationkey_y, c_acctbal AS x_c_acctbal_y, c_mktsegment AS x_c_mktsegment_y FROM customer", prefix="x_", suffix="_y")
op("duplicate_column", customers, "DuplicateColumn", "SELECT *, c_name AS again FROM customer", source="c_name", target="again")
op("merge_columns", events, "MergeColumns", f"SELECT *, CASE WHEN trim(note) <> '' THEN event_type || '-' || trim(note) ELSE event_type END AS both_ FROM {EVENTS}", columns=["event_type", "note"], target="both_", separator="-")
op("concat_columns", customers, "ConcatColumns", "SELECT *, trim(c_name) || '/' || trim(c_mktsegment) AS joined FROM customer", columns=["c_name", "c_mktsegment"], target="joined", separator="/")
op("add_row_number_column", orders, "AddRowNumberColumn", "SELECT *, row_number() OVER (ORDER BY o_orderkey) + 99 AS n FROM orders", column="n", start=100)
op("add_constant_column", customers, "AddConstantColumn", "SELECT *, 2.5 :: DOUBLE AS k FROM customer", target="k", value="2.5")
op("add_expression_column", events, "AddExpressionColumn", f"SELECT *, round(-(value + 2.0) * 3.0 / nullif(event_id - 5.0, 0), 6) AS x FROM {EVENTS}", target="x", expression="-({value} + 2) * 3 / ({event_id} - 5)")
op("add_conditional_column", events, "AddConditionalColumn", f"SELECT *, CASE WHEN coalesce(value >= 200, false) THEN 'high' ELSE 'low' END AS band FROM {EVENTS}", target="band", source="value", operator=">=", value="200", true_value="high", false_value="low")
query("add_conditional_not_equal", f"SELECT *, CASE WHEN coalesce(trim(note) = 'click', false) THEN 0 ELSE 1 END :: INTEGER AS other FROM {EVENTS}")(lambda s, d: apply(events(s, d), "AddConditionalColumn", target="other", source="note", operator="<>", value="click", true_value="1", false_value="0").rows())
_TESTS = (
    ("above", "value", ">", "250", "value > 250"), ("below", "value", "<", "100.5", "value < 100.5"), ("upto", "value", "<=", "250", "value <= 250"), ("since", "ts", ">=", "2024-01-15", "ts >= TIMESTAMP '2024-01-15'"),
    ("holds", "note", "包含", "ic", "contains(note, 'ic')"), ("after", "note", ">", "error", "trim(note) > 'error'"), ("blank", "note", "为空", "", "coalesce(trim(note), '') = ''"), ("same", "value", "==", "100", "value = 100"), ("odd", "value", "!=", "100", "value IS NULL OR value <> 100"),
)


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir)
    for name, column, operator, value, _ in _TESTS:
        t = apply(t, "AddConditionalColumn", target=name, source=column, operator=operator, value=value, true_value="in", false_value="out")
    return apply(t, "KeepColumns", columns=["event_id", *(x[0] for x in _TESTS)]).rows()


query("predicates", f"SELECT event_id, {', '.join(f"CASE WHEN coalesce({x[4]}, false) THEN 'in' ELSE 'out' END AS {x[0]}" for x in _TESTS)} FROM {EVENTS}")(_tested)
query("add_time_diff_column", "SELECT event_id, ts, later, date_diff('second', ts, later) / 3600.0 :: DOUBLE AS gap FROM (SELECT event_id, ts, ts + INTERVAL 90 MINUTE AS later FROM events)")(lambda s, d: apply(Table.of(_read(s, d, "events").select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL '90' MINUTE")).alias("later")), "event_id"), "AddTimeDiffColumn", start="ts", end="later", target="gap", unit="hours").rows())
op("apply_mappings", customers, "ApplyMappings", "SELECT * RENAME (c_name AS label, c_acctbal AS balance) FROM customer", mappings=[["c_name", "n"], ["n", "label"], ["none", "x"], ["c_acctbal", "balance"]])
op("cast_column", texts, "CastColumn", f"SELECT event_id, seen, CASE WHEN event_id % 4 IN (1, 3) THEN CAST(trim(num) AS BIGINT) END AS num, flag FROM {TEXTS}", column="num", target="整数")

# --- text

for _name, _op, _sql, _args in (
    ("trim_text_values", "TrimTextValues", f"SELECT event_id, seen, trim(num) AS num, flag FROM {TEXTS}", {}),
    ("squeeze_text_whitespace", "SqueezeTextWhitespace", f"SELECT event_id, seen, trim(num) AS num, flag FROM {TEXTS}", {"column": "num"}),
    ("keep_digits_only", "KeepDigitsOnly", f"SELECT event_id, seen, nullif(regexp_replace(num, '[^0-9]', '', 'g'), '') AS num, flag FROM {TEXTS}", {"column": "num"}),
):
    op(_name, texts, _op, _sql, **_args)
for _name, _op, _expr, _args in (
    ("transform_text_case", "TransformTextCase", "upper(c_name)", {"mode": "upper"}),
    ("replace_text", "ReplaceText", "replace(c_name, 'Customer', 'No.')", {"from_": "Customer", "to": "No."}),
    ("remove_text_pattern", "RemoveTextPattern", "replace(c_name, '#0', '')", {"pattern": "#0"}),
    ("extract_text_before", "ExtractTextBefore", "split_part(c_name, '#', 1)", {"delimiter": "#"}),
    ("extract_text_after", "ExtractTextAfter", "split_part(c_name, '#', 2)", {"delimiter": "#"}),
    ("add_text_affix", "AddTextAffix", "'<' || c_name || '>'", {"prefix": "<", "suffix": ">"}),
    ("truncate_text", "TruncateText", "substr(c_name, 1, 5)", {"max_chars": 5}),
):
    op(_name, customers, _op, f"SELECT * REPLACE ({_expr} AS c_name) FROM customer", column="c_name", **_args)

# --- numbers, types and times

for _name, _op, _expr, _args in (
    ("round_numeric", "RoundNumeric", "round(value, 1)", {"digits": 1}),
    ("scale_numeric", "ScaleNumeric", "value * 2.5 :: DOUBLE", {"factor": 2.5}),
    ("shift_numeric", "ShiftNumeric", "value + 10.0 :: DOUBLE", {"offset": 10}),
    ("clamp_numeric", "ClampNumeric", "CASE WHEN value IS NOT NULL THEN least(greatest(value, 50.0 :: DOUBLE), 300.0 :: DOUBLE) END", {"min": 50, "max": 300}),
):
    op(_name, events, _op, f"SELECT * REPLACE ({_expr} AS value) FROM {EVENTS}", column="value", **_args)
op("convert_string_to_numeric", texts, "ConvertStringToNumeric", f"SELECT event_id, seen, try_cast(replace(replace(num, ',', ''), ' ', '') AS DOUBLE) AS num, flag FROM {TEXTS}", column="num")
op("convert_string_to_date_time", texts, "ConvertStringToDateTime", f"SELECT event_id, parsed AS seen, num, flag FROM {TEXTS}", column="seen")
op("convert_integer_to_float", orders, "ConvertIntegerToFloat", "SELECT * REPLACE (CAST(o_custkey AS DOUBLE) AS o_custkey) FROM orders", column="o_custkey")
op("convert_to_boolean", texts, "ConvertToBoolean", f"SELECT event_id, seen, num, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM {TEXTS}", column="flag")
op("normalize_date_time_format", events, "NormalizeDateTimeFormat", f"SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM {EVENTS}", column="ts")
op("timestamp_to_date_time", texts, "TimestampToDateTime", f"SELECT event_id, CASE WHEN event_id % 4 = 2 THEN parsed END AS seen, num, flag FROM {TEXTS}", column="seen")
op("shift_date_time_by_minutes", events, "ShiftDateTimeByMinutes", f"SELECT * REPLACE (date_trunc('second', ts) - INTERVAL 45 MINUTE AS ts) FROM {EVENTS}", column="ts", minutes=-45)
op("split_date_time_parts", events, "SplitDateTimeParts", f"SELECT *, year(ts) AS t_year, month(ts) AS t_month, day(ts) AS t_day, hour(ts) AS t_hour FROM {EVENTS}", column="ts", prefix="t")
for _part, _expr in (("Date", "CAST(ts AS DATE)"), ("Year", "year(ts)"), ("Month", "month(ts)"), ("Day", "day(ts)"), ("Hour", "hour(ts)")):
    op(f"extract_{_part.lower()}_to_column", events, f"Extract{_part}ToColumn", f"SELECT *, {_expr} AS part FROM {EVENTS}", column="ts", target="part")

# --- missing values

op("fill_null_text", events, "FillNullText", f"SELECT * REPLACE (CASE WHEN coalesce(trim(note), '') = '' THEN 'none' ELSE note END AS note) FROM {EVENTS}", column="note", value="none")
op("fill_null_forward", events, "FillNullForward", f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value) FROM {EVENTS}", column="value")
op("fill_null_backward", events, "FillNullBackward", f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM {EVENTS}", column="value")
op("fill_null_mean", events, "FillNullStatistic", f"SELECT * REPLACE (round(coalesce(value, (SELECT avg(value) FROM {EVENTS})), 6) AS value) FROM {EVENTS}", column="value", strategy="mean")
QUERIES["fill_null_mean"] = lambda s, d: apply(apply(events(s, d), "FillNullStatistic", column="value", strategy="mean"), "RoundNumeric", column="value", digits=6).rows()
op("fill_null_median", events, "FillNullStatistic", f"SELECT * REPLACE (coalesce(value, (SELECT median(value) FROM {EVENTS})) AS value) FROM {EVENTS}", column="value", strategy="中位数")
op("fill_null_mode", events, "FillNullStatistic", f"SELECT * REPLACE (CASE WHEN coalesce(trim(note), '') = '' THEN (SELECT note FROM {EVENTS} WHERE trim(note) <> '' GROUP BY note ORDER BY count(*) DESC, note LIMIT 1) ELSE note END AS note) FROM {EVENTS}", column="note", strategy="mode")
op("empty_string_to_null", events, "EmptyStringToNull", f"SELECT * REPLACE (CASE WHEN trim(note) <> '' THEN note END AS note) FROM {EVENTS}", column="note")
query("zero_to_null", "SELECT event_id, nullif(event_id % 4, 0) AS k FROM events")(lambda s, d: apply(Table.of(_read(s, d, "events").select("event_id", (F.col("event_id") % 4).alias("k")), "event_id"), "ZeroToNull", column="k").rows())
op("replace_exact_value", events, "ReplaceExactValue", f"SELECT * REPLACE (CASE WHEN trim(note) = 'click' THEN 'tap' ELSE note END AS note) FROM {EVENTS}", column="note", from_=" click", to="tap")

# --- order

query("sort_by", f"SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS FIRST, event_id) AS n FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "SortBy", column="value", ascending=False), "AddRowNumberColumn", column="n"), "KeepColumns", columns=["event_id", "n"]).rows())
query("multi_sort", f"SELECT event_id, row_number() OVER (ORDER BY note NULLS LAST, value DESC NULLS FIRST, event_id) AS n FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "MultiSort", columns=["note", "value"], ascending=[True, False]), "AddRowNumberColumn", column="n"), "KeepColumns", columns=["event_id", "n"]).rows())
query("priority_sort", f"SELECT event_id, row_number() OVER (ORDER BY coalesce(trim(note) = 'view', false) DESC, value NULLS LAST, event_id) AS n FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "PrioritySort", column="note", operator="=", value="view", columns=["value"]), "AddRowNumberColumn", column="n"), "KeepColumns", columns=["event_id", "n"]).rows())
op("add_rank_column", events, "AddRankColumn", f"SELECT *, row_number() OVER (ORDER BY note NULLS LAST, value DESC NULLS FIRST, event_id) AS place FROM {EVENTS}", target="place", columns=["note", "value"], ascending=[True, False])
query("sort_by_date_time", f"SELECT event_id, row_number() OVER (ORDER BY parsed NULLS FIRST, event_id) AS n FROM {TEXTS}")(lambda s, d: apply(apply(apply(texts(s, d), "SortByDateTime", column="seen"), "AddRowNumberColumn", column="n"), "KeepColumns", columns=["event_id", "n"]).rows())
query("top_k_after_sort", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: apply(apply(orders(s, d), "SortBy", column="o_totalprice", ascending=False), "KeepTopRows", count=25).rows())

# --- aggregation and windows

for _f, _expr, _col in (("count", "count(*)", "count"), ("sum", "round(sum(l_extendedprice), 4)", "sum_l_extendedprice"), ("mean", "round(avg(l_extendedprice), 4)", "mean_l_extendedprice"), ("max", "max(l_extendedprice)", "max_l_extendedprice"), ("min", "min(l_extendedprice)", "min_l_extendedprice"), ("nunique", "count(DISTINCT l_extendedprice)", "nunique_l_extendedprice")):
    query(f"group_{_f}", f"SELECT l_returnflag, l_linestatus, {_expr} AS {_col} FROM lineitem GROUP BY 1, 2")(
        lambda s, d, f=_f: apply(Table(_read(s, d, "lineitem"), ()), "GroupAggregate", group_columns=["l_returnflag", "l_linestatus"], target="l_extendedprice", function=f).rows()
    )
query("group_max_as_text", "SELECT c_mktsegment, max(c_name) AS max_c_name FROM customer GROUP BY 1")(lambda s, d: apply(customers(s, d), "GroupAggregate", group_columns=["c_mktsegment"], target="c_name", function="max", compat=True).rows())
_ROLL = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
for _f, _expr in (("sum", f"round(sum(value) {_ROLL}, 4)"), ("mean", f"round(avg(value) {_ROLL}, 4)"), ("max", f"max(value) {_ROLL}"), ("count", f"count(*) {_ROLL}"), ("nunique", f"len(list_distinct(list(value) {_ROLL}))")):
    op(f"rolling_{_f}", events, "RollingAggregate", f"SELECT *, {_expr} AS rolled FROM {EVENTS}", group_columns=["user_id"], order_column="ts", target="value", window_size=5, function=_f, output="rolled")
op("rolling_sum_whole_table", events, "RollingAggregate", f"SELECT *, round(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS rolled FROM {EVENTS}", group_columns=[], order_column="ts", target="value", window_size=10, function="sum", output="rolled")
_LONG = "OVER (ORDER BY ts, event_id ROWS BETWEEN 9998 PRECEDING AND CURRENT ROW)"
for _f, _expr in (("sum", f"round(sum(value) {_LONG}, 4)"), ("max", f"max(value) {_LONG}"), ("min", f"min(value) {_LONG}"), ("count", f"count(*) {_LONG}"), ("nunique", f"count(DISTINCT note) {_LONG}")):
    _target, _source = ("note", "(SELECT * REPLACE (CASE WHEN trim(note) <> '' THEN note END AS note), note AS told FROM {})".format(EVENTS)) if _f == "nunique" else ("value", EVENTS)
    op(f"rolling_{_f}_of_9999", events, "RollingAggregate", f"SELECT * {'EXCLUDE (told) REPLACE (told AS note)' if _f == 'nunique' else ''}, {_expr} AS rolled FROM {_source}", group_columns=[], order_column="ts", target=_target, window_size=9999, function=_f, output="rolled")
# Values with more digits, whose means do not lie half-way between two results of rounding.
_ODD = f"(SELECT * REPLACE (value * 1.000123457 AS value) FROM {EVENTS})"
op("rolling_mean_of_9999", lambda s, d: events(s, d).with_column("value", F.col("value") * 1.000123457), "RollingAggregate", f"SELECT *, round(avg(value) {_LONG}, 4) AS rolled FROM {_ODD}", group_columns=[], order_column="ts", target="value", window_size=9999, function="mean", output="rolled")
op("moving_average", orders, "MovingAverage", "SELECT *, round(avg(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS smooth FROM orders", order_column="o_orderdate", target="o_totalprice", window_size=7, output="smooth")
query("cumulative_sum", f"SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "CumulativeSum", order_column="ts", target="value", output="total"), "RoundNumeric", column="total", digits=2), "KeepColumns", columns=["event_id", "total"]).rows())
query("cumulative_sum_by_user", f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "CumulativeSum", order_column="ts", target="value", output="total", group_columns=["user_id"]), "RoundNumeric", column="total", digits=2), "KeepColumns", columns=["event_id", "total"]).rows())
for _mode, _expr in (
    ("difference", "round(value - lag(value) OVER w, 6)"), ("rate", "round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 6)"),
    ("increase", "CASE WHEN row_number() OVER w > 1 THEN CASE WHEN value IS NULL THEN false WHEN lag(value) OVER w IS NULL THEN true ELSE value > lag(value) OVER w END END"),
    ("decrease", "CASE WHEN row_number() OVER w > 1 THEN CASE WHEN lag(value) OVER w IS NULL THEN false WHEN value IS NULL THEN true ELSE value < lag(value) OVER w END END"),
):
    def _compare(s, d, mode=_mode):
        t = apply(apply(events(s, d), "CompareAdjacent", order_column="ts", target="value", mode=mode, output="change", group_columns=["user_id"]), "KeepColumns", columns=["event_id", "change"])
        return (apply(t, "RoundNumeric", column="change", digits=6) if mode in ("difference", "rate") else t).rows()

    query(f"compare_adjacent_{_mode}", f"SELECT event_id, {_expr} AS change FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")(_compare)
query("compare_adjacent_whole_table", f"SELECT event_id, round(value - lag(value) OVER (ORDER BY ts, event_id), 6) AS change FROM {EVENTS}")(lambda s, d: apply(apply(apply(events(s, d), "CompareAdjacent", order_column="ts", target="value", mode="差值", output="change"), "RoundNumeric", column="change", digits=6), "KeepColumns", columns=["event_id", "change"]).rows())

# --- joins


def _sides(spark: SparkSession, sf_dir: str) -> tuple[Table, Table]:
    """Customers and orders, shifted so that both sides have rows without a partner."""
    left = Table.of(_read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_nationkey"), "c_custkey")
    right = Table.of(_read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 20).alias("o_custkey"), F.col("o_orderpriority").alias("name")), "o_orderkey")
    return left, right


_LEFT = "(SELECT c_custkey, c_name AS name, c_nationkey FROM customer)"
_RIGHT = "(SELECT o_orderkey, o_custkey + 20 AS o_custkey, o_orderpriority AS name FROM orders)"
_COUNTS = f"(SELECT count(*) FROM {_LEFT} l JOIN {_RIGHT} r ON l.c_custkey = r.o_custkey) AS matched_pairs, (SELECT count(*) FROM {_LEFT} l WHERE c_custkey NOT IN (SELECT o_custkey FROM {_RIGHT})) AS unmatched_left, (SELECT count(*) FROM {_RIGHT} r WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unmatched_right, 'name' AS conflict_fields"
for _kind, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("outer", "FULL JOIN")):
    query(f"join_{_kind}", f"SELECT l.c_custkey, l.name, l.c_nationkey, r.o_orderkey, r.name AS name_right FROM {_LEFT} l {_join} {_RIGHT} r ON l.c_custkey = r.o_custkey")(lambda s, d, k=_kind: joins.join_tables(*_sides(s, d), ["c_custkey"], ["o_custkey"], k).rows())
query("join_right_prefix", f"SELECT l.c_custkey, l.name, l.c_nationkey, r.o_orderkey, r.name AS right_name FROM {_LEFT} l JOIN {_RIGHT} r ON l.c_custkey = r.o_custkey")(lambda s, d: joins.join_tables(*_sides(s, d), ["c_custkey"], ["o_custkey"], "内连接", "right_prefix").rows())
query("join_keep_left_only", f"SELECT l.c_custkey, l.name, l.c_nationkey, r.o_orderkey FROM {_LEFT} l LEFT JOIN {_RIGHT} r ON l.c_custkey = r.o_custkey")(lambda s, d: joins.join_tables(*_sides(s, d), ["c_custkey"], ["o_custkey"], "left", "keep_left_only").rows())
query("join_report", f"SELECT {_COUNTS}")(lambda s, d: joins.join_report(*_sides(s, d), ["c_custkey"], ["o_custkey"]))
query("join_report_with_hint", f"SELECT *, '内连接丢弃了未匹配记录：左表 ' || unmatched_left || ' 条，右表 ' || unmatched_right || ' 条' AS data_loss_hint FROM (SELECT {_COUNTS})")(lambda s, d: joins.join_report(*_sides(s, d), ["c_custkey"], ["o_custkey"], "inner"))

# --- chart tables

query("chart_xy_points", "SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders")(lambda s, d: charts.xy_points(orders(s, d), "o_custkey", "o_totalprice"))
query("chart_category_totals", f"SELECT coalesce(nullif(trim(note), ''), '空值') AS label, round(coalesce(sum(value), 0), 4) AS total FROM {EVENTS} GROUP BY 1")(lambda s, d: charts.category_totals(events(s, d), "note", "value", True).withColumn("total", F.round("total", 4)))
query("chart_histogram", "WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 11) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 4) AS low, round(lo + (i + 1) * w, 4) AS high, coalesce(n, 0) AS count FROM range(12) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i")(lambda s, d: charts.histogram(orders(s, d), "o_totalprice").withColumns({c: F.round(c, 4) for c in ("low", "high")}))
query("chart_box_groups", "SELECT l_returnflag AS \"group\", count(*) AS count, min(l_quantity) AS minimum, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS maximum FROM lineitem GROUP BY 1")(lambda s, d: charts.box_groups(Table(_read(s, d, "lineitem"), ()), "l_quantity", "l_returnflag"))
query("chart_heatmap", f"SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(value, 0) AS value FROM {EVENTS} ORDER BY event_id LIMIT 80")(lambda s, d: charts.heatmap(events(s, d), ["event_id", "value"]))

# --- profiles and quality

_PROFILE = "SELECT '{c}' AS \"column\", count(*) AS rows, count({v}) AS non_blank, count(*) - count({v}) AS missing, round((count(*) - count({v})) / count(*), 6) AS missing_rate, count(DISTINCT {v}) AS \"distinct\", count(*) = count(DISTINCT {v}) AS key_candidate FROM " + EVENTS
query("profile_columns", " UNION ALL ".join(_PROFILE.format(c=c, v="nullif(trim(note), '')" if c == "note" else c) for c in ("event_id", "ts", "user_id", "event_type", "value", "note")))(lambda s, d: profile.profile_columns(events(s, d)).select("column", "rows", "non_blank", "missing", "missing_rate", "distinct", "key_candidate"))
query("profile_roles", f"""SELECT 'event_id' AS "column", false AS time_candidate, CASE WHEN count(*) = count(DISTINCT event_id) THEN '主键候选' ELSE '数值字段' END AS role FROM {EVENTS} UNION ALL
SELECT 'ts', true, CASE WHEN count(*) = count(DISTINCT ts) THEN '主键候选' ELSE '时间字段' END FROM {EVENTS} UNION ALL SELECT 'user_id', false, CASE WHEN count(*) = count(DISTINCT user_id) THEN '主键候选' ELSE '数值字段' END FROM {EVENTS} UNION ALL
SELECT 'event_type', false, '普通字段' UNION ALL SELECT 'value', false, '数值字段' UNION ALL SELECT 'note', false, '普通字段'""")(lambda s, d: profile.profile_columns(events(s, d)).select("column", "time_candidate", "role"))


def _dirty(spark: SparkSession, sf_dir: str) -> Table:
    """Rows without any cell, repeated and missing keys, numbers that are none, and times out of order."""
    e, some = _read(spark, sf_dir, "events"), F.col("event_id") % 11 != 0
    k = F.expr("CAST(event_id div 2 AS STRING)")
    num = F.when(F.col("event_id") % 4 == 2, "broken").when(F.col("event_id") % 4 == 3, " ").otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit(".5")))
    at = F.date_format(F.col("ts") - F.make_dt_interval((F.col("event_id") % 3).cast("int")), "yyyy-MM-dd HH:mm:ss")
    df = e.select("event_id", F.when(some, k).alias("code"), F.when(some, num).alias("num"), F.when(some, at).alias("seen_time"))
    t = Table.of(df, "event_id").select(["code", "num", "seen_time"])
    return Table(t.df, t.order, {"num": "float"})


_DIRTY = """(SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id // 2 AS VARCHAR) END AS code, CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 4 WHEN 2 THEN 'broken' WHEN 3 THEN ' ' ELSE (event_id % 50) || '.5' END END AS num,
CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts - to_days(CAST(event_id % 3 AS INTEGER))) END AS seen_time FROM events)"""
query("quality_issues_of_dirty_table", f"""WITH e AS (SELECT * FROM {_DIRTY}), m AS (SELECT count(*) AS n, (count(*) - count(nullif(trim(num), ''))) / count(*) AS rate FROM e)
SELECT '缺失字段' AS category, CASE WHEN rate >= 0.6 THEN '高' ELSE '中' END AS severity, 'num' AS field, CAST(round(rate * n) AS BIGINT) AS count FROM m WHERE rate >= 0.3 UNION ALL
SELECT '空记录', '中', '整表', count(*) FROM e WHERE code IS NULL UNION ALL SELECT '类型异常', '高', 'num', count(*) FROM e WHERE num = 'broken' UNION ALL SELECT '类型混杂', '高', 'num', 2 UNION ALL
SELECT '重复记录', '中', '整表', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM e GROUP BY code, trim(num), seen_time) UNION ALL
SELECT '主键规则', '高', 'code', count(*) FROM e WHERE code IS NULL UNION ALL SELECT '主键重复', '高', 'code', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM e WHERE code IS NOT NULL GROUP BY code) UNION ALL
SELECT '时间规则', '中', 'seen_time', count(*) FROM (SELECT seen_time < lag(seen_time) OVER (ORDER BY event_id) AS b FROM e WHERE seen_time IS NOT NULL) WHERE b""")(
    lambda s, d: profile.quality_issues(_dirty(s, d), profile.Rules(primary_key="code")).drop("detail")
)
query("quality_issue_details", f"SELECT '文本长度' AS category, '6/' || max(length(trim(note))) AS detail FROM {EVENTS} UNION ALL SELECT '缺失字段', printf('%.1f%%', 100.0 * count(*) FILTER (WHERE coalesce(trim(note), '') = '') / count(*)) FROM {EVENTS}")(
    lambda s, d: profile.quality_issues(events(s, d), profile.Rules(primary_key="event_id", time_column="ts", max_lengths=(("note", 6),))).filter(F.col("category").isin("文本长度", "缺失字段")).select("category", "detail")
)


query("preview_page", "SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 101 AND 150")(lambda s, d: profile.preview(orders(s, d), 3, 50))

# --- files: what is written is read back

_FILE = "SELECT event_id, user_id, value, CASE event_id % 5 WHEN 0 THEN 'say \"hi\", ok' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN event_type WHEN 3 THEN 'semi;colon' || chr(9) || 'tab' END AS note FROM events"


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    k = F.col("event_id") % 5
    note = F.when(k == 0, 'say "hi", ok').when(k == 1, "two\nlines").when(k == 2, F.col("event_type")).when(k == 3, "semi;colon\ttab")
    t = Table.of(_read(spark, sf_dir, "events").select("event_id", "user_id", "value", note.alias("note")), "event_id")
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}.{kind}"
    {"csv": writers.write_csv, "tsv": writers.write_tsv, "txt": writers.write_txt}[kind](t, path)
    return read_delimited(spark, path).rows()


for _kind in ("csv", "tsv", "txt"):
    query(f"{_kind}_written_and_read", _FILE)(lambda s, d, k=_kind: _round_trip(s, d, k))

query("duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")(lambda s, d: profile.duplicate_rows(orders(s, d), ["o_custkey", "o_orderstatus"]))
query("time_disorder", "SELECT count(*) AS disordered FROM (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS x FROM orders) WHERE x")(lambda s, d: profile.time_disorder(orders(s, d), "o_orderdate"))
query("time_gaps", "SELECT count(*) AS gaps, max(m) AS largest FROM (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) // 60000000 AS m FROM events) WHERE m > 5")(lambda s, d: profile.time_gaps(apply(events(s, d), "SortByDateTime", column="ts"), "ts", 5))
query("quality_issues", f"""WITH e AS (SELECT * FROM {EVENTS})
SELECT '缺失字段' AS category, '中' AS severity, 'note' AS field, count(*) AS count FROM e WHERE coalesce(trim(note), '') = '' UNION ALL
SELECT '范围规则', '高', 'value', count(*) FROM e WHERE value < 10 OR value > 450 UNION ALL SELECT '文本长度', '中', 'note', count(*) FROM e WHERE length(trim(note)) > 6 UNION ALL
SELECT '组合重复', '中', 'user_id,event_type', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM e GROUP BY user_id, event_type) UNION ALL
SELECT '时间规则', '中', 'ts', x FROM (SELECT count(*) AS x FROM (SELECT ts < lag(ts) OVER (ORDER BY event_id) AS b FROM e) WHERE b) WHERE x > 0 UNION ALL
SELECT '时间间隔', '中', 'ts', x FROM (SELECT count(*) AS x FROM (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY event_id), ts) // 60000000 AS m FROM e) WHERE m > 5) WHERE x > 0""")(
    lambda s, d: profile.quality_issues(events(s, d), profile.Rules(primary_key="event_id", composite_keys=("user_id", "event_type"), time_column="ts", max_gap_minutes=5, ranges=(("value", 10, 450),), max_lengths=(("note", 6),))).drop("detail")
)

# --- fusion

_PRIMARY = "(SELECT event_id, user_id, ts, value AS temp_degc FROM events WHERE event_type = 'view')"
_SECOND = "(SELECT event_id AS click_id, user_id, ts, value AS temp_degf, event_type AS mode FROM events WHERE event_type = 'click')"


def _fusion(spark: SparkSession, sf_dir: str, **options) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("temp_degc")), "event_id")
    q = Table.of(e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts", F.col("value").alias("temp_degf"), F.col("event_type").alias("mode")), "click_id")
    return fusion.fuse(fusion.Request(keys=("user_id",), time="ts", window_seconds=21600, clean_outliers=False, **options), ("views", p), [("clicks", q)])


_NEAREST = f"""(SELECT p.*, s.click_id, s.temp_degf, s.d FROM {_PRIMARY} p LEFT JOIN (
SELECT p.event_id AS pid, s.*, abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 AS d FROM {_PRIMARY} p JOIN {_SECOND} s USING (user_id) WHERE abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 <= 21600
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(date_diff('microsecond', p.ts, s.ts)) // 1000000, s.ts, s.click_id) = 1) s ON s.pid = p.event_id)"""
query("fusion_nearest", f"SELECT event_id, click_id, CASE WHEN d IS NULL THEN '辅源1: 未命中' ELSE '辅源1: 最近邻 ' || d || 's' END AS fusion_trace FROM {_NEAREST}")(lambda s, d: _fusion(s, d, mode="nearest").table.rows().select("event_id", "click_id", "fusion_trace"))
query("fusion_numeric_average", f"SELECT event_id, round(CASE WHEN d IS NULL THEN temp_degc ELSE (temp_degc + (temp_degf - 32) / 1.8) / 2 END, 4) AS temp_degc FROM {_NEAREST}")(lambda s, d: _fusion(s, d, mode="nearest", strategy="numeric_average", by_confidence=False).table.rows().select("event_id", F.round("temp_degc", 4).alias("temp_degc")))
query("fusion_window", f"SELECT p.event_id, CASE WHEN count(s.click_id) = 0 THEN '辅源1: 未命中' ELSE '辅源1: 时间窗聚合 ' || count(s.click_id) || ' 行' END AS fusion_trace, CAST(floor(round(avg(s.click_id), 6)) AS BIGINT) AS click_id FROM {_PRIMARY} p LEFT JOIN {_SECOND} s ON s.user_id = p.user_id AND abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 <= 21600 GROUP BY 1")(lambda s, d: _fusion(s, d, mode="window").table.rows().select("event_id", "fusion_trace", F.col("click_id").cast("long").alias("click_id")))
# Votes: each row of the window weighs 1 / (1 + its seconds) for its word; weights count to nine digits.
_VOTED = "(SELECT event_id AS log_id, user_id, ts, CASE event_id % 5 WHEN 0 THEN 'Running now' WHEN 1 THEN '停机' WHEN 2 THEN ' odd ' WHEN 3 THEN ' ' END AS machine_mode FROM events WHERE event_type <> 'view')"
_WORD = "CASE WHEN machine_mode = 'Running now' THEN 'RUN' WHEN machine_mode = '停机' THEN 'STOP' ELSE trim(machine_mode) END"
query("fusion_votes", f"SELECT p.event_id, CASE v.word WHEN 'odd' THEN 'ODD' ELSE v.word END AS machine_mode FROM {_PRIMARY} p LEFT JOIN (SELECT event_id, arg_max(word, (w, word)) AS word FROM (SELECT p.event_id, {_WORD} AS word, round(sum(1 / (1 + abs(date_diff('microsecond', p.ts, s.ts)) // 1000000)), 9) AS w FROM {_PRIMARY} p JOIN {_VOTED} s ON s.user_id = p.user_id AND abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 <= 86400 WHERE trim(machine_mode) <> '' GROUP BY ALL) GROUP BY 1) v USING (event_id)")(lambda s, d: _voted(s, d).table.rows().select("event_id", "machine_mode"))


def _voted(spark: SparkSession, sf_dir: str) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("temp_degc")), "event_id")
    k = F.col("event_id") % 5
    word = F.when(k == 0, "Running now").when(k == 1, "停机").when(k == 2, " odd ").when(k == 3, " ")
    q = Table.of(e.filter("event_type <> 'view'").select(F.col("event_id").alias("log_id"), "user_id", "ts", word.alias("machine_mode")), "log_id")
    return fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="window", window_seconds=86400, clean_outliers=False), ("views", p), [("modes", q)])


query("fusion_resample", f"SELECT p.event_id, arg_min(s.click_id, (abs(date_diff('microsecond', p.ts, s.ts)) // 1000000) * 10000000000 + epoch(s.ts)) AS click_id FROM {_PRIMARY} p LEFT JOIN {_SECOND} s ON s.user_id = p.user_id AND floor(epoch(p.ts) / 86400) = floor(epoch(s.ts) / 86400) GROUP BY 1")(lambda s, d: _fusion(s, d, mode="resample", resample_seconds=86400).table.rows().select("event_id", "click_id"))
query("fusion_exact", f"SELECT p.event_id, s.click_id FROM {_PRIMARY} p LEFT JOIN {_SECOND} s ON s.user_id = p.user_id AND s.ts = p.ts")(lambda s, d: _fusion(s, d, mode="exact").table.rows().select("event_id", "click_id"))
query("fusion_quality")(lambda s, d: _fusion(s, d, mode="exact_then_window", missing="linear").table.rows())
query("fusion_report", f"SELECT count(*) AS rows, count(d) AS matched_rows FROM {_NEAREST}")(lambda s, d: _fusion(s, d, mode="nearest").report.select("rows", "matched_rows"))
_GAP = "PARTITION BY user_id ORDER BY ts, event_id"

# Events of two in three ids, whatever their type, as second source: some primary rows have one of their very time.
_THIRDS = "(SELECT event_id AS log_id, user_id, ts, value * 1.8 + 40 AS temp_degf, CASE event_id % 4 WHEN 0 THEN 'Running' WHEN 1 THEN '停机' WHEN 2 THEN ' standby ' ELSE 'odd one' END AS run_status FROM events WHERE event_id % 3 <> 0)"
_SOME = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS temp_degc FROM events WHERE event_type = 'view')"


def _logs(spark: SparkSession, sf_dir: str, **options) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("temp_degc")), "event_id")
    k = F.col("event_id") % 4
    status = F.when(k == 0, "Running").when(k == 1, "停机").when(k == 2, " standby ").otherwise("odd one")
    q = Table.of(e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("log_id"), "user_id", "ts", (F.col("value") * 1.8 + 40).alias("temp_degf"), status.alias("run_status")), "log_id")
    return fusion.fuse(fusion.Request(**{"keys": ("user_id",), "time": "ts", "window_seconds": 21600, "clean_outliers": False} | options), ("views", p), [("logs", q)])


_PAIRS = f"(SELECT p.event_id AS pid, s.*, abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 AS d, p.ts = s.ts AS hit FROM {_SOME} p JOIN {_THIRDS} s USING (user_id) WHERE abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 <= 21600)"
_FOUND = f"(SELECT p.*, s.log_id, round((s.temp_degf - 32) / 1.8, 6) AS other, s.run_status, s.d, s.hit FROM {_SOME} p LEFT JOIN (SELECT * FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY NOT hit, d, ts, log_id) = 1) s ON s.pid = p.event_id)"
query("fusion_exact_then_nearest", f"SELECT event_id, log_id, CASE WHEN d IS NULL THEN '辅源1: 未命中' WHEN hit THEN '辅源1: 精确命中' ELSE '辅源1: 最近邻 ' || d || 's' END AS fusion_trace FROM {_FOUND}")(lambda s, d: _logs(s, d, mode="exact_then_nearest").table.rows().select("event_id", "log_id", "fusion_trace"))
query("fusion_exact_then_window", f"SELECT p.event_id, CASE WHEN count(s.pid) = 0 THEN '辅源1: 未命中' WHEN bool_or(s.hit) THEN '辅源1: 精确命中' ELSE '辅源1: 时间窗聚合 ' || count(s.pid) || ' 行' END AS fusion_trace FROM {_SOME} p LEFT JOIN {_PAIRS} s ON s.pid = p.event_id GROUP BY 1")(lambda s, d: _logs(s, d, mode="exact_then_window").table.rows().select("event_id", "fusion_trace"))
# How sure the second source is: 0.8 (a column of times, hardly a blank cell), less with the distance.
_WEIGHT = "CASE WHEN hit THEN 0.8 ELSE least(greatest(0.8 * (0.55 + 0.45 * (1 - least(d / 21600.0, 1.0))), 0.1), 1.0) END"
for _strategy, _expr in (
    ("secondary_first", "coalesce(other, temp_degc)"), ("complementary", "coalesce(temp_degc, other)"), ("keep_conflict", "coalesce(temp_degc, other)"), ("primary_first", "coalesce(temp_degc, other)"),
    ("confidence_weighted", f"CASE WHEN temp_degc IS NULL OR other IS NULL THEN coalesce(temp_degc, other) ELSE (temp_degc + other * w) / (1 + w) END"),
):
    query(f"fusion_{_strategy}", f"SELECT event_id, round({_expr} + 0.00037, 3) AS temp_degc FROM (SELECT *, {_WEIGHT} AS w FROM {_FOUND})")(
        lambda s, d, x=_strategy: _logs(s, d, mode="exact_then_nearest", strategy=x, by_confidence=False).table.rows().select("event_id", F.round(F.col("temp_degc") + 0.00037, 3).alias("temp_degc"))
    )
# Three sources in one order of key and time; the first fits by hours, the others by type.
_OF = "SELECT p.event_id, s.id FROM {p} p LEFT JOIN (SELECT p.event_id AS pid, s.event_id AS id FROM {p} p JOIN events s USING (user_id) WHERE s.event_type = '{t}' AND abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 <= 43200 QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(date_diff('microsecond', p.ts, s.ts)) // 1000000, s.ts, s.event_id) = 1) s ON s.pid = p.event_id"
_TYPES = ("click", "purchase", "error")
query("fusion_three_sources", f"SELECT event_id, a.id AS click_id, b.id AS purchase_id, c.id AS error_id, (a.id IS NOT NULL) :: INTEGER + (b.id IS NOT NULL) :: INTEGER + (c.id IS NOT NULL) :: INTEGER AS hits FROM ({_OF.format(p=_PRIMARY, t='click')}) a JOIN ({_OF.format(p=_PRIMARY, t='purchase')}) b USING (event_id) JOIN ({_OF.format(p=_PRIMARY, t='error')}) c USING (event_id)")(
    lambda s, d: _three(s, d).table.rows().select("event_id", "click_id", "purchase_id", "error_id", (3 - F.regexp_count("fusion_trace", F.lit("未命中"))).alias("hits"))
)


def _three(spark: SparkSession, sf_dir: str) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("temp_degc")), "event_id")
    others = [(f"{t}s", Table.of(e.filter(F.col("event_type") == t).select(F.col("event_id").alias(f"{t}_id"), "user_id", "ts"), f"{t}_id")) for t in _TYPES]
    return fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="nearest", window_seconds=43200, clean_outliers=False), ("views", p), others)


# A whole number stays one, beyond what a double holds.
_BIG = "9007199254740993"
query("fusion_whole_numbers", f"SELECT event_id, CASE WHEN d IS NULL THEN CASE WHEN event_id % 2 = 0 THEN {_BIG} + event_id END ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN {_BIG} + event_id END, {_BIG} + click_id) END AS count_total FROM {_NEAREST}")(lambda s, d: _whole(s, d).table.rows().select("event_id", "count_total"))


def _whole(spark: SparkSession, sf_dir: str) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    big = F.lit(int(_BIG))
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, big + F.col("event_id")).alias("count_total")), "event_id")
    q = Table.of(e.filter("event_type = 'click'").select(F.col("event_id").alias("click_no"), "user_id", "ts", (big + F.col("event_id")).alias("count_total")), "click_no")
    return fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="nearest", window_seconds=21600, clean_outliers=False, by_confidence=False), ("views", p), [("clicks", q)])


# Fusion as it is by default: outliers go, and every value is weighed by how sure its table, binding, distance and cell
# are. The numbers are the parts of those weights; bindings: click_id is a column of its own, temp_degf goes into temp_degc.
_SPIKES = "CASE WHEN event_id % {} = 0 THEN value * 40 ELSE value END"
_CLEAN_P = f"(SELECT * REPLACE (CASE WHEN an = 0 THEN v END AS v) FROM (SELECT *, coalesce(abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) > 3.5, false) :: INTEGER AS an FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 1 THEN {_SPIKES.format(50)} END AS v FROM events WHERE event_type = 'view')))"
_CLEAN_S = f"(SELECT * REPLACE (CASE WHEN an = 0 THEN f END AS f) FROM (SELECT *, (abs((f - avg(f) OVER ()) / stddev_pop(f) OVER ()) > 3.5) :: INTEGER AS an FROM (SELECT event_id AS click_id, user_id, ts, {_SPIKES.format(40)} * 1.8 + 40 AS f FROM events WHERE event_type = 'click')))"
_SURE = f"""WITH p AS MATERIALIZED {_CLEAN_P}, s AS MATERIALIZED {_CLEAN_S},
near AS (SELECT p.event_id, s.click_id, s.f, s.an AS san, abs(date_diff('microsecond', p.ts, s.ts)) // 1000000 AS d FROM p JOIN s USING (user_id) WHERE d <= 21600 QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY d, s.ts, s.click_id) = 1),
met AS (SELECT p.*, click_id, round(f * 5 / 9 - 160.0 / 9, 6) AS c, coalesce(san, 0) AS san, click_id IS NOT NULL AS there, 1 - d / 21600.0 AS near FROM p LEFT JOIN near USING (event_id)),
weighed AS (SELECT *, least(greatest((0.42 * 0.8 + 0.24 * 0.7705 + 0.18 * 0.775 + 0.16 * 0.745) * (0.55 + 0.45 * near), 0.1), 1) AS w FROM met),
each AS (SELECT *, 0.35 * w + 0.18 * 0.7705 + 0.05 * near + (0.18 + 0.14 + 0.1) * 0.55 + 0.05 AS w_click, 0.35 * w + 0.18 * 0.7705 + 0.05 * near + 0.18 * 0.991 + 0.14 + 0.1 * 0.94 + 0.05 * CASE WHEN c IS NULL THEN 0.35 ELSE 1 END AS w_c, 0.55 * 0.8 + 0.1 * (1 - 0.08 * an) + 0.1 AS base FROM weighed),
sure AS (SELECT *, CASE WHEN v IS NOT NULL THEN base + 0.25 WHEN there AND c IS NOT NULL THEN w_c ELSE 0 END AS w_v FROM each),
fields AS (SELECT *, (base + 0.25 * 0.92 + base + 0.25 + base + 0.25 * 0.85 + w_v + CASE WHEN there THEN w_click ELSE 0 END) / (3 + (w_v > 0) :: INTEGER + there :: INTEGER) AS conf, CASE WHEN NOT there THEN 2 WHEN c IS NULL THEN 1 ELSE 0 END AS missing, (there AND c IS NOT NULL) :: INTEGER AS unit, (san > 0) :: INTEGER AS odd FROM sure),
scored AS (SELECT event_id, coalesce(v, c) AS v, there, missing, an + san AS anomalies, conf, greatest(0, 100 - CASE WHEN there THEN 0 ELSE 34 END - 15 * missing - least(4 * (an + san), 24) - 2 * (unit + odd) - 18 * (1 - least(conf, 1))) AS score, CASE WHEN unit + odd = 0 THEN '保留空值' ELSE concat_ws(' | ', CASE WHEN unit = 1 THEN '单位换算' END, CASE WHEN odd = 1 THEN '异常值剔除' END) END AS fixes FROM fields)"""


def _sure(spark: SparkSession, sf_dir: str) -> fusion.Result:
    e = _read(spark, sf_dir, "events")
    spiked = lambda n: F.when(F.col("event_id") % n == 0, F.col("value") * 40).otherwise(F.col("value"))
    p = Table.of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 1, spiked(50)).alias("temp_degc")), "event_id")
    q = Table.of(e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts", (spiked(40) * 1.8 + 40).alias("temp_degf")), "click_id")
    return fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="nearest", window_seconds=21600), ("views", p), [("clicks", q)])


query("fusion_confidence", f"{_SURE} SELECT event_id, round(v + 0.00037, 3) AS temp_degc, round(round(score, 4) + 0.00037, 3) AS score, fixes AS fusion_corrections FROM scored")(
    lambda s, d: _sure(s, d).table.rows().select("event_id", F.round(F.col("temp_degc") + 0.00037, 3).alias("temp_degc"), F.round(F.col("fusion_quality_score") + 0.00037, 3).alias("score"), "fusion_corrections")
)
query("fusion_confidence_report", f"{_SURE} SELECT count(*) AS rows, count_if(there) AS matched_rows, round(round(avg(score), 4) + 0.00037, 3) AS average_quality, round(round(avg(conf), 4) + 0.00037, 3) AS average_confidence, sum(missing) :: BIGINT AS missing_fields, sum(anomalies) :: BIGINT AS anomaly_cells, 1 AS sources, '' AS skipped FROM scored")(
    lambda s, d: _sure(s, d).report.withColumns({c: F.round(F.col(c) + 0.00037, 3) for c in ("average_quality", "average_confidence")})
)
query("fusion_confidence_alerts", f"{_SURE} SELECT event_id, fixes AS fusion_corrections, CASE WHEN round(score, 4) < 52.5 THEN '高' ELSE '中' END AS severity FROM scored WHERE round(score, 4) < 70 OR fixes <> '保留空值'")(lambda s, d: fusion.alerts(_sure(s, d).table).select("event_id", "fusion_corrections", "severity"))
query("fusion_state_words", f"SELECT event_id, CASE run_status WHEN 'Running' THEN 'RUN' WHEN '停机' THEN 'STOP' WHEN ' standby ' THEN 'IDLE' WHEN 'odd one' THEN 'ODD ONE' END AS run_status FROM {_FOUND}")(lambda s, d: _logs(s, d, mode="exact_then_nearest").table.rows().select("event_id", "run_status"))
query("fusion_fill_backward", f"SELECT event_id, first_value(log_id IGNORE NULLS) OVER ({_GAP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS log_id FROM (SELECT * REPLACE (CASE WHEN hit THEN log_id END AS log_id) FROM {_FOUND})")(lambda s, d: _logs(s, d, mode="exact", missing="backward").table.rows().select("event_id", "log_id"))
query("fusion_outliers", "SELECT event_id, CASE WHEN NOT bad THEN v END AS v, CAST(bad AS INTEGER) AS anomalies FROM (SELECT event_id, v, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) > 3.5 AS bad FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 40 ELSE value END AS v FROM events))")(
    lambda s, d: fusion.prepared(Table.of(_read(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("label"), "ts", F.when(F.col("event_id") % 50 == 0, F.col("value") * 40).otherwise(F.col("value")).alias("v")), "event_id"), ["user_id"], "ts", fusion.Request(keys=("user_id",), time="ts")).select("event_id", "v", F.col("__an").alias("anomalies"))
)
query("fusion_packets", f"SELECT event_id FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY (value IS NOT NULL) :: INTEGER + (coalesce(trim(note), '') <> '') :: INTEGER DESC, event_id DESC) = 1")(
    lambda s, d: fusion.prepared(events(s, d).with_column("ts", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")), ["user_id"], "ts", fusion.Request(keys=("user_id",), time="ts", clean_outliers=False)).select("event_id")
)
_SCORE = f"(SELECT event_id, CASE WHEN d IS NULL THEN 36.0 ELSE 100 - 4 - 18 * (1 - (4 + 2 * least(greatest(0.8 * (0.55 + 0.45 * (1 - least(d / 21600.0, 1.0))), 0.1), 1.0)) / 6) END AS score FROM {_NEAREST})"
query("fusion_score", f"SELECT event_id, round(score, 4) AS fusion_quality_score FROM {_SCORE}")(lambda s, d: _fusion(s, d, mode="nearest", by_confidence=False).table.rows().select("event_id", "fusion_quality_score"))
query("fusion_score_alerts", f"SELECT event_id, CASE WHEN score < 52.5 THEN '高' ELSE '中' END AS severity FROM {_SCORE}")(lambda s, d: fusion.alerts(_fusion(s, d, mode="nearest", by_confidence=False).table).select("event_id", "severity"))
query("fusion_segments", f"SELECT user_id, segment, count(*) AS rows, string_agg(fusion_trace, ' | ' ORDER BY ts, event_id) FILTER (WHERE k <= 2) AS trace_excerpt FROM (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS k FROM (SELECT *, sum(new) OVER ({_GAP} ROWS UNBOUNDED PRECEDING) :: BIGINT AS segment FROM (SELECT *, CASE WHEN d IS NULL THEN '辅源1: 未命中' ELSE '辅源1: 最近邻 ' || d || 's' END AS fusion_trace, CASE WHEN coalesce(date_diff('microsecond', lag(ts) OVER ({_GAP}), ts) // 1000000 > 86400, true) THEN 1 ELSE 0 END AS new FROM {_NEAREST}))) GROUP BY 1, 2")(
    lambda s, d: fusion.event_segments(_fusion(s, d, mode="nearest").table, ["user_id"], "ts", 86400).select("user_id", "segment", "rows", "trace_excerpt")
)
query("fusion_fill_forward", f"SELECT event_id, last_value(click_id IGNORE NULLS) OVER ({_GAP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_id FROM {_NEAREST}")(lambda s, d: _fusion(s, d, mode="nearest", missing="forward").table.rows().select("event_id", "click_id"))


def _filled(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    t = events(spark, sf_dir)
    df = t.df.withColumns({"__key": F.col("user_id").cast("string"), "__ts": F.col("ts")})
    return fusion.filled_by_key(df, ["value"], how, ["__ts", "event_id"]).select("event_id", F.round(F.col("value") + 0.00037, 3).alias("value"))  # no ties, which engines round in different ways


_NEIGHBOURS = f"(SELECT *, last_value(value IGNORE NULLS) OVER b AS a, first_value(value IGNORE NULLS) OVER f AS z, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS ta, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS tz, n - last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS i FROM (SELECT *, row_number() OVER ({_GAP}) AS n FROM {EVENTS}) WINDOW b AS ({_GAP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS ({_GAP} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
query("fill_nearest_by_key", f"SELECT event_id, round(coalesce(value, a, z) + 0.00037, 3) AS value FROM {_NEIGHBOURS}")(lambda s, d: _filled(s, d, "nearest"))
query("fill_linear_by_key", f"SELECT event_id, round(coalesce(value, CASE WHEN date_diff('microsecond', ta, tz) // 1000000 <> 0 THEN round(a + (z - a) * (date_diff('microsecond', ta, ts) // 1000000) / (date_diff('microsecond', ta, tz) // 1000000), 6) END) + 0.00037, 3) AS value FROM {_NEIGHBOURS}")(lambda s, d: _filled(s, d, "linear"))
query("fill_window_mean_by_key", f"SELECT event_id, round(coalesce(value, round(z - (z - a) * pow(0.5, i), 6)) + 0.00037, 3) AS value FROM {_NEIGHBOURS}")(lambda s, d: _filled(s, d, "window_mean"))
query("feature_table", f"SELECT user_id, count(*) AS row_count, min(ts) AS start_time, max(ts) AS end_time, round(avg(value), 6) AS value_mean, max(value) AS value_max, min(value) AS value_min, arg_max(value, ts) FILTER (value IS NOT NULL) AS value_last, round(arg_max(value, ts) FILTER (value IS NOT NULL) - arg_min(value, ts) FILTER (value IS NOT NULL), 6) AS value_delta, CASE WHEN count(value) > 0 THEN round(100.0 * (1 - count(value) / count(*)), 6) END AS value_missing_rate FROM {EVENTS} GROUP BY 1")(lambda s, d: fusion.feature_table(apply(events(s, d), "KeepColumns", columns=["user_id", "ts", "value"]), ["user_id"], "ts"))
query("event_segments", f"SELECT user_id, segment, min(ts) AS start_time, max(ts) AS end_time, count(*) AS rows FROM (SELECT *, sum(new) OVER ({_GAP} ROWS UNBOUNDED PRECEDING) :: BIGINT AS segment FROM (SELECT *, CASE WHEN coalesce(date_diff('microsecond', lag(ts) OVER ({_GAP}), ts) // 1000000 > 21600, true) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2")(lambda s, d: fusion.event_segments(events(s, d), ["user_id"], "ts", 21600))
query("fusion_alerts")(lambda s, d: fusion.alerts(_fusion(s, d, mode="nearest").table))

# --- a pipeline of several steps, from JSON

_TEMPLATE = """{"dataset_name": "orders", "created_at": "2024-01-01 00:00:00", "operations": [
{"FilterRowsByTimeWindow": {"column": "o_orderdate", "start": "1996-01-01", "end": "1998-12-31"}}, {"AddExpressionColumn": {"target": "net", "expression": "{o_totalprice} * 0.9"}},
{"SortBy": {"column": "net", "ascending": false}}, {"KeepTopRows": {"count": 500}}, {"RenameColumn": {"from": "o_orderpriority", "to": "priority"}}, {"GroupAggregate": {"group_columns": ["priority"], "target": "net", "function": "mean"}}]}"""
query("template_replay", "SELECT o_orderpriority AS priority, round(avg(net), 4) AS mean_net FROM (SELECT *, round(o_totalprice * 0.9, 6) AS net FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' ORDER BY net DESC, o_orderkey LIMIT 500) GROUP BY 1")(lambda s, d: Template.from_json(_TEMPLATE).replay(orders(s, d)).rows())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
