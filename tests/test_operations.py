from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.functions.arithmetic import arithmetic
from gridloom.operators.joins import join_report, join_tables
from gridloom.operators.registry import OPERATIONS, apply
from gridloom.plans.session import Session
from gridloom.plans.table import Table
from gridloom.plans.template import Template


def table(spark, rows, schema, key=None):
    df = spark.createDataFrame(rows, schema)
    return Table.of(df, key or df.columns[0])


def column(t, name):
    return [r[name] for r in t.ordered().collect()]


@pytest.fixture
def gaps(spark):
    rows = [(i, "ab"[i % 2], None if i in (0, 3, 4, 9) else float(i), "" if i == 5 else None if i == 6 else f" t{i % 3} ") for i in range(10)]
    return table(spark, rows, "id long, g string, v double, s string")


def test_there_are_74_operations():
    assert len(OPERATIONS) == 74


def test_fills(gaps):
    assert column(apply(gaps, "FillNullForward", column="v"), "v") == [None, 1, 2, 2, 2, 5, 6, 7, 8, 8]
    assert column(apply(gaps, "FillNullBackward", column="v"), "v") == [1, 1, 2, 5, 5, 5, 6, 7, 8, None]
    assert column(apply(gaps, "FillNullForward", column="s"), "s")[4:7] == [" t1 ", " t1 ", " t1 "]
    assert column(apply(gaps, "FillNullStatistic", column="v", strategy="median"), "v")[0] == 5.5
    assert column(apply(gaps, "FillNullText", column="s", value="x"), "s")[5:7] == ["x", "x"]
    assert column(apply(gaps, "EmptyStringToNull", column="s"), "s")[5] is None


def test_mode_takes_the_least_of_several(spark):
    t = table(spark, [(1, "b"), (2, "b"), (3, "a"), (4, "a"), (5, None)], "id long, x string")
    assert column(apply(t, "FillNullStatistic", column="x", strategy="众数"), "x")[-1] == "a"
    with pytest.raises(ValueError):
        apply(table(spark, [(1, None)], "id long, x double"), "FillNullStatistic", column="x")


def test_orders_and_ranks(spark):
    t = table(spark, [(1, 5, "b"), (2, None, "a"), (3, 1, None), (4, 5, "a")], "id long, v long, s string")
    ids = lambda x: column(x, "id")
    assert ids(apply(t, "SortBy", column="v")) == [3, 1, 4, 2]
    assert ids(apply(t, "SortBy", column="v", ascending=False)) == [2, 1, 4, 3]
    assert ids(apply(t, "MultiSort", columns=["v", "s"], ascending=[False])) == [2, 4, 1, 3]
    assert ids(apply(t, "PrioritySort", column="s", operator="=", value="a", placement="优先置后")) == [1, 3, 2, 4]
    ranked = apply(t, "AddRankColumn", target="r", columns=["v"])
    assert ids(ranked) == [1, 2, 3, 4] and column(ranked, "r") == [2, 4, 1, 3]
    assert ids(apply(apply(t, "SortBy", column="s"), "SortBy", column="v")) == [3, 4, 1, 2]  # stable


def test_times(spark):
    rows = [(1, "2024-1-5 3:04:05"), (2, "2024/01/05"), (3, "20240105"), (4, "2024-01-05T10:00:00+08:00"), (5, "1704423845"), (6, "1704423845123"), (7, "1704423845123456789"), (8, "soon"), (9, None)]
    t = table(spark, rows, "id long, at string")
    want = [datetime(2024, 1, 5, 3, 4, 5), datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 3, 4, 5)] + [datetime(2024, 1, 5, 3, 4, 5)] * 2 + [None, None]
    assert column(apply(t, "ConvertStringToDateTime", column="at"), "at") == want
    assert column(apply(t, "TimestampToDateTime", column="at"), "at")[:5] == [None, None, datetime(1970, 8, 23, 6, 15, 5), None, want[4]]
    assert column(apply(t, "ExtractDateToColumn", column="at", target="d"), "d")[0] == date(2024, 1, 5)
    assert column(apply(t, "SortByDateTime", column="at"), "id")[:2] == [8, 9]
    with pytest.raises(ValueError):
        apply(t, "FilterRowsByTimeWindow", column="at", start="2024-02-01", end="2024-01-01")


def test_numbers(spark):
    t = table(spark, [(1, "1,234"), (2, " 5 "), (3, "abc"), (4, "1d"), (5, "1e2"), (6, None), (7, "１，000")], "id long, x string")
    assert column(apply(t, "ConvertStringToNumeric", column="x"), "x")[:6] == [1234.0, 5.0, None, None, 100.0, None]
    assert column(apply(t, "ScaleNumeric", column="x", factor=2), "x")[:6] == [None, 10.0, None, None, 200.0, None]
    with pytest.raises(ValueError):
        apply(t, "ClampNumeric", column="x", min=2, max=1)


def test_text(spark):
    t = table(spark, [(1, " a-b-c "), (2, "plain"), (3, "　\t"), (4, None)], "id long, s string")
    of = lambda op, **a: column(apply(t, op, column="s", **a), "s")
    assert of("ExtractTextBefore", delimiter="-") == ["a", "plain", None, None]
    assert of("ExtractTextAfter", delimiter="-") == ["b-c", "plain", None, None]
    assert column(apply(t, "TrimTextValues"), "s") == ["a-b-c", "plain", None, None]
    assert of("TruncateText", max_chars=2) == [" a", "pl", "　\t", None]
    assert of("AddTextAffix", prefix="(") == ["( a-b-c ", "(plain", "(　\t", None]


def test_comparisons(spark):
    rows = [(1, None), (2, ""), (3, "10"), (4, "9"), (5, "2024-01-01"), (6, "abc")]
    t = table(spark, rows, "id long, x string")

    def hits(op, value):
        return [i for i, f in zip(column(t, "id"), column(apply(t, "AddConditionalColumn", target="f", source="x", operator=op, value=value, true_value="1", false_value="0"), "f"), strict=True) if f]

    assert hits(">", "9.5") == [3, 6] and hits("<", "9.5") == [2, 4, 5]
    assert hits("=", "10.0") == [3] and hits("!=", "10.0") == [1, 2, 4, 5, 6]
    assert hits("=", "2024/1/1") == [5] and hits("contains", "b") == [6] and hits("contains", "B") == []
    assert hits("为空", "") == [1, 2]


def test_arithmetic(spark):
    t = table(spark, [(1, "6", 0.0), (2, None, 2.0)], "id long, a string, b double")
    value = lambda e: [r[0] for r in t.df.select(arithmetic(t.df, e)).collect()]
    assert value("{a} / {b}") == [None, None] and value("-({a} + 2) * 3 - 1 / 4") == [-24.25, None] and value("{b}") == [0.0, 2.0]
    for bad in ("{c} + 1", "__import__('os')", "{a} ** 2", "1 +", "", "f(1)", "+{a}", "1 // 2"):
        with pytest.raises(ValueError):
            arithmetic(t.df, bad)


def test_windows_over_the_whole_table(spark):
    t = table(spark, [(i, i * 7 % 10, float(i)) for i in range(300)], "id long, o long, v double")
    from gridloom.plans import table as plans

    small = plans.in_blocks.__defaults__
    plans.in_blocks.__defaults__ = (7,)
    try:
        got = column(apply(t, "RollingAggregate", group_columns=[], order_column="id", target="v", window_size=4, function="sum", output="r"), "r")
        change = column(apply(t, "CompareAdjacent", order_column="id", target="v", mode="rate", output="r"), "r")
    finally:
        plans.in_blocks.__defaults__ = small
    assert got == [float(sum(range(max(0, i - 3), i + 1))) for i in range(300)]
    assert change[:3] == [None, None, 1.0]
    assert column(apply(t, "CumulativeSum", order_column="id", target="v", output="c"), "c") == [i * (i + 1) / 2 for i in range(300)]


def test_columns(spark):
    t = table(spark, [(1, "x", "y", 2.0)], "id long, a string, b string, c double")
    assert apply(t, "ReorderColumns", columns=["c", "a", "c"]).columns == ["c", "a", "id", "b"]
    assert apply(t, "AddColumnNameAffix", prefix="p_").columns == ["p_id", "p_a", "p_b", "p_c"]
    for op, args in (("KeepColumns", {"columns": ["none"]}), ("DropColumns", {"columns": ["id", "a", "b", "c"]}), ("RenameColumn", {"from_": "none", "to": "x"}), ("DuplicateColumn", {"source": "a", "target": "b"}), ("MergeColumns", {"columns": ["a"], "target": "m"}), ("GroupAggregate", {"group_columns": []}), ("KeepRowRange", {"start": 3, "end": 2}), ("KeepTopRows", {"count": 0}), ("FilterRowsContains", {"column": "a", "keyword": " "})):
        with pytest.raises(ValueError):
            apply(t, op, **args)
    with pytest.raises(ValueError):
        apply(t, "NoSuchOperation")
    with pytest.raises(ValueError):
        apply(t, "KeepTopRows", rows=3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "B", "", None]), st.sampled_from([1.0, None])), min_size=1, max_size=12), st.integers(1, 6), st.integers(0, 6))
def test_selections_split_the_table(spark, rows, start, more):
    t = table(spark, [(i, *r) for i, r in enumerate(rows)], "id long, s string, v double")
    everything = list(range(len(rows)))
    for a, b, args in (("KeepRowRange", "DropRowRange", {"start": start, "end": start + more}), ("KeepRowsWithMissing", "DropRowsWithMissing", {"columns": ["s", "v"]}), ("FilterRowsContains", "DropRowsNotContains", {"column": "s", "keyword": "b"})):
        assert sorted(column(apply(t, a, **args), "id") + column(apply(t, b, **args), "id")) == everything


def test_sampling_and_dedup(spark):
    t = table(spark, [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "x") for i in range(11)], "id long, k string")
    assert column(apply(t, "SampleRows", count=4), "id") == [0, 3, 6, 10]
    assert len(column(apply(t, "SampleRows", count=50), "id")) == 11
    assert column(apply(t, "DeduplicateByColumns", columns=["k"]), "id") == [0, 2]


def test_join_conflicts_and_empty_keys(spark):
    left = table(spark, [(1, "a", "l1", 1), (2, None, "l2", 2), (3, "z", "l3", 3)], "id long, k string, x string, y long")
    right = table(spark, [(1, "a", "r1", "q"), (2, "", "r2", "q"), (3, "n", "r3", "q"), (4, "a", "r4", "q")], "id long, k string, x string, x_right string")
    inner = join_tables(left, right, ["k"], ["k"], "inner")
    assert inner.columns == ["id", "k", "x", "y", "id_right", "x_right", "x_right_r"]
    assert [(r.id, r.x_right) for r in inner.ordered().collect()] == [(1, "r1"), (1, "r4"), (2, "r2")]
    outer = join_tables(left, right, ["k"], ["k"], "outer", "keep_left_only").ordered().collect()
    assert [r.id for r in outer] == [1, 1, 2, 3, None] and outer[-1].k is None
    report = join_report(left, right, ["k"], ["k"]).first()
    assert (report.matched_pairs, report.unmatched_left, report.unmatched_right, report.conflict_fields) == (3, 1, 1, "id, x")


def test_templates_and_sessions(spark):
    t = table(spark, [(i, f"n{i}", float(i)) for i in range(6)], "id long, name string, v double")
    session = Session()
    d = session.add("data", t)
    d = d.apply("RenameColumn", from_="name", to="label").apply("SortBy", column="v", ascending=False).apply("KeepTopRows", count=2)
    assert column(d.table, "id") == [5, 4] and d.undo().table.columns == ["id", "label", "v"] and column(d.undo().redo().table, "id") == [5, 4]
    text = d.template().to_json()
    assert '"from": "name"' in text and '"KeepTopRows"' in text
    assert column(d.replay(Template.from_json(text)).table, "id") == [5, 4]
    assert column(d.reset().table, "id") == list(range(6))
    with pytest.raises(ValueError, match="step 1"):
        Template("x", (("KeepColumns", {"columns": ["none"]}),)).replay(t)
    other = session.add("more", table(spark, [(1, "w")], "id long, z string"))
    joined, report = session.join("data", other.name, ["id"], ["id"])
    assert joined.name == "data_merge_more" and joined.table.columns == ["id", "name", "v", "z"] and report.first().matched_pairs == 1
    with pytest.raises(ValueError):
        session.join("data", "data", ["id"], ["id"])


def test_groups_that_span_runs(spark):
    """One group with most rows: its rows lie in several runs and blocks."""
    from gridloom.plans import table as plans

    rows = [(i, "a" if i % 6 else None if i % 12 else "b", float(i) if i % 5 else None) for i in range(400)]
    t = table(spark, rows, "id long, g string, v double")
    of = {g: [r for r in rows if (r[1] or "") == (g or "")] for g in ("a", "b", None)}

    def expect(f):
        return [x for _, x in sorted((r[0], x) for g in of.values() for r, x in zip(g, f([r[2] for r in g]), strict=True))]

    def sums(v):
        out, s = [], None
        for x in v:
            s = s if x is None else x + (s or 0)
            out.append(s)
        return out

    def rolled(v):
        return [sum(y) if (y := [x for x in v[max(0, i - 4) : i + 1] if x is not None]) else None for i in range(len(v))]

    def changes(v):
        return [None] + [None if a is None or b is None else b - a for a, b in zip(v, v[1:])]

    small = plans.in_blocks.__defaults__
    plans.in_blocks.__defaults__ = (9,)
    try:
        got = {
            "sums": column(apply(t, "CumulativeSum", order_column="id", target="v", output="x", group_columns=["g"]), "x"),
            "rolled": column(apply(t, "RollingAggregate", group_columns=["g"], order_column="id", target="v", window_size=5, function="sum", output="x"), "x"),
            "changes": column(apply(t, "CompareAdjacent", order_column="id", target="v", mode="差值", output="x", group_columns=["g"]), "x"),
        }
    finally:
        plans.in_blocks.__defaults__ = small
    assert got == {"sums": expect(sums), "rolled": expect(rolled), "changes": expect(changes)}


def test_carrying_by_key_over_runs(spark):
    from pyspark.sql import functions as F

    from gridloom.plans.table import carried

    rows = [(i, "k" if i < 90 else "z", i if i in (3, 95) else None) for i in range(100)]
    t = table(spark, rows, "id long, g string, v long")
    t = t.sorted_by([(F.col("g"), True, True)])
    for forward, want in ((True, [None] * 3 + [3] * 87 + [None] * 5 + [95] * 5), (False, [3] * 4 + [None] * 86 + [95] * 6 + [None] * 4)):
        got = carried(t.numbered(), {"x": F.col("v")}, [F.col("g")], forward).orderBy("id").collect()
        assert [r.x for r in got] == want
