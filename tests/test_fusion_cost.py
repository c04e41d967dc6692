"""What fusion costs a row, told from plans and from how often rows are put in order."""

import datetime as dt

import pytest

from gridloom.operators import fusion
from gridloom.plans.table import Table

START = dt.datetime(2024, 1, 1)


def made_with(monkeypatch, spark, **options):
    """The regular expressions in the plan of the fused rows, as they are written, and how often rows were numbered."""
    texts, numbered = [], []
    stored, number = fusion.stored, Table.numbered
    monkeypatch.setattr(fusion, "stored", lambda df, tag: texts.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, tag))
    monkeypatch.setattr(Table, "numbered", lambda t: numbered.append(1) or number(t))
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    at = lambda n: START + dt.timedelta(seconds=n)
    p = Table.of(spark.createDataFrame([(i, "k", at(10 * i), float(i)) for i in range(4)], "event_id long, user_id string, ts timestamp_ntz, temp_degc double"), "event_id")
    q = Table.of(spark.createDataFrame([(i, "k", at(10 * i + 1), 50.0 + i, " Running ") for i in range(3)], "log_id long, user_id string, ts timestamp_ntz, temp_degf double, run_status string"), "log_id")
    try:
        rows = fusion.fuse(fusion.Request(keys=("user_id",), time="ts", window_seconds=2, clean_outliers=False, **options), ("views", p), [("logs", q)]).table.rows().collect()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    return rows, sum(t.count("regexp_replace(") for t in texts), len(texts), len(numbered)


@pytest.mark.parametrize("mode, missing", [("exact_then_window", "linear"), ("exact_then_nearest", "keep_null"), ("exact_then_window", "keep_null"), ("window", "keep_null"), ("nearest", "keep_null")])
def test_cells_are_made_once(spark, monkeypatch, mode, missing):
    rows, expressions, writes, _ = made_with(monkeypatch, spark, mode=mode, missing=missing)
    assert sorted((r.event_id, r.run_status) for r in rows)[:3] == [(0, "RUN"), (1, "RUN"), (2, "RUN")]
    assert writes == 1 and 0 < expressions < 20


def test_filling_keeps_the_places_of_fused_rows(spark, monkeypatch):
    plain = made_with(monkeypatch, spark, mode="nearest")[3]
    rows, _, _, numbered = made_with(monkeypatch, spark, mode="nearest", missing="forward")
    assert sorted((r.event_id, r.log_id) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 2)]
    assert numbered == plain + 1  # the second table's rows, for their own gaps


def test_only_answers_within_a_second_are_looked_up_again(spark, monkeypatch):
    at = lambda n: START + dt.timedelta(milliseconds=n)
    # Key a: two answers 0.4 s apart, the row 5.7 s after the first: both are 5 s before it. Key b: answers far apart.
    p = Table.of(spark.createDataFrame([(1, "a", at(5700)), (2, "b", at(5700)), (3, "b", at(95700)), (4, "a", at(99700))], "event_id long, user_id string, ts timestamp_ntz"), "event_id")
    q = [(10, "a", at(0)), (11, "a", at(400)), *((20 + i, "b", at(i * 10_001)) for i in range(10))]
    q = Table.of(spark.createDataFrame(q, "log_id long, user_id string, ts timestamp_ntz"), "log_id")
    ordered = []
    number = Table.numbered
    monkeypatch.setattr(Table, "numbered", lambda t: ordered.append(t.df.count()) or number(t))
    rows = fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="nearest", window_seconds=1000, clean_outliers=False), ("views", p), [("logs", q)]).table.rows().collect()
    assert sorted((r.event_id, r.log_id) for r in rows) == [(1, 10), (2, 21), (3, 30 - 1), (4, 10)]
    assert ordered == [16, 4]  # all rows once; then two answers and the two rows after them


def test_confidence_of_a_table_reads_it_once(spark, monkeypatch):
    t = Table.of(spark.createDataFrame([(1, "a", None), (1, "a ", None), (2, None, 1.0), (3, "", 2.0)], "id long, word string, v double"), "id")
    first, reads = type(t.df).first, []
    monkeypatch.setattr(type(t.df), "first", lambda df: reads.append(1) or first(df))
    assert fusion.source_confidence(t, "log") == pytest.approx(0.62 - 0.06)  # 4 of 12 cells are blank, a row is repeated
    assert len(reads) == 1


CASES = [
    (3, {"mode": "nearest", "clean_outliers": False}),
    (1, {"mode": "exact_then_window", "clean_outliers": False}),
    (1, {"mode": "nearest", "missing": "forward", "clean_outliers": False}),
    (1, {"mode": "window", "clean_outliers": False}),
    (1, {"mode": "nearest"}),
]


@pytest.mark.parametrize("others, options", CASES)
def test_look_ups_are_of_few_rows(spark, monkeypatch, others, options):
    at = lambda n: START + dt.timedelta(milliseconds=n)
    p = Table.of(spark.createDataFrame([(1, "a", at(5700)), (2, "b", at(5700)), (3, "b", at(95700)), (4, "a", at(99700))], "event_id long, user_id string, ts timestamp_ntz"), "event_id")
    q = [(10, "a", at(0)), (11, "a", at(400)), *((20 + i, "b", at(i * 10_001)) for i in range(10))]
    q = [(f"logs{n}", Table.of(spark.createDataFrame(q, f"log{n}_id long, user_id string, ts timestamp_ntz"), f"log{n}_id")) for n in range(others)]
    ordered = []
    number = Table.numbered
    monkeypatch.setattr(Table, "numbered", lambda t: ordered.append(t.df.count()) or number(t))
    fusion.fuse(fusion.Request(keys=("user_id",), time="ts", window_seconds=1000, **options), ("views", p), q)
    assert ordered.count(4) == others  # two answers and the two rows after them, for each source


def test_only_rows_that_share_a_time_are_grouped(spark):
    at = lambda n: START + dt.timedelta(seconds=n)
    rows = [(i, "k", at(i), float(i)) for i in range(5)]
    request = fusion.Request(keys=("user_id",), time="ts", clean_outliers=False)
    table = lambda rows: Table.of(spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, v double"), "event_id")
    alone = fusion.prepared(table(rows), ["user_id"], "ts", request)
    assert "Aggregate" not in alone._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.event_id for r in alone.collect()) == [0, 1, 2, 3, 4]
    some = fusion.prepared(table([*rows, (5, "k", at(1), None), (6, "k", at(2), 9.0), (7, "m", at(2), 9.0)]), ["user_id"], "ts", request)
    assert sorted((r.event_id, r.v) for r in some.collect()) == [(0, 0.0), (1, 1.0), (3, 3.0), (4, 4.0), (6, 9.0), (7, 9.0)]


def test_windows_of_fractions_have_two_ends(spark, monkeypatch):
    at = lambda n: START + dt.timedelta(milliseconds=n)
    p = Table.of(spark.createDataFrame([(i, "a", at(1700 * i)) for i in range(7)], "event_id long, user_id string, ts timestamp_ntz"), "event_id")
    q = Table.of(spark.createDataFrame([(10 + i, "a", at(2300 * i), 1.0) for i in range(5)], "log_id long, user_id string, ts timestamp_ntz, level double"), "log_id")
    ordered, number = [], Table.numbered
    monkeypatch.setattr(Table, "numbered", lambda t: ordered.append(t.df.count()) or number(t))
    rows = fusion.fuse(fusion.Request(keys=("user_id",), time="ts", mode="window", window_seconds=1, clean_outliers=False), ("views", p), [("logs", q)]).table.rows().collect()
    assert ordered == [12, 2 * 7 + 5]  # distances come from pairs of times, so the row's own place is not looked up
    assert sorted((r.event_id, r.fusion_trace[-3:]) for r in rows)[:2] == [(0, "1 行"), (1, "2 行")]


def test_carried_values_are_not_copied(spark):
    from pyspark.sql import functions as F

    from gridloom.plans.table import carried_both

    rows = Table.of(spark.createDataFrame([(i, i // 3, i if i % 2 else None) for i in range(9)], "id long, g long, v long"), "g", "id").numbered()
    out = carried_both(rows, {"last": F.col("v")}, {"next": F.col("v")}, [F.col("g")])
    moved = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line and "__asks" not in line]  # but what a run hands on, a row for each
    assert len(moved) == 2 and not any("__run_key" in line or "__v" in line for line in moved)
    assert [(r.last, r.next) for r in out.orderBy("id").collect()] == [(None, 1), (1, 1), (1, None), (3, 3), (3, 5), (5, 5), (None, 7), (7, 7), (7, None)]
