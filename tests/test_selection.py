"""Rows by position against the sorted list of rows."""

import datetime as dt
import random

import pytest

from gridloom.operators.profile import preview
from gridloom.operators.registry import apply
from gridloom.plans import selection
from gridloom.plans.table import Table


def rows(n=300):
    r = random.Random(3)
    return [(i, r.choice([None, "", "b", "a'\"\\", "日本"]), r.choice([None, float("nan"), -0.0, 2.5, float("-inf")]), r.choice([None, dt.datetime(1900, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 5, 1)])) for i in range(n)]


def table(spark, data):
    return Table.of(spark.createDataFrame(data, "id long, s string, v double, t timestamp_ntz"), "id")


def ordered(t):
    return [r.id for r in t.ordered().collect()]


@pytest.mark.parametrize("by", [[], [("v", False), ("s", True)]])
def test_ranges_and_samples(spark, by):
    from pyspark.sql import functions as F

    t = table(spark, rows())
    t = t.sorted_by([(F.col(c), up, up) for c, up in by]) if by else t
    every = ordered(t)
    for a, b in ((1, 1), (290, 999), (1, 300), (400, 500)):
        assert ordered(apply(t, "KeepRowRange", start=a, end=b)) == every[a - 1 : b]
    assert ordered(apply(t, "DropRowRange", start=7, end=40)) == every[:6] + every[40:]
    for count in (1, 7, 100, 500):
        want = every if count >= 300 else [every[k] for k in sorted({k * 299 // max(count - 1, 1) for k in range(count)})]
        assert ordered(apply(t, "SampleRows", count=count)) == want
    assert [r.id for r in preview(t, 3, 20).collect()] == every[40:60]
    pages = [[r.id for r in preview(t, p, 60, shuffled=True).collect()] for p in range(1, 6)]
    assert sorted(sum(pages, [])) == sorted(every) and sum(pages, []) != every


def test_several_passes(spark, monkeypatch):
    """With so short stretches that they are cut again and again."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(selection, "SORTED", 20)
    monkeypatch.setattr(selection, "BOUNDS", 8)
    t = table(spark, rows(200)).sorted_by([(F.col("t"), False, False), (F.col("s"), True, True)])
    every = ordered(t)
    assert ordered(apply(t, "KeepRowRange", start=37, end=140)) == every[36:140]
    assert ordered(apply(t, "SampleRows", count=5)) == [every[k * 199 // 4] for k in range(5)]


def test_keys_that_do_not_tell_rows_apart(spark):
    t = Table.of(spark.createDataFrame([(i // 40, i) for i in range(200)], "k long, id long"), "k")
    got = [r.id for r in apply(t, "KeepRowRange", start=30, end=60).rows().collect()]
    assert len(got) == 31
    assert preview(t, 2, 30).count() == 30


def test_empty_table(spark):
    t = Table.of(spark.createDataFrame([], "id long"), "id")
    assert apply(t, "KeepRowRange", start=1, end=5).df.count() == 0 and apply(t, "SampleRows", count=3).df.count() == 0 and preview(t, 1, 10).count() == 0


def test_nothing_is_written_and_no_row_is_shuffled(spark, monkeypatch):
    from gridloom.plans import table as plans

    def fail(*a):
        raise AssertionError("written")

    monkeypatch.setattr(plans, "stored", fail)
    t = table(spark, rows())
    for out in (apply(t, "KeepRowRange", start=5, end=50).df, apply(t, "DropRowRange", start=5, end=50).df, apply(t, "SampleRows", count=10).df):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
