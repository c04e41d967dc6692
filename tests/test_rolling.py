"""Rolling frames against sums, extremes and sets of each frame."""

import math
import random

import pytest

from gridloom.operators import aggregates  # noqa: F401  registers the operations
from gridloom.operators.registry import apply
from gridloom.plans import table as plans
from gridloom.plans.table import Table


def frame(values, i, size):
    return [v for v in values[max(0, i - size + 1) : i + 1] if v is not None]


PLAIN = {
    "sum": lambda x: round(sum(x), 4) if x else None,
    "mean": lambda x: round(sum(x) / len(x), 4) if x else None,
    "max": lambda x: max(x, default=None, key=lambda v: (math.isnan(v), v)),
    "min": lambda x: min(x, default=None, key=lambda v: (math.isnan(v), v)),
    "nunique": lambda x: len(set(x)),
}


@pytest.mark.parametrize("size", [1, 16])
def test_rolling(spark, size):
    r = random.Random(size)
    rows = [(i, r.choice(["a", "a", "b", None, ""]), r.choice([None, 1.0, -2.5, 3.25, r.random() * 100])) for i in range(240)]
    t = Table.of(spark.createDataFrame(rows, "id long, g string, v double"), "id")
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g or "", []).append((i, v))
    small = plans.in_blocks.__defaults__
    plans.in_blocks.__defaults__ = (9,)  # many blocks
    try:
        for f, plain in PLAIN.items():
            got = {x.id: x.r for x in apply(t, "RollingAggregate", group_columns=["g"], order_column="id", target="v", window_size=size, function=f, output="r").rows().collect()}
            for own in groups.values():
                values = [v for _, v in own]
                assert [got[i] for i, _ in own] == pytest.approx([plain(frame(values, k, size)) for k in range(len(own))], abs=1e-4), f
        got = {x.id: x.r for x in apply(t, "RollingAggregate", group_columns=["g"], order_column="id", target="", window_size=size, function="count", output="r").rows().collect()}
        assert all([got[i] for i, _ in own] == [min(k + 1, size) for k in range(len(own))] for own in groups.values())
    finally:
        plans.in_blocks.__defaults__ = small


def test_sums_forget_what_left_the_frame(spark):
    values = [1e15, 0.25, 1e300, 1.0, 0.125, float("inf"), 0.5, float("nan"), 2.0, float("-inf"), 3.0, 0.25, None, None]
    t = Table.of(spark.createDataFrame(list(enumerate(values)), "id long, v double"), "id")
    got = [x.r for x in apply(t, "RollingAggregate", group_columns=[], order_column="id", target="v", window_size=2, function="sum", output="r").df.orderBy("id").collect()]
    want = [PLAIN["sum"](frame(values, i, 2)) for i in range(len(values))]
    assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, want, strict=True))


def test_texts_and_columns_named_like_helpers(spark):
    t = Table.of(spark.createDataFrame([(1, "10", 0), (2, "9", 0), (3, " ", 0), (4, "b", 0)], "id long, s string, chunk long"), "id")
    read = lambda f, **o: [x.r for x in apply(t, "RollingAggregate", group_columns=[], order_column="id", target="s", window_size=2, function=f, output="r", **o).df.orderBy("id").collect()]
    assert read("max", compat=True) == ["10", "9", "9", "b"] and read("min") == ["10", "10", "9", "b"] and read("nunique") == [1, 2, 1, 1] and read("sum") == [10.0, 19.0, 9.0, None]
