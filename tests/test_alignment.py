"""Alignment by key and time against plain pairs of rows."""

import datetime as dt
import math
import random

import pytest

from gridloom.functions.parsing import trimmed
from gridloom.operators.alignment import Source, aligned

START = dt.datetime(2024, 1, 1)
SCHEMA = "__key struct<k0: string>, __ts timestamp_ntz, __at struct<n: long>, __an int"


def tables(spark, step, seed):
    """Primary rows and two sources, whose times are multiples of `step` microseconds."""
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.05 else START + dt.timedelta(microseconds=r.randrange(0, 40_000_000, step))
    key = lambda: r.choice(["a", "a", "a", "b", None])
    p = [((key(),), when(), (i,), 0) for i in range(60)]
    a = [((key(),), when(), (i,), r.randrange(2), r.choice([1.5, 2.25, None, 1e25, -7.0, 1e22] + [float("inf"), float("nan")] * (i % 9 == 0)), r.choice(["x", " x ", "y", "", None, "3.5"]), r.choice([None, 9007199254740993, 4])) for i in range(70)]
    b = [((key(),), when(), (i,), 0, r.random() < 0.5) for i in range(25)]
    primary = spark.createDataFrame(p, SCHEMA)
    first = spark.createDataFrame(a, SCHEMA + ", `v 1` double, w string, n long")
    second = spark.createDataFrame(b, SCHEMA + ", f boolean")
    return primary, [Source(first, ["v 1", "w", "n"]), Source(second, ["f"])], p, [a, b]


def apart(x, y):
    return abs((x - y) // dt.timedelta(microseconds=1)) // 1_000_000


def number(x):
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return None
    return None if x is None or isinstance(x, bool) else float(x)


def mean(values):
    kept = [v for v in map(number, values) if v is not None]
    return round(sum(kept) / len(kept), 6) if kept else None


def plain(row, source, mode, window, bucket):
    key, ts = row[0], row[1]
    rows = [s for s in source if s[0] == key and s[1] is not None and ts is not None]
    if mode == "exact":
        rows = [s for s in rows if s[1] == ts]
    elif mode == "resample":
        slot = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=bucket)
        rows = [s for s in rows if slot(s[1]) == slot(ts)]
    else:
        rows = [s for s in rows if apart(ts, s[1]) <= window]
    if not rows:
        return None
    exact = mode.startswith("exact") and any(s[1] == ts for s in rows)
    one = min(rows, key=lambda s: (mode.startswith("exact") and s[1] != ts, apart(ts, s[1]), s[1], s[2]))
    if "window" not in mode or exact:
        how = "exact" if exact else "bucket" if mode == "resample" else "near"
        return tuple(one[4:]), apart(ts, one[1]), one[3], how, len(rows) if "window" in mode else 1
    cells = []
    for i in range(4, len(rows[0])):
        column, first = [s[i] for s in rows], one[i]
        texts = any(isinstance(s[i], str) for s in source)
        if any(isinstance(s[i], bool) for s in source):
            cells.append(first)
            continue
        m = mean(column)
        if texts:
            weights = {}
            for s in rows:
                if s[i] is not None and s[i].strip():
                    weights[s[i].strip()] = weights.get(s[i].strip(), 0) + 1 / (1 + apart(ts, s[1]))
            best = max(((round(w, 9), x) for x, w in weights.items()), default=(0, None))[1]
            cells.append(str(m) if m is not None else best if best is not None else first)
        else:
            whole = any(isinstance(s[i], int) for s in source)
            cells.append(first if m is None else int(m) if whole else m)
    return tuple(cells), sum(apart(ts, s[1]) for s in rows) // len(rows), sum(s[3] for s in rows), "window", len(rows)


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-9)
    return x == y


@pytest.mark.parametrize("mode", ["exact", "exact_then_nearest", "nearest", "resample", "window", "exact_then_window"])
@pytest.mark.parametrize("step", [1_000_000, 137_000])
def test_aligned(spark, mode, step):
    primary, sources, p, plain_sources = tables(spark, step, len(mode) + step)
    got = {r["__at"]["n"]: r for r in aligned(primary, sources, mode, 3, 7).collect()}
    assert len(got) == len(p)
    place = lambda r: (r["__key"]["k0"] is not None, r["__key"]["k0"] or "", r["__ts"] is not None, r["__ts"] or START, r["__at"]["n"])
    in_order = [r["__pid"] for r in sorted(got.values(), key=place)]
    assert in_order == sorted(in_order)
    for row in p:
        for n, source in enumerate(plain_sources):
            m, want = got[row[2][0]][f"__m{n}"], plain(row, source, mode, 3, 7)
            if want is None:
                assert m is None
                continue
            assert (m["distance"], m["anomalies"], m["how"], m["rows"]) == want[1:], (row, n)
            for x, y in zip(m["cells"], want[0], strict=True):
                assert same(x, y), (row, n, m["cells"], want)


def test_empty_sides(spark):
    primary, sources, _, _ = tables(spark, 1_000_000, 1)
    none = [Source(s.rows.limit(0), s.columns) for s in sources]
    for mode in ("window", "nearest"):
        assert all(r["__m0"] is None and r["__m1"] is None for r in aligned(primary, none, mode, 3, 7).collect())
        assert aligned(primary.limit(0), sources, mode, 3, 7).count() == 0


def test_source_without_columns(spark):
    primary, sources, _, _ = tables(spark, 1_000_000, 2)
    rows = aligned(primary, [Source(sources[1].rows, [])], "window", 3, 7).collect()
    assert any(r["__m0"] is not None for r in rows)


def test_words_are_made_before_votes(spark):
    primary, sources, _, _ = tables(spark, 1_000_000, 3)
    from pyspark.sql import functions as F

    rows = aligned(primary, [Source(sources[0].rows, ["w"], lambda c: F.upper(trimmed(c)))], "window", 3, 7).collect()
    assert {r["__m0"]["cells"]["c0"] for r in rows if r["__m0"]} >= {"X", "Y"}
