from datetime import datetime, timedelta

import pytest

from gridloom.operators import fusion, fusion_names, profile
from gridloom.plans.table import Table

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_profile_and_issues(spark):
    rows = [(1, "a", at(0), "1", 5.0), (2, "b", at(60), "x", 50.0), (2, "b", at(30), "3", None), (None, "", at(900), None, 7.0), (5, "2024-01-01", at(960), "5", 1.0)]
    t = Table.of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, id long, s string, ts timestamp_ntz, x string, v double"), "n")
    p = {r["column"]: r for r in profile.profile_columns(t).collect()}
    assert p["id"].missing == 1 and p["id"].distinct == 3 and not p["id"].key_candidate and p["n"].key_candidate
    assert p["ts"].time_candidate and p["ts"].role == "主键候选" and p["s"].sample == "a" and p["v"].role == "数值字段"
    rules = profile.Rules(primary_key="id", composite_keys=("id", "s"), time_column="ts", max_gap_minutes=5, ranges=(("v", 2, 10),), max_lengths=(("s", 3),))
    found = {(r.category, r.field): r["count"] for r in profile.quality_issues(t, rules).collect()}
    assert found == {("主键规则", "id"): 1, ("主键重复", "id"): 1, ("组合重复", "id,s"): 1, ("时间规则", "ts"): 1, ("时间间隔", "ts"): 1, ("范围规则", "v"): 2, ("文本长度", "s"): 1, ("类型混杂", "x"): 2, ("类型混杂", "s"): 2}
    seen = profile.overview(profile.quality_issues(t, rules)).first()
    assert seen.mixed_type_column_count == 2 and seen.range_rule_issue_count == 2 and seen.high_missing_field_count == 0
    for bad in (profile.Rules(primary_key="none"), profile.Rules(composite_keys=("id",)), profile.Rules(ranges=(("v", 3, 1),)), profile.Rules(missing_threshold=0.99)):
        with pytest.raises(ValueError):
            profile.quality_issues(t, bad)


def test_pages_show_every_row_once(spark):
    t = Table.of(spark.range(23), "id")
    assert [r.id for r in profile.preview(t, 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert [r.id for r in profile.preview(t, 99, 5).collect()] == [20, 21, 22]
    assert sorted(r.id for k in range(1, 6) for r in profile.preview(t, k, 5, shuffled=True).collect()) == list(range(23))


def test_shuffled_pages_differ():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(p for k in range(1, n // 7 + 2) for p in profile.shuffled_places(n, k, 7)) == list(range(n))
    assert profile.shuffled_places(1000, 1, 7) != profile.shuffled_places(1001, 1, 7) and profile.shuffled_places(0, 1, 7) == []


def test_suggestions():
    assert profile.mapping_suggestions(["id", "x", "时间"]) == [("id", "device_id"), ("时间", "timestamp")]
    assert ("order_id", "order_id", "left") in profile.join_suggestions(["order_id", "x"], ["order_id"])
    assert profile.join_suggestions(["temp", "my col", "a_code"], ["Temperature_C", "my_col", "a_code"]) == [("temp", "Temperature_C", "inner"), ("a_code", "a_code", "left")]


def test_mapping_names():
    got = profile.mapping_suggestions(["Temp", "Batch-No", "dev id", "压力", "state", "my col"])
    assert got == [("Temp", "temperature"), ("Batch-No", "batch_id"), ("dev id", "device_id"), ("压力", "pressure"), ("state", "status")]


def test_names():
    n = fusion_names
    assert n.canonical("料温_1") == "temperature" and n.canonical("events") == "timestamp" and n.canonical("sample_x") == "current"
    assert n.unit_of("energy_kwh").name == "kW" or n.canonical("energy_kwh") == "power"
    assert n.unit_of("temp_degF").name == "°F" and n.unit_of("pressure_kpa").name == "kPa" and n.unit_of("level_pct") == n.PERCENT
    assert n.value_kind("run_status", True) == "state" and n.value_kind("trip_code", False) == "event" and n.value_kind("x", True) == "continuous"
    assert n.kinds_score("text", "state") == n.kinds_score("state", "text") == 0.72 and n.kinds_score("continuous", "text") == 0
    b = n.bind("temp_degf", True, {"device_id": False, "temp_degc": True})
    assert b.into == "temp_degc" and b.unit_score == 0.94
    assert n.bind("speed", True, {"note": False}).into is None
    assert n.counterpart("device_id", ["when", "equipment"]) == "equipment" and n.counterpart("device_id", ["x"]) is None


@pytest.fixture
def sources(spark):
    p = [(1, "m1", at(0), 20.0, "RUN"), (2, "m1", at(100), None, "stop"), (3, "m1", at(200), 22.0, None), (4, "m2", at(0), 5.0, "x")]
    s = [("m1", "2024-01-01 00:00:03", 68.0, "running", 101.0), ("m1", "2024-01-01 00:01:38", 71.6, "offline", 102.0), ("m1", "2024-01-01 00:01:41", 75.2, "offline", 104.0), ("m3", "2024-01-01 00:00:00", 50.0, "idle", 1.0)]
    primary = Table.of(spark.createDataFrame(p, "n long, device_id string, timestamp timestamp_ntz, temp_degc double, status string"), "n")
    secondary = Table.of(spark.createDataFrame(s, "equipment string, `采样时间` string, temp_degf double, mode string, pressure_kpa double"), "equipment", "采样时间")
    return ("main", primary), [("aux", secondary)]


def fused(sources, **options):
    r = fusion.fuse(fusion.Request(keys=("device_id",), time="timestamp", **options), *sources)
    return {x.n: x for x in r.table.rows().collect()}, r


def test_nearest_fusion_with_units_and_words(sources):
    rows, r = fused(sources, mode="exact_then_nearest", clean_outliers=False)
    assert rows[1].temp_degc == 20.0 and rows[1].status == "RUN" and rows[1].pressure_kpa == 101.0
    assert rows[2].temp_degc == 24.0 and rows[2].fusion_trace == "辅源1: 最近邻 1s" and "单位换算" in rows[2].fusion_corrections and "状态归一" in rows[2].fusion_corrections
    assert rows[3].status is None and rows[3].fusion_trace == "辅源1: 未命中" and rows[4].pressure_kpa is None
    assert 80 < rows[1].fusion_quality_score < 100 and 80 < rows[2].fusion_quality_score < 100 and rows[3].fusion_quality_score < 60
    report = r.report.first()
    assert (report.rows, report.matched_rows, report.sources) == (4, 2, 1)


def test_window_fusion_and_averages(sources):
    rows, _ = fused(sources, mode="window", clean_outliers=False, strategy="numeric_average", by_confidence=False)
    assert rows[2].pressure_kpa == 103.0 and rows[2].temp_degc == 23.0 and rows[2].fusion_trace == "辅源1: 时间窗聚合 2 行"
    assert rows[1].temp_degc == 20.0
    rows, _ = fused(sources, mode="resample", resample_seconds=60, clean_outliers=False, strategy="secondary_first")
    assert rows[1].fusion_trace == "辅源1: 重采样桶命中 3s" and rows[2].temp_degc == 24.0


def test_score_of_one_row(sources):
    """The parts of the score, worked out for a row that is hit exactly and for one that is not hit."""
    rows, _ = fused(sources, mode="exact", clean_outliers=False, by_confidence=False)
    row = rows[4]  # no partner: coverage 30, misses 4, all three fields missing 30, no corrections, all own cells sure
    assert row.fusion_quality_score == pytest.approx(100 - 30 - 30 - 4)
    weights = [1.0] * 4 + [0.0]  # row 3: five own cells, one blank
    assert rows[3].fusion_quality_score == pytest.approx(100 - 30 - 30 - 4 - 18 * (1 - sum(weights) / 4))


def test_unaligned_sources_are_skipped(spark, sources):
    primary, secondary = sources
    odd = Table.of(spark.createDataFrame([(1, 2)], "p long, q long"), "p")
    r = fusion.fuse(fusion.Request(keys=("device_id",), time="timestamp"), primary, [*secondary, ("odd", odd)])
    assert len(r.skipped) == 1 and r.report.first().sources == 1
    with pytest.raises(ValueError):
        fusion.fuse(fusion.Request(keys=("device_id",), time="timestamp"), primary, [("odd", odd)])


def test_outliers_and_packets(spark):
    rows = [(i, "k", at(i), 1.0 + i % 2) for i in range(30)] + [(30, "k", at(30), 500.0), (31, "k", at(3), None), (32, "k", at(3), 7.0)]
    t = Table.of(spark.createDataFrame(rows, "n long, key string, time timestamp_ntz, v double"), "n")
    df = fusion.prepared(t, ["key"], "time", fusion.Request(keys=("key",), time="time"))
    by = {r.n: r for r in df.collect()}
    assert by[30].v is None and by[30]["__an"] == 1 and 31 not in by and 3 not in by and by[32].v == 7.0


def test_segments_features_alerts(spark, sources):
    t = Table.of(spark.createDataFrame([(i, "k", at(s), float(i)) for i, s in enumerate((0, 30, 60, 200, 210))], "n long, key string, time timestamp_ntz, v double"), "n")
    assert sorted((r.segment, r.rows) for r in fusion.event_segments(t, ["key"], "time").collect()) == [(1, 3), (2, 2)]
    f = fusion.feature_table(t, ["key"], "time").first()
    assert (f.row_count, f.v_mean, f.v_last, f.v_delta, f.v_missing_rate) == (5, 2.0, 4.0, 4.0, 0.0)
    _, r = fused(sources, mode="exact_then_nearest", clean_outliers=False)
    assert {x.n: x.severity for x in fusion.alerts(r.table).collect()}[3] == "高"
