"""Alignment of several tables on object keys and time, and their fusion into the rows of the first.

Every secondary table is matched to the primary rows by key and time, its values are brought into the primary's units
and words, values for one field are merged by a strategy and their confidence, gaps are filled and each row is scored.
Rows are written when they are put in one order and when they are fused; only schemas and a few totals reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.parsing import FUSION, as_fusion_time, as_number, blank, is_number, is_text, number, text_of, time, trimmed
from ..plans.table import Key, Table, carried_both, in_blocks, running_sum, stored
from . import fusion_names as names
from .alignment import Source, aligned
from .profile import row_keys

MODES = ("exact", "exact_then_nearest", "nearest", "exact_then_window", "window", "resample")
MODE_NAMES = {"按时间精确对齐": "exact", "精确优先，最近邻兜底": "exact_then_nearest", "按最近邻对齐": "nearest", "精确优先，时间窗聚合兜底": "exact_then_window", "按时间窗聚合": "window", "按重采样对齐": "resample"}
STRATEGIES = ("primary_first", "secondary_first", "confidence_weighted", "numeric_average", "complementary", "keep_conflict")
AVERAGING = ("confidence_weighted", "numeric_average")
STRATEGY_NAMES = {"辅源优先": "secondary_first", "质量加权": "confidence_weighted", "数值均值": "numeric_average", "互补填充": "complementary", "冲突保留": "keep_conflict"}
FILLS = ("keep_null", "forward", "backward", "nearest", "linear", "window_mean")
FILL_NAMES = {"前向填充": "forward", "后向填充": "backward", "前后就近填充": "nearest", "线性插值": "linear", "窗口均值": "window_mean"}
FILL_LABELS = {"keep_null": "保留空值", "forward": "前向填充", "backward": "后向填充", "nearest": "就近填充", "linear": "线性插值", "window_mean": "窗口均值"}
NO_TRACE = "无融合轨迹"
# Words within a value, in order, and the word they become.
STATES = (
    (("run", "running", "online", "normal", "生产", "运行"), "RUN"), (("stop", "stopped", "offline", "停机", "停止"), "STOP"), (("maint", "maintenance", "repair", "维护", "检修"), "MAINT"),
    (("alarm", "fault", "trip", "告警", "报警", "故障"), "ALARM"), (("idle", "standby", "待机", "空闲"), "IDLE"), (("manual", "hand", "手动"), "MANUAL"), (("auto", "automatic", "自动"), "AUTO"),
)
EVENTS = (
    (("start", "启动", "开机"), "START"), (("stop", "停机", "停止"), "STOP"), (("trip", "跳闸"), "TRIP"), (("alarm", "warn", "fault", "告警", "报警", "故障"), "ALARM"),
    (("reset", "复位"), "RESET"), (("open", "开启", "打开"), "OPEN"), (("close", "关闭", "关断"), "CLOSE"),
)
VOTES = (
    (("run", "running", "online", "正常", "运行"), "RUN"), (("stop", "stopped", "offline", "停机", "停止"), "STOP"), (("maint", "maintenance", "维护", "检修"), "MAINT"),
    (("alarm", "warn", "fault", "告警", "报警", "故障"), "ALARM"), (("start", "启动", "开机"), "START"), (("trip", "跳闸"), "TRIP"), (("reset", "复位"), "RESET"),
)


@dataclass(frozen=True)
class Request:
    keys: tuple[str, ...]
    time: str
    mode: str = "exact"
    window_seconds: int = 5
    resample_seconds: int = 60
    missing: str = "keep_null"
    strategy: str = "primary_first"
    deduplicate: bool = True
    clean_outliers: bool = True
    zscore: float = 3.5
    by_confidence: bool = True
    by_meaning: bool = True
    by_kind: bool = True
    score: bool = True

    def checked(self) -> Request:
        from dataclasses import replace

        out = replace(self, keys=tuple(self.keys), mode=MODE_NAMES.get(self.mode, self.mode), missing=FILL_NAMES.get(self.missing, self.missing), strategy=STRATEGY_NAMES.get(self.strategy, self.strategy))
        if out.mode not in MODES or out.missing not in FILLS or out.strategy not in STRATEGIES or not out.keys:
            raise ValueError("unknown mode, filling or strategy, or no key")
        return replace(out, window_seconds=max(1, out.window_seconds), resample_seconds=max(1, out.resample_seconds))


@dataclass(frozen=True)
class Result:
    table: Table
    report: DataFrame
    skipped: list[str] = field(default_factory=list)


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _count(flags: list[Column]) -> Column:
    return reduce(add, [f.cast("int") for f in flags], F.lit(0))


def worded(value: Column, table: tuple, other: Column) -> Column:
    """The word of the first entry of which the value, in small letters and digits, holds a word; else `other`."""

    def named(p: Column) -> Column:
        out = F
        for words, name in table:
            out = out.when(reduce(or_, (p.contains(w) for w in words)), F.lit(name))
        return out

    letters = F.lower(F.regexp_replace(value, r"(?U)[^\p{L}\p{N}]", ""))
    # An array of one binds the letters to a name; written out, they would be made again for each word.
    return F.coalesce(F.transform(F.array(letters), named)[0], other)


def normal_value(value: Column, kind: str, t: Column | None = None) -> Column:
    """A state or event in its canonical word, other text trimmed; blank is null. t: the value trimmed, if at hand."""
    t = trimmed(value) if t is None else t
    word = worded(value, STATES if kind == "state" else EVENTS, F.upper(t)) if kind in ("state", "event") else t
    return F.when(t != "", word)


#: So many rows that share key and time, or more, are grouped with all others; fewer are taken out first.
SHARING = 1_000_000


def keyed(t: Table, keys: list[str], when: str) -> DataFrame:
    """The rows with __key, __ts and __at, their order."""
    order = F.struct(*(F.col(k.name) for k in t.order))
    return t.df.select(*t.columns, F.struct(*(text_of(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("__key"), time(t.df, when, as_fusion_time).alias("__ts"), order.alias("__at"))


def shared_times(df: DataFrame) -> DataFrame:
    """__same (a hash of key and time) and count, of those that more than one row has. A row too many of equal hash does
    no harm to those who group by key and time."""
    return df.select(F.xxhash64("__key", "__ts").alias("__same")).groupBy("__same").count().filter("count > 1")


def sharing(t: Table, keys: list[str], when: str) -> int:
    """How many rows share key and time with another; if none, no two rows are alike."""
    return shared_times(keyed(t, keys, when)).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def prepared(t: Table, keys: list[str], when: str, request: Request, many: int | None = None) -> DataFrame:
    """The rows with __key, __ts, __at (their order) and __an (outliers nulled): one for each key and time, that with
    most cells filled, of several the later. Outliers are cells beyond the z-score over the whole column. many: of
    `sharing`, if at hand; only rows that share key and time are grouped."""
    df = keyed(t, keys, when)
    if request.deduplicate:
        many = sharing(t, keys, when) if many is None else many
        alone, rest = (None, df) if many >= SHARING else (df, None)
        if 0 < many < SHARING:
            shared = shared_times(df)
            df = df.withColumn("__same", F.xxhash64("__key", "__ts"))
            alone, rest = (df.join(shared, "__same", how).drop("__same") for how in ("left_anti", "left_semi"))
        if rest is not None:
            full = _count([~blank(rest, c) for c in t.columns])
            rest = rest.groupBy("__key", "__ts").agg(F.max_by(F.struct(*t.columns, "__at"), F.struct(full, "__at")).alias("__best")).select("__best.*", "__key", "__ts")
            rest = rest.select(*t.columns, "__key", "__ts", "__at")
        df = rest if alone is None else alone if rest is None else alone.unionByName(rest)
    df = df.withColumn("__an", F.lit(0))
    numeric = [c for c in t.columns if is_number(df, c)]
    if request.clean_outliers and numeric:
        stats = df.agg(*(F.struct(F.count(c), F.avg(c), F.stddev_pop(c)).alias(f"s{i}") for i, c in enumerate(numeric))).first()
        limit = max(request.zscore, 2.0)
        bad = {c: F.abs((F.col(c) - F.lit(m)) / F.lit(s)) > limit for c, (n, m, s) in zip(numeric, stats, strict=True) if n >= 3 and s and s > 2.3e-16}
        if bad:
            flags = {c: F.coalesce(x, F.lit(False)) for c, x in bad.items()}
            df = df.withColumn("__an", _count(list(flags.values()))).withColumns({c: F.when(~x, F.col(c)) for c, x in flags.items()})
    return df


def filled_by_key(df: DataFrame, columns: list[str], how: str, order: list[str], tag: Column | None = None) -> DataFrame:
    """Gaps of columns within __key, in the order of time; with a tag, __tags gets it where a cell was filled. Rows are
    numbered by key and time and filled in runs, so one key's rows may be dealt over many tasks. Rows that have __part
    and __pid, their places among others in that order, are not numbered again, unless rows must be counted."""
    if how in ("linear", "window_mean"):
        columns = [c for c in columns if is_number(df, c)]
    if how == "keep_null" or not columns:
        return df
    if how != "window_mean" and {"__part", "__pid"} <= set(df.columns):
        rows = df.withColumn("__pos", F.col("__pid"))
    else:
        rows = Table(df, tuple(Key(c) for c in ("__key", *order))).numbered()
    mark = {c: F.when(~blank(df, c), F.struct(F.col(c).alias("v"), F.col("__ts").alias("ts"), F.col("__pos").alias("n"))) for c in columns}
    before = {f"__a_{c}": x for c, x in mark.items()} if how != "backward" else {}
    after = {f"__b_{c}": x for c, x in mark.items()} if how != "forward" else {}
    rows = carried_both(rows, before, after, [F.col("__key")])
    out, hit = {}, F.lit(False)
    for c in columns:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if how == "forward":
            new = a["v"]
        elif how == "backward":
            new = b["v"]
        elif how == "nearest":
            new = F.coalesce(a["v"], b["v"])
        elif how == "linear":
            total = F.timestamp_diff("SECOND", a["ts"], b["ts"])
            part = F.timestamp_diff("SECOND", a["ts"], F.col("__ts"))
            new = F.when(total != 0, F.round(a["v"] + (b["v"] - a["v"]) * part / total, 6))
        else:  # each gap cell is the mean of the filled cell before it and the value after the gap
            new = F.round(b["v"] - (b["v"] - a["v"]) * F.pow(F.lit(0.5), F.col("__pos") - a["n"]), 6)
        new = new.cast(df.schema[c].dataType)
        hit = hit | (blank(df, c) & new.isNotNull())
        out[c] = F.when(blank(df, c) & new.isNotNull(), new).otherwise(F.col(c))
    if tag is not None:
        rows = rows.withColumn("__tags", F.when(hit, F.array_append("__tags", tag)).otherwise(F.col("__tags")))
    return rows.withColumns(out).select(*df.columns)


def source_confidence(t: Table, name: str, alone: bool = False) -> float:
    """A prior for a whole table, from its name, blank cells, repeated rows and whether a column looks like a time. alone:
    it is known that no two rows are alike; else rows are told apart by digests of 128 bits."""
    cells = _count([blank(t.df, c) for c in t.columns])
    if alone:
        n, missing, repeated = t.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(cells), F.lit(0)), F.lit(0)).first()
    else:
        digest = [F.xxhash64(F.lit(i), *row_keys(t, t.columns)).alias(f"__d{i}") for i in (0, 1)]
        alike = t.df.select(*digest, cells.alias("__cells")).groupBy("__d0", "__d1").agg(F.count(F.lit(1)).alias("__n"), F.sum("__cells").alias("__cells"))
        n, missing, repeated = alike.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__cells"), F.lit(0)), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()
    share = missing / (n * len(t.columns)) if n else 0.0
    lower = name.lower()
    score = 0.62 + 0.08 * any(not is_text(t.df, c) and not is_number(t.df, c) or "time" in c.lower() or "date" in c.lower() for c in t.columns)
    score += 0.10 if share < 0.12 else -0.12 if share > 0.35 else 0.0
    score -= 0.06 * (repeated > 0)
    score += 0.12 * ("label" in lower or "manual" in lower or "标签" in name)
    score += 0.06 * ("control" in lower or "command" in lower or "指令" in name)
    score -= 0.08 * ("sim" in lower or "仿真" in name)
    return min(max(score, 0.25), 1.0)


def merged(value: Column, weight: Column, candidates: Column | list[Column], numeric: bool, strategy: str, by_confidence: bool) -> Column:
    """value with the candidates (value, weight) folded into it, in turn: a struct of value, weight and corrected. Of
    candidates in a list, which tell whether they are there, there should be few: each repeats those before it."""
    x = (lambda c: c) if numeric else (lambda c: as_number(c, FUSION))
    back = (lambda c: F.round(c, 6)) if numeric else (lambda c: F.round(c, 6).cast("string"))

    def step(s: Column, c: Column) -> Column:
        none = c["v"].isNull()
        empty = s["v"].isNull()
        take = F.struct(c["v"].alias("v"), c["w"].alias("w"), s["fixed"].alias("fixed"))
        fix = F.struct(c["v"].alias("v"), c["w"].alias("w"), F.lit(by_confidence).alias("fixed"))
        out = F.when(none, s).when(empty, take)
        stronger = c["w"] > s["w"]
        total = s["w"] + c["w"]
        mean = F.struct(back(F.try_divide(x(s["v"]) * s["w"] + x(c["v"]) * c["w"], total)).alias("v"), total.alias("w"), s["fixed"].alias("fixed"))
        both = x(s["v"]).isNotNull() & x(c["v"]).isNotNull()
        if strategy == "primary_first":
            over = (c["w"] >= s["w"] + 0.14) & (c["w"] >= s["w"] * 1.18) & (s["w"] <= 0.9)
            return out.when(F.lit(by_confidence) & over, fix).otherwise(s)
        if strategy == "secondary_first":
            return out.otherwise(take)
        if strategy == "numeric_average":
            plain = F.struct(back((x(s["v"]) + x(c["v"])) / 2).alias("v"), F.greatest(s["w"], c["w"]).alias("w"), s["fixed"].alias("fixed"))
            out = out.when(both, mean if by_confidence else plain)
            return out.when(x(s["v"]).isNull() & (stronger | F.lit(not by_confidence)), fix).otherwise(s)
        if strategy == "confidence_weighted":
            return out.when(both, mean).when(stronger, fix).otherwise(s)
        return out.otherwise(s)

    start = F.struct(value.alias("v"), weight.alias("w"), F.lit(False).alias("fixed"))
    if isinstance(candidates, Column):
        return F.aggregate(candidates, start, step)
    return reduce(lambda s, c: F.when(c["there"], step(s, c)).otherwise(s), candidates, start)


def fuse(request: Request, primary: tuple[str, Table], secondaries: list[tuple[str, Table]]) -> Result:
    """The primary rows with merged and new columns and fusion_quality_score, fusion_trace and fusion_corrections; a
    report of one row; and why secondaries were left out."""
    request = request.checked()
    primary_name, pt = primary
    pt.require(*request.keys, request.time)
    if not secondaries:
        raise ValueError("a secondary table is needed")
    many = sharing(pt, list(request.keys), request.time) if request.deduplicate else None
    p = prepared(pt, list(request.keys), request.time, request, many)
    prior = source_confidence(pt, primary_name, many == 0)
    kinds = {c: names.value_kind(c, is_number(p, c)) for c in pt.columns}
    skipped, sources, tables, taken = [], [], [], {names.plain(c) for c in pt.columns}
    for n, (name, st) in enumerate(secondaries):
        keys = [names.counterpart(k, st.columns) for k in request.keys]
        when = names.counterpart(request.time, st.columns)
        if None in keys or when is None:
            skipped.append(f"{name}: no column for the keys or the time")
            continue
        own = [c for c in st.columns if c not in (*keys, when)]
        bindings = [names.bind(c, is_number(st.df, c), {x: is_number(p, x) for x in pt.columns}, request.by_meaning, request.by_kind) for c in own]
        many = sharing(st, keys, when) if request.deduplicate else None
        s = prepared(st, keys, when, request, many)
        s = filled_by_key(s, st.columns[len(request.keys) :], request.missing, ["__ts", "__at"])
        mean = lambda f: sum(map(f, bindings)) / len(bindings) if bindings else 1.0  # noqa: B023, E731
        semantic, kind_score, unit_score = mean(lambda b: b.semantic), mean(lambda b: b.kind_score), mean(lambda b: b.unit_score)
        confidence = source_confidence(st, name, many == 0)
        if request.by_confidence:
            confidence = min(max(0.42 * confidence + 0.24 * semantic + 0.18 * kind_score + 0.16 * unit_score, 0.2), 1.0)
        sources.append((f"__m{len(tables)}", f"辅源{n + 1}", st, bindings, confidence, semantic))
        tables.append(Source(s, own, lambda c: worded(c, VOTES, trimmed(c)), request.deduplicate))
    if not sources:
        raise ValueError("no secondary table can be aligned: " + "; ".join(skipped))
    rows = aligned(p, tables, request.mode, request.window_seconds, request.resample_seconds)

    # What is used more than once is a column, put on in the order of need: written into each use, it would be made
    # anew in each, texts' regular expressions too.
    near_by, cells, sure = {}, {}, {}
    tags, traces, missing, new = [F.when(F.lit(False), "")], [], F.lit(0), []
    into: dict[str, list[tuple[Column, bool, bool, Column, Column]]] = {}
    weights: list[Column] = []
    anomalies, hits, fields = F.col("__an"), F.lit(0), 0
    for m, label, st, bindings, confidence, semantic in sources:
        there = F.col(m).isNotNull()
        d, how = F.col(f"{m}.distance").cast("double"), F.col(f"{m}.how")
        span = request.resample_seconds if request.mode == "resample" else request.window_seconds
        near, time_score, weight = (F.col(f"{m}_{x}") for x in ("near", "time", "weight"))
        near_by[f"{m}_near"] = _clamp(1 - F.least(d / span, F.lit(1.0)), 0.0, 1.0)
        cells[f"{m}_time"] = F.when(how == "exact", 1.0).otherwise(near)
        cells[f"{m}_weight"] = F.when(how == "exact", confidence).otherwise(_clamp(confidence * (0.55 + 0.45 * near), 0.1, 1.0))
        seconds = F.concat(F.col(f"{m}.distance").cast("string"), F.lit("s"))
        said = F.when(~there, "未命中").when(how == "exact", "精确命中").when(how == "near", F.concat(F.lit("最近邻 "), seconds)).when(how == "window", F.concat(F.lit("时间窗聚合 "), F.col(f"{m}.rows").cast("string"), F.lit(" 行"))).otherwise(F.concat(F.lit("重采样桶命中 "), seconds))
        traces.append(F.concat(F.lit(f"{label}: "), said))
        tags.append(F.when(there & (F.col(f"{m}.anomalies") > 0), "异常值剔除"))
        anomalies, hits = anomalies + F.coalesce(F.col(f"{m}.anomalies"), F.lit(0)), hits + there.cast("int")
        for i, b in enumerate(bindings):
            fields += 1
            raw, numeric = F.col(f"{m}.cells.c{i}"), is_number(st.df, b.column)
            kind = names.value_kind(b.column, numeric)
            made, unit, target = raw, names.unit_of(b.column), names.unit_of(b.into) if b.into else None
            cell, w = F.col(f"{m}_c{i}"), F.col(f"{m}_w{i}")
            if kind == "continuous" and target and unit and target != unit and target.domain == unit.domain:
                made = F.round((number_of(raw, numeric) * unit.scale + (unit.offset - target.offset)) / target.scale, 6)
                tags.append(F.when(there & cell.isNotNull(), "单位换算"))
            elif kind != "continuous" and not numeric and is_text(st.df, b.column):
                near_by[f"{m}_t{i}"] = trimmed(raw)
                made = normal_value(raw, kind, F.col(f"{m}_t{i}"))
                if kind in ("state", "event"):
                    tags.append(F.when(there & (cell != F.col(f"{m}_t{i}")), "状态归一"))
            cells[f"{m}_c{i}"] = made
            missing = missing + F.when(cell.isNull(), 1).otherwise(0)
            quality = F.when(cell.isNull(), 0.35).when(F.lit(kind == "continuous") & number_of(cell, numeric).isNull(), 0.55).otherwise(1.0 if kind == "continuous" else 0.9)
            sure[f"{m}_w{i}"] = _clamp(0.35 * weight + 0.18 * semantic + 0.18 * b.semantic + 0.14 * b.kind_score + 0.1 * b.unit_score + 0.05 * time_score + 0.05 * quality, 0.1, 1.25) if request.by_confidence else weight
            if b.into:
                whole = made is raw and is_whole(st.df, b.column)
                into.setdefault(b.into, []).append((cell, numeric, whole, w, there))
            else:
                name, k = b.column, 2
                while names.plain(name) in taken:
                    name, k = f"{b.column}_{k}", k + 1
                taken.add(names.plain(name))
                new.append((name, cell))
                weights.append(F.when(there, w).otherwise(F.lit(0.0)))
    sure |= {f"__own{i}": primary_weight(p, c, kinds[c], prior, request.by_confidence) for i, c in enumerate(pt.columns)}
    own_weights = {c: F.col(f"__own{i}") for i, c in enumerate(pt.columns)}
    rows = rows.withColumns(near_by).withColumns(cells).withColumns(sure)
    steps: dict[str, Column] = {}
    for c, listed in into.items():
        numeric = is_number(p, c)
        # Whole numbers stay whole where nothing is averaged: a double holds no more than 2^53 of them.
        whole = is_whole(p, c) and all(x[2] for x in listed) and request.strategy not in AVERAGING
        as_own = lambda cell, n: (cell.cast("long") if whole else number_of(cell, n)) if numeric else text_of(cell) if is_text(p, c) else cell.try_cast(p.schema[c].dataType)  # noqa: B023, E731
        candidates = [F.struct(as_own(cell, n).alias("v"), w.alias("w"), there.alias("there")) for cell, n, _, w, there in listed]
        start = F.col(c).cast("long" if whole else "double") if numeric else F.when(~blank(p, c), F.col(c))
        listed = F.filter(F.array(*candidates), lambda x: x["there"])
        if request.by_confidence and request.strategy != "secondary_first":
            ranked = F.array(*(F.struct((-x["w"]).alias("o"), F.lit(i).alias("i"), x["v"].alias("v"), x["w"].alias("w"), x["there"].alias("there")) for i, x in enumerate(candidates)))
            listed = F.filter(F.array_sort(ranked), lambda x: x["there"])
        if not numeric and not is_text(p, c):  # neither numbers nor text: nothing to average
            strategy = "complementary" if request.strategy == "numeric_average" else request.strategy
            steps[c] = merged(start.cast("string"), own_weights[c], F.transform(listed, lambda x: F.struct(x["v"].cast("string").alias("v"), x["w"].alias("w"))), False, strategy, request.by_confidence)
        else:  # one alone needs no array, whose functions Spark does not compile
            steps[c] = merged(start, own_weights[c], candidates if len(candidates) == 1 else listed, numeric, request.strategy, request.by_confidence)
    rows = rows.withColumns({f"__s_{c}": x for c, x in steps.items()})
    tags += [F.when(F.col(f"__s_{c}.fixed"), "低置信字段纠偏") for c in steps]
    final = [F.col(f"__s_{c}.w") if c in steps else own_weights[c] for c in pt.columns] + weights
    rows = rows.withColumns({f"__f{i}": w for i, w in enumerate(final)})
    final = [F.col(f"__f{i}") for i in range(len(final))]
    counted = _count([w > 0 for w in final])
    mean_weight = reduce(add, (F.when(w > 0, w).otherwise(0.0) for w in final)) / F.col("__counted")
    confidence = F.when(F.col("__counted") > 0, _clamp(mean_weight, 0.0, 1.25)).otherwise(0.0)
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))
    rows = rows.withColumns({"__hits": hits, "__missing": missing, "__anomalies": anomalies, "__tags": found, "__counted": counted}).withColumn("__conf", confidence)
    hits, missing, anomalies, confidence, found = (F.col(c) for c in ("__hits", "__missing", "__anomalies", "__conf", "__tags"))
    n = len(sources)
    penalty = 30.0 * (1 - hits / n) + 4.0 * (n - hits) + 30.0 * (F.least(missing / fields, F.lit(1.0)) if fields else F.lit(0.0))
    penalty = penalty + F.least(4.0 * anomalies, F.lit(24.0)) + F.least(2.0 * F.size(found), F.lit(12.0)) + 18.0 * (1 - _clamp(confidence, 0.0, 1.0))
    quality = _clamp(100.0 - penalty, 0.0, 100.0) if request.score else F.lit(100.0)
    rows = rows.withColumns({"__quality": F.round(quality, 4), "__trace": F.array_join(F.array(*traces), " | "), **{f"__n{i}": c for i, (_, c) in enumerate(new)}})
    rows = rows.withColumns({c: F.col(f"__s_{c}.v").cast(p.schema[c].dataType) if not is_number(p, c) else F.col(f"__s_{c}.v") for c in steps})
    rows = rows.select(*pt.columns, *(F.col(f"__n{i}").alias(x) for i, (x, _) in enumerate(new)), "__pid", "__part", "__key", "__ts", "__hits", "__missing", "__anomalies", "__conf", "__quality", "__trace", "__tags")
    columns = [*(x for x, _ in new), *pt.columns[1:]]
    rows = stored(rows, "fused")  # once, for filling, the report and all that follows
    rows = filled_by_key(rows, columns, request.missing, ["__ts", "__pid"], F.lit(FILL_LABELS[request.missing]))
    corrected = F.when(F.size("__tags") > 0, F.array_join(F.array_sort(F.array_distinct("__tags")), " | ")).otherwise(FILL_LABELS[request.missing])
    out = rows.select(*pt.columns, *(x for x, _ in new), F.col("__quality").alias("fusion_quality_score"), F.col("__trace").alias("fusion_trace"), corrected.alias("fusion_corrections"), "__pid", "__hits", "__missing", "__anomalies", "__conf")
    report = out.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__hits") > 0).alias("matched_rows"), F.round(F.avg("fusion_quality_score"), 4).alias("average_quality"),
        F.round(F.avg("__conf"), 4).alias("average_confidence"), F.sum("__missing").alias("missing_fields"), F.sum("__anomalies").alias("anomaly_cells"),
        F.lit(len(sources)).alias("sources"), F.lit("; ".join(skipped)).alias("skipped"),
    )
    table = Table(out.drop("__hits", "__missing", "__anomalies", "__conf"), (Key("__pid"),))
    return Result(table, report, skipped)


def is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def number_of(c: Column, numeric: bool) -> Column:
    return c.cast("double") if numeric else as_number(text_of(c), FUSION)


def primary_weight(df: DataFrame, column: str, kind: str, prior: float, by_confidence: bool) -> Column:
    """How sure a primary cell is: 0 if blank."""
    if not by_confidence:
        return F.when(blank(df, column), 0.0).otherwise(1.0)
    text = text_of(F.col(column))
    if kind == "continuous":
        quality = F.when(number(df, column, FUSION).isNotNull(), 1.0).otherwise(0.5)
    elif kind == "text":
        quality = F.lit(0.85)
    else:  # other than states and events, a cell that is not blank is its own normal value
        same = normal_value(text, kind) == trimmed(text) if kind in ("state", "event") else F.lit(True)
        quality = F.when(same, 0.95 if kind == "state" else 0.92).otherwise(0.9 if kind == "state" else 0.87)
    factor = F.greatest(1.0 - F.col("__an") * 0.08, F.lit(0.55))
    seen = F.when(F.col("__ts").isNotNull(), 1.0).otherwise(0.85)
    return F.when(blank(df, column), 0.0).otherwise(_clamp(0.55 * prior + 0.25 * quality + 0.1 * factor + 0.1 * seen, 0.18, 1.1))


# --- results made from a fused (or any timed) table


def feature_table(t: Table, keys: list[str], when: str, columns: int = 12) -> DataFrame:
    """One row per key: row_count, start_time, end_time and, of the first numeric columns, mean, max, min, last, delta
    and missing_rate in percent."""
    at = time(t.df, when, as_fusion_time)
    numeric = [c for c in t.columns if is_number(t.df, c) and not c.startswith("fusion_") and c not in keys][:columns]
    place = F.struct("__at", *(k.name for k in t.order))
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min("__at").alias("start_time"), F.max("__at").alias("end_time")]
    for c in numeric:
        x = F.col(c).cast("double")
        where = F.when(x.isNotNull(), place)
        aggs += [F.round(F.avg(x), 6).alias(f"{c}_mean"), F.max(x).alias(f"{c}_max"), F.min(x).alias(f"{c}_min"), F.max_by(x, where).alias(f"{c}_last"),
                 F.round(F.max_by(x, where) - F.min_by(x, where), 6).alias(f"{c}_delta"), F.when(F.count(x) > 0, F.round(100.0 * (1 - F.count(x) / F.count(F.lit(1))), 6)).alias(f"{c}_missing_rate")]
    return t.df.withColumn("__at", at).groupBy(*keys).agg(*aggs)


def event_segments(t: Table, keys: list[str], when: str, gap_seconds: int = 60) -> DataFrame:
    """Runs of rows of a key without a gap above the limit: segment (from 1), start_time, end_time, rows and, of fused
    rows, average_score and trace_excerpt (the first two traces that are not blank)."""
    rows = t.with_df(t.df.withColumn("__at", time(t.df, when, as_fusion_time)).filter("__at is not null"))
    rows = rows.sorted_by([*((F.col(k), True, True) for k in keys), (F.col("__at"), True, True)]).numbered()
    w = Window.partitionBy("__block", *keys).orderBy("__pos")
    far = F.abs(F.timestamp_diff("SECOND", F.lag("__at").over(w), F.col("__at"))) > gap_seconds
    rows = in_blocks(rows, 1).withColumn("__new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).filter(~F.col("__copy"))
    rows = running_sum(rows, "segment", F.col("__new"), [F.col(k) for k in keys])
    score = [F.round(F.avg("fusion_quality_score"), 4).alias("average_score")] if "fusion_quality_score" in t.columns else []
    traces = []
    if "fusion_trace" in t.columns:  # the first, and the first of those that come after it; a row has one place
        told = F.col("fusion_trace")
        place = F.when(~F.coalesce(trimmed(told).isin("", NO_TRACE), F.lit(True)), F.col("__pos"))
        firsts = running_sum(rows.withColumn("__place", place), "__nth", F.when(F.col("__place").isNotNull(), 1), [*(F.col(k) for k in keys), F.col("segment")])
        rows = firsts.withColumn("__told", F.when(F.col("__place").isNotNull() & (F.col("__nth") <= 2), F.struct("__pos", told.alias("trace"))))
        traces = [F.array_join(F.transform(F.array_sort(F.collect_list("__told")), lambda x: x["trace"]), " | ").alias("trace_excerpt")]
    return rows.groupBy(*keys, "segment").agg(F.min("__at").alias("start_time"), F.max("__at").alias("end_time"), F.count(F.lit(1)).alias("rows"), *score, *traces)


def alerts(t: Table, threshold: float = 70.0) -> DataFrame:
    """Fused rows with a score below the threshold, or with corrections other than filling; severe from a quarter below."""
    score = F.col("fusion_quality_score")
    tags = F.filter(F.split("fusion_corrections", r" \| "), lambda x: ~x.isin(*FILL_LABELS.values()))
    return t.df.filter((score < threshold) | (F.size(tags) > 0)).select(*t.columns, F.when(score < 0.75 * threshold, "高").otherwise("中").alias("severity"))
