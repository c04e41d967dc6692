"""Which rows of secondary tables belong to each primary row, by key and time, without pairs of rows.

All tables are put in one order of key and time, numbered and written once; the last and the next row of every source
are carried along it, so nearest rows of any number of sources cost one shuffle. What a time window holds comes from
running sums at its two ends, subtracted: counts, anomalies, means and distances of a window cost two look-ups however
many rows it has. Sums of values run in decimals, so that a difference is exact. Only votes on texts, and distances
where times have fractions of a second, meet as pairs: of distinct times, each word of a key and time counted first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..functions.parsing import FUSION, as_number, trimmed
from ..plans.table import Key, Table, carried_both, running_sums, stored

@dataclass(frozen=True)
class Source:
    """A secondary table: __key, __ts, __at (its order), __an (anomalies) and the columns to hand over. `word` makes the
    canonical word of a text cell, for votes. `single`: no two rows share key and time."""

    rows: DataFrame
    columns: list[str]
    word: object = trimmed
    single: bool = False

    @property
    def kinds(self) -> dict[int, T.DataType]:
        return {i: self.rows.schema[c].dataType for i, c in enumerate(self.columns)}

    @property
    def texts(self) -> list[int]:
        return [i for i, k in self.kinds.items() if isinstance(k, T.StringType)]

    @property
    def averaged(self) -> list[int]:
        return [i for i, k in self.kinds.items() if not isinstance(k, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))]

    def value(self, i: int) -> Column:
        c = F.col(f"`{self.columns[i]}`")
        return as_number(c, FUSION) if i in self.texts else c.try_cast("double")

    def whole(self, i: int) -> bool:
        return isinstance(self.kinds[i], T.IntegralType)

    @property
    def timed(self) -> DataFrame:
        return self.rows.filter("__ts is not null")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def seconds_apart(a: Column, b: Column) -> Column:
    """Whole seconds, cut, without a sign."""
    return F.abs(F.timestamp_diff("SECOND", a, b))


def _shifted(c: Column, by: Column) -> Column:
    return F.timestamp_micros(micros(c) + by).cast("timestamp_ntz")


def one_for_each_time(s: Source, n: int) -> DataFrame:
    """Of rows of one key and time only the first can be the nearest: __key, __ts, __x{n} (ts, cells, anomalies)."""
    cells = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(s.columns))) if s.columns else F.struct(F.lit(0).alias("none"))
    x = F.struct(F.col("__ts").alias("ts"), cells.alias("cells"), F.col("__an").cast("long").alias("anomalies"))
    if s.single:
        return s.timed.select("__key", "__ts", x.alias(f"__x{n}"))
    return s.timed.groupBy("__key", "__ts").agg(F.min_by(x, "__at").alias(f"__x{n}"))


def in_one_order(primary: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """The rows of primary (__key, __ts, __at and more), which ask, and of the answers (__key, __ts, __x{n}), numbered
    by key and time and written once. __n: the n of an answer, null for those who ask."""
    both = primary.withColumns({"__asks": F.lit(True), "__n": F.lit(None).cast("int")})
    for n, a in enumerate(answers):
        both = both.unionByName(a.withColumns({"__asks": F.lit(False), "__n": F.lit(n)}), allowMissingColumns=True)
    return Table(both, tuple(Key(c) for c in ("__key", "__ts", "__asks", "__at"))).numbered()  # answers come before those who ask at their time


def neighbours(placed: DataFrame, count: int) -> DataFrame:
    """Those who ask, with __pid, their place, __part, its run, and of each of `count` answers __last{n}, the last of the key at or
    before the row's time, and __next{n}, the first after it."""
    rows = carried_both(placed, {f"__last{n}": F.col(f"__x{n}") for n in range(count)}, {f"__next{n}": F.col(f"__x{n}") for n in range(count)}, [F.col("__key")])
    return rows.filter("__asks").withColumnRenamed("__pos", "__pid").drop("__asks", "__n", *(f"__x{n}" for n in range(count)))


def fractions(placed: DataFrame, count: int) -> tuple[bool, list[bool]]:
    """Whether the fractions of seconds of the asking rows and of all answers are one, and for each of the answers
    whether its own differ."""
    part = F.pmod(micros(F.col("__ts")), F.lit(1_000_000))
    spans = {r[0]: (r[1], r[2]) for r in placed.select("__n", part.alias("f")).groupBy("__n").agg(F.min("f"), F.max("f")).collect()}  # one row for each table
    known = {x for span in spans.values() for x in span if x is not None}
    return len(known) < 2, [len(set(spans.get(n, ()))) > 1 for n in range(count)]


def tied(placed: DataFrame, count: int, differ: list[bool]) -> list[DataFrame | None]:
    """For each source whose fractions differ, __key, __ts and __x0 of the answers that another of their key may be less
    than a second apart from: such share two seconds from an even or an odd one. None if there are none. Only these can
    be as many seconds before a row. Shared seconds are told by a hash of 64 bits; an answer too many does no harm."""
    if not any(differ):
        return [None] * count
    second = F.floor(micros(F.col("__ts")) / 1_000_000)
    rows = placed.filter(F.col("__n").isin(*(n for n in range(count) if differ[n])))
    twos = F.array(*(F.xxhash64("__n", "__key", F.lit(odd), F.floor((second + odd) / 2)) for odd in (0, 1)))
    shared = rows.select(F.explode(twos).alias("__two")).groupBy("__two").count().filter("count > 1").select("__two")
    shared = stored(shared, "shared-seconds")
    if shared.isEmpty():
        return [None] * count
    rows = rows.withColumn("__two", F.explode(twos)).join(shared, "__two", "left_semi").dropDuplicates(["__n", "__key", "__ts"])
    rows = stored(rows.select("__n", "__key", "__ts", *(f"__x{n}" for n in range(count))), "tied")
    some = {r[0] for r in rows.select("__n").distinct().collect()}  # one row for each source
    return [rows.filter(F.col("__n") == n).select("__key", "__ts", F.col(f"__x{n}").alias("__x0")) if n in some else None for n in range(count)]


def chosen(rows: DataFrame, n: int, exact_first: bool, bucket: int | None) -> DataFrame:
    """Of each row's neighbours among the answers n the one with fewer whole seconds to it, within the row's `bucket` of
    so many seconds, if given; of as many the last before it: __chosen{n}, __d{n} (whole seconds), __hit{n} (at the very
    time) and __back{n} (before the row)."""
    ts, last, after = F.col("__ts"), F.col(f"__last{n}"), F.col(f"__next{n}")
    if bucket:
        of = lambda c: F.floor(micros(c) / (bucket * 1_000_000))
        last, after = (F.when(of(c["ts"]) == of(ts), c) for c in (last, after))
    last, after = (F.when(ts.isNotNull(), c) for c in (last, after))
    away = lambda c: seconds_apart(ts, c["ts"])
    hit = F.coalesce(last["ts"] == ts, F.lit(False)) & F.lit(exact_first)
    back = last.isNotNull() & (hit | after.isNull() | (away(last) <= away(after)))
    rows = rows.withColumns({f"__back{n}": back, f"__hit{n}": hit, f"__d{n}": F.when(back, away(last)).otherwise(away(after)), f"__chosen{n}": F.when(back, last).otherwise(after)})
    return rows.drop(f"__last{n}", f"__next{n}")


def nearest(rows: DataFrame, n: int, limit: int | None, bucket: int | None, among: DataFrame | None) -> DataFrame:
    """Adds __found{n}: the answer of `chosen`, `limit` seconds away at most; of as many the earliest: ts, cells,
    anomalies, d, hit (at the very time). Where answers may be less than a second apart (`among`, of `tied`), several may
    be as many seconds before the row; the earliest of these is looked up, for the rows whose last answer is such."""
    ts, d, one = F.col("__ts"), F.col(f"__d{n}"), F.col(f"__chosen{n}")
    if among is not None:
        start = micros(ts) - (d + 1) * 1_000_000
        if bucket:
            start = F.greatest(start, F.floor(micros(ts) / (bucket * 1_000_000)) * (bucket * 1_000_000) - 1)
        again = rows.filter(f"__back{n} and not __hit{n}").select(F.col("__pid").alias("__of"), "__key", one["ts"].alias("__ts"), F.timestamp_micros(start).cast("timestamp_ntz").alias("__start"))
        again = again.join(among.select("__key", "__ts"), ["__key", "__ts"], "left_semi").select("__of", "__key", F.col("__start").alias("__ts"), F.lit(0).alias("__at"))
        placed = in_one_order(again, [among])
        first = neighbours(placed, 1).select(F.col("__of").alias("__pid"), F.col("__next0").alias("__first"))
        rows = rows.join(stored(first, "firsts"), "__pid", "left")  # stored, few rows are known to be few: the others stay where they are
        one = F.coalesce("__first", one)
    near = d.isNotNull() if limit is None else d <= limit
    found = F.struct(one["ts"].alias("ts"), one["cells"].alias("cells"), one["anomalies"].alias("anomalies"), d.alias("d"), F.col(f"__hit{n}").alias("hit"))
    return rows.withColumn(f"__found{n}", F.when(near, found)).drop("__first", *(f"__{x}{n}" for x in ("back", "hit", "d", "chosen")))


def _amounts(s: Source, n: int) -> dict[str, Column]:
    """What is summed over the rows of a window: rows, whole seconds, anomalies and the values of each averaged column."""
    out = {f"r{n}": F.lit(1).cast("long"), f"t{n}": F.floor(micros(F.col("__ts")) / 1_000_000), f"a{n}": F.col("__an").cast("long")}
    for i in s.averaged:
        out |= {f"{k}{n}_{i}": c for k, c in exact.amounts(s.value(i), s.whole(i)).items()}
    return out


def window_totals(primary: DataFrame, sources: list[Source], seconds: int, away: bool = True) -> DataFrame:
    """__pid and, for each source n: rows{n}, away{n} (if asked for: whole seconds between the row's second and theirs, summed),
    anomalies{n} and mean{n}_{i} over the source's rows of the key within so many whole seconds of the row's time."""
    reach = (seconds + 1) * 1_000_000 - 1  # distances are cut to whole seconds
    asks = primary.filter("__ts is not null").select("__pid", "__key", "__ts")
    ends = ((0, F.lit(-reach), 0), *([(1, F.lit(0), 2)] if away else []), (2, F.lit(reach), 2))  # place: before or after what is of the same time
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("end"), _shifted(F.col("__ts"), by).alias("at"), F.lit(place).alias("place")) for k, by, place in ends)))
    both = asks.select("__pid", "__key", each.alias("e")).select("__pid", "__key", F.col("e.at").alias("__ts"), F.col("e.place").alias("__place"), F.col("e.end").alias("__end"))
    names: list[str] = []
    for n, s in enumerate(sources):
        amounts = {k: c for k, c in _amounts(s, n).items() if away or k[0] != "t"}
        names += amounts
        both = both.unionByName(s.timed.select("__key", "__ts", F.lit(1).alias("__place"), *(c.alias(name) for name, c in amounts.items())), allowMissingColumns=True)
    rows = Table(both, tuple(Key(c) for c in ("__key", "__ts", "__place", "__pid"))).numbered()
    rows = running_sums(rows, {f"__{name}": F.col(name) for name in names}, [F.col("__key")]).filter("__place <> 1")
    at = lambda name, end: F.coalesce(F.max(F.when(F.col("__end") == end, F.col(f"__{name}"))), F.lit(0))
    rows = rows.groupBy("__pid").agg(*(at(name, end).alias(f"{name}_{end}") for name in names for end in (0, 1, 2) if end != 1 or away and name[0] in "rt"), F.max(F.when(F.col("__end") == 1, F.floor(micros(F.col("__ts")) / 1_000_000))).alias("second"))
    out = []
    within = lambda name, a=0, b=2: F.col(f"{name}_{b}") - F.col(f"{name}_{a}")
    for n, s in enumerate(sources):
        if away:
            before = within(f"r{n}", 0, 1) * F.col("second") - within(f"t{n}", 0, 1)
            after = within(f"t{n}", 1, 2) - within(f"r{n}", 1, 2) * F.col("second")
            out.append((before + after).alias(f"away{n}"))
        out += [within(f"r{n}").alias(f"rows{n}"), within(f"a{n}").alias(f"anomalies{n}")]
        for i in s.averaged:
            of = lambda k: within(f"{k}{n}_{i}")  # noqa: B023, E731
            out.append(F.round(F.try_divide(exact.total(of, s.whole(i)), of("n")), 6).alias(f"mean{n}_{i}"))
    return rows.select("__pid", *out)


def pairs_of_times(primary: DataFrame, counted: DataFrame, seconds: int) -> DataFrame:
    """Rows of `counted` (__key, __ts and more) with __at and d, for each distinct time __at of the primary rows of the
    key within so many whole seconds. They meet in buckets of time a little wider than the window, so a key with very
    many times is dealt over many tasks."""
    size = (seconds + 1) * 1_000_000
    times = primary.filter("__ts is not null").select("__key", F.col("__ts").alias("__at")).distinct().withColumn("__b", F.floor(micros(F.col("__at")) / size))
    own = F.floor(micros(F.col("__ts")) / size)
    spread = counted.withColumn("__b", F.explode(F.sequence(own - 1, own + 1)))
    return times.join(spread, ["__key", "__b"]).withColumn("d", seconds_apart(F.col("__at"), F.col("__ts"))).filter(F.col("d") <= seconds).drop("__b")


def votes(primary: DataFrame, s: Source, seconds: int) -> DataFrame:
    """__key, __ts (distinct times of the primary) and votes, for each text column that has any the word of most weight:
    a row weighs 1 / (1 + its whole seconds). Weights are compared to nine digits; of as much the largest word."""
    words = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), s.word(F.col(f"`{s.columns[i]}`")).alias("word")) for i in s.texts)))
    counted = s.timed.select("__key", "__ts", words.alias("v")).filter("trim(v.word) <> ''").groupBy("__key", "__ts", "v.i", "v.word").agg(F.count(F.lit(1)).alias("n"))
    weighed = pairs_of_times(primary, counted, seconds).groupBy("__key", "__at", "i", "word").agg(F.round(F.sum(F.col("n") / (1 + F.col("d"))), 9).alias("w"))
    best = weighed.groupBy("__key", "__at", "i").agg(F.max(F.struct("w", "word")).alias("best"))
    return best.groupBy("__key", F.col("__at").alias("__ts")).agg(F.map_from_entries(F.collect_list(F.struct("i", "best.word"))).alias("votes"))  # an entry for each column


def distances(primary: DataFrame, s: Source, seconds: int) -> DataFrame:
    """__key, __ts (distinct times of the primary) and away, the whole seconds to the rows within the window, summed."""
    counted = s.timed.groupBy("__key", "__ts").agg(F.count(F.lit(1)).alias("n"))
    return pairs_of_times(primary, counted, seconds).groupBy("__key", F.col("__at").alias("__ts")).agg(F.sum(F.col("n") * F.col("d")).alias("away"))


def aligned(primary: DataFrame, sources: list[Source], mode: str, window_seconds: int, resample_seconds: int) -> DataFrame:
    """primary (__key, __ts, __at and more) with __pid, __part and, for each source, __m{n}: cells (c0, c1 and so on), distance,
    anomalies, how ('exact', 'near', 'window', 'bucket') and rows; null without a match."""
    exact_first = mode.startswith("exact")
    answers = [one_for_each_time(s, n) for n, s in enumerate(sources)]
    placed = in_one_order(primary, answers)
    rows = neighbours(placed, len(sources))
    if mode == "exact":
        for n in range(len(sources)):
            x = F.col(f"__last{n}")
            m = F.struct(x["cells"].alias("cells"), F.lit(0).cast("long").alias("distance"), x["anomalies"].alias("anomalies"), F.lit("exact").alias("how"), F.lit(1).cast("long").alias("rows"))
            rows = rows.withColumn(f"__m{n}", F.when(x["ts"] == F.col("__ts"), m)).drop(f"__last{n}", f"__next{n}")
        return rows
    alike, differ = fractions(placed, len(sources))
    among = tied(placed, len(sources), differ)
    limit, bucket = (None, resample_seconds) if mode == "resample" else (window_seconds, None)
    for n in range(len(sources)):
        rows = chosen(rows, n, exact_first, bucket)
    if any(x is not None for x in among):
        rows = stored(rows, "neighbours")  # once, for the look-ups and for what follows
    for n in range(len(sources)):
        rows = nearest(rows, n, limit, bucket, among[n])
    if mode in ("window", "exact_then_window"):
        rows = rows.join(window_totals(rows, sources, window_seconds, alike), "__pid", "left")
    for n, s in enumerate(sources):
        found = F.col(f"__found{n}")
        cells, distance, anomalies, count = found["cells"], found["d"], found["anomalies"], F.lit(1).cast("long")
        how = F.when(found["hit"], "exact").otherwise("bucket" if mode == "resample" else "near")
        spare = [f"__found{n}"]
        if f"rows{n}" in rows.columns:
            if alike:
                away = F.col(f"away{n}")
            else:
                exact_away = distances(primary, s, window_seconds).withColumnRenamed("away", f"__away{n}")
                rows, away = rows.join(exact_away, ["__key", "__ts"], "left"), F.col(f"__away{n}")
                spare.append(f"__away{n}")
            if s.texts:
                rows = rows.join(votes(primary, s, window_seconds).withColumnRenamed("votes", f"__votes{n}"), ["__key", "__ts"], "left")
                spare.append(f"__votes{n}")
            exact = found["hit"]
            cells = F.when(exact, cells).otherwise(F.struct(*(_window_cell(s, n, i).alias(f"c{i}") for i in s.kinds)) if s.columns else cells)
            distance = F.when(exact, distance).otherwise(F.floor(away / F.col(f"rows{n}")))
            anomalies, count, how = F.when(exact, anomalies).otherwise(F.col(f"anomalies{n}")), F.col(f"rows{n}"), F.when(exact, "exact").otherwise("window")
            spare += [f"rows{n}", f"away{n}", f"anomalies{n}", *(f"mean{n}_{i}" for i in s.averaged)]
        m = F.struct(cells.alias("cells"), distance.cast("long").alias("distance"), anomalies.cast("long").alias("anomalies"), how.alias("how"), count.alias("rows"))
        rows = rows.withColumn(f"__m{n}", F.when(found.isNotNull(), m)).drop(*spare)
    return rows


def _window_cell(s: Source, n: int, i: int) -> Column:
    """The mean of the window's numbers; of texts the word of most weight; else the nearest row's cell."""
    first = F.col(f"__found{n}")["cells"][f"c{i}"]
    if i in s.texts:
        return F.coalesce(F.col(f"mean{n}_{i}").cast("string"), F.col(f"__votes{n}")[F.lit(i)], first)
    return F.coalesce(F.col(f"mean{n}_{i}").try_cast(s.kinds[i]), first) if i in s.averaged else first
