"""An ordered table: a DataFrame with the order of its rows kept as hidden key columns. It stays lazy but for positions,
for which rows are written in their order."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "__"
_own: dict[str, str] = {}


@dataclass(frozen=True)
class Key:
    """A hidden column that rows are ordered by."""

    name: str
    ascending: bool = True
    nulls_first: bool = True

    @property
    def sort(self) -> Column:
        c = F.col(self.name)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. A local master may do without: it gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[app] = folder
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the folder that the cluster shares, and read back: rows are computed once, and a lost executor costs no more than a read."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


RUN_BYTES = 256 << 20


def run_count(df: DataFrame) -> int:
    """Into how many runs rows are dealt: as many as shuffles have partitions, or more if the files read are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 55)  # what is read from no file has no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // RUN_BYTES))


@dataclass(frozen=True)
class Table:
    """df: visible columns and hidden ones, whose names begin with two underscores. order: the keys of the row order,
    the last of which tell all rows apart. labels: logical types that a user gave to columns."""

    df: DataFrame
    order: tuple[Key, ...]
    labels: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, *keys: str) -> Table:
        """df in the order of columns that tell its rows apart."""
        hidden = [Key(f"__o{i}") for i in range(len(keys))]
        return cls(df.withColumns({h.name: F.col(k) for h, k in zip(hidden, keys, strict=True)}), tuple(hidden))

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> Table:
        """Parquet in the order of its files, by path, and of the rows in each."""
        df = spark.read.parquet(path)
        cols = df.columns
        df = df.select(*cols, F.col("_metadata.file_path").alias("__o0"), F.col("_metadata.row_index").alias("__o1"))
        return cls(df, (Key("__o0"), Key("__o1")))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def sort(self) -> list[Column]:
        return [k.sort for k in self.order]

    def require(self, *names: str) -> None:
        missing = [n for n in names if n not in self.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def with_column(self, name: str, c: Column) -> Table:
        return self.with_df(self.df.withColumn(name, c))

    def select(self, names: list[str]) -> Table:
        return self.with_df(self.df.select(*names, *(c for c in self.df.columns if c.startswith(HIDDEN))))

    def filter(self, c: Column) -> Table:
        return self.with_df(self.df.filter(c))

    def sorted_by(self, keys: list[tuple[Column, bool, bool]]) -> Table:
        """A new order by (value, ascending, nulls first); rows that tie keep their order. No row moves before the
        order is needed: by a position, a window or a writer."""
        n = sum(c.startswith("__k") for c in self.df.columns)
        new = [Key(f"__k{n + i}", asc, first) for i, (_, asc, first) in enumerate(keys)]
        df = self.df.withColumns({k.name: c for k, (c, _, _) in zip(new, keys, strict=True)})
        return replace(self, df=df, order=(*new, *self.order))

    @property
    def parts(self) -> list[Column]:
        """`sort` with the fields of structs one by one, which Spark compares faster."""
        out = []
        for k in self.order:
            f = self.df.schema[k.name]
            if isinstance(f.dataType, T.StructType) and k.ascending and k.nulls_first:
                whole = [F.col(k.name).isNotNull()] if f.nullable else []  # no struct comes before one of nulls
                out += [*whole, *(F.col(k.name)[x].asc_nulls_first() for x in f.dataType.names)]
            else:
                out.append(k.sort)
        return out

    def window(self, *groups: Column | str) -> Window:
        return Window.partitionBy(*groups).orderBy(*self.sort)

    def numbered(self) -> DataFrame:
        """df with __pos, the position of each row from 1, and __part, a run of positions. Rows are dealt to runs by
        range, sorted and written once, each with its number in its run; the runs' lengths, one short row for each, give
        where each starts. So no task sees more than its share of rows, and they move only once."""
        drop = [c for c in ("__pos", "__part") if c in self.df.columns]
        placed = self.df.drop(*drop).repartitionByRange(run_count(self.df), *self.parts).sortWithinPartitions(*self.parts)
        # An id that Spark gives has the partition in its high bits and the row's number there in the low 33.
        placed = stored(placed.withColumn("__id", F.monotonically_increasing_id()), "ordered")
        placed = placed.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__rn": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("__id")
        lengths = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        starts = lengths.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
        rows = placed.join(F.broadcast(stored(starts, "run-starts")), "__part")  # one row for each run
        return rows.withColumn("__pos", F.col("__start") + F.col("__rn")).drop("__rn", "__start")

    def rows(self) -> DataFrame:
        """The visible columns, in no order."""
        return self.df.select(*self.columns)

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.sort).select(*self.columns)


def in_blocks(numbered: DataFrame, reach: int, size: int = 100_000) -> DataFrame:
    """Numbered rows in blocks of positions, each with copies (__copy) of the `reach` rows before it, so that a window
    over a block sees what a window over the whole table would."""
    size = max(size, 2 * reach)
    block = F.floor((F.col("__pos") - 1) / size)
    last = F.floor((F.col("__pos") - 1 + reach) / size)
    rows = numbered.withColumn("__block", F.explode(F.sequence(block, last)))
    return rows.withColumn("__copy", F.col("__block") > block)


def _key(keys: list[Column]) -> Column:
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))


def _run_ends(numbered: DataFrame, key: Column, before=None, after=None) -> DataFrame:
    """One row for each run of rows numbered in an order that begins with their key: __part, __first and __last, the keys
    that it begins and ends with, __out, what `before` (from a condition to an aggregate) makes of its rows of the last
    key, and __back, what `after` makes of those of the first. Only rows of these two keys are aggregated; stored."""
    places = numbered.groupBy("__part").agg(F.min("__pos").alias("__lo"), F.max("__pos").alias("__hi"))
    rows = numbered.withColumn("__run_key", key)
    edges = rows.join(F.broadcast(places), "__part").filter("__pos = __lo or __pos = __hi").groupBy("__part").agg(F.min_by("__run_key", "__pos").alias("__first"), F.max_by("__run_key", "__pos").alias("__last"))
    begins, closes = (F.col("__run_key").eqNullSafe(F.col(c)) for c in ("__first", "__last"))
    rows = rows.join(F.broadcast(edges), "__part").filter(begins | closes)
    made = [f(x).alias(name) for name, f, x in (("__out", before, closes), ("__back", after, begins)) if f]
    return stored(rows.groupBy("__part").agg(F.first("__first").alias("__first"), F.first("__last").alias("__last"), *made), "run-ends")


def _handed_on(ends: DataFrame, combine, forward: bool) -> DataFrame:
    """ends: of `_run_ends`. (__part, __run_key, __before) for the key that each run begins (backward: ends) with: what
    `combine` makes of the values that the runs before it hand on for that key. One row for each run, however the keys
    are spread."""
    made, out, asks = ("__out", "__last", "__first") if forward else ("__back", "__first", "__last")
    told = ends.select("__part", F.col(out).alias("__run_key"), F.col(made).alias("__end"), F.lit(False).alias("__asks"))
    asked = ends.select("__part", F.col(asks).alias("__run_key"), F.lit(None).cast(ends.schema[made].dataType).alias("__end"), F.lit(True).alias("__asks"))
    # Within a run the question comes before the answer, so a run does not answer itself.
    w = Window.partitionBy("__run_key").orderBy(F.col("__part").asc() if forward else F.col("__part").desc(), F.col("__asks").desc())
    return told.unionByName(asked).withColumn("__before", combine("__end", w.rowsBetween(Window.unboundedPreceding, -1))).filter("__asks").select("__part", "__run_key", "__before")


def carried(numbered: DataFrame, values: dict[str, Column], keys: list[Column] = (), forward: bool = True) -> DataFrame:
    """Adds columns: of each value, the last that is not null up to the row among the rows of its key, or the first
    from it on. The numbering must begin with the keys."""
    return carried_both(numbered, values if forward else {}, {} if forward else values, keys)


def carried_both(numbered: DataFrame, before: dict[str, Column], after: dict[str, Column], keys: list[Column] = ()) -> DataFrame:
    """Adds `before`, values carried forward, and `after`, values carried backward. Runs are filled each on their own,
    so the rows of one key may be dealt over many tasks; what a run hands on is one row. Rows move once, and values that
    are columns are not copied before."""
    ways = {True: list(before.values()), False: list(after.values())}

    def ends(forward: bool):
        pick = F.max_by if forward else F.min_by
        return lambda of: F.struct(*(pick(v, F.when(of & v.isNotNull(), F.col("__pos"))).alias(f"v{i}") for i, v in enumerate(ways[forward])))

    made = _run_ends(numbered, _key(list(keys)), *(ends(x) if ways[x] else None for x in (True, False)))
    out, spare = numbered, []
    for forward, names in ((True, list(before)), (False, list(after))):
        if not names:
            continue
        of, handed = f"__of{forward:d}", f"__handed{forward:d}"
        inside = Window.partitionBy("__part", *keys).orderBy(F.col("__pos").asc() if forward else F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumns({f"__i{forward:d}{i}": F.last(v, ignorenulls=True).over(inside) for i, v in enumerate(ways[forward])})
        combine = lambda end, w: F.struct(*(F.last(F.col(end)[f"v{i}"], ignorenulls=True).over(w).alias(f"v{i}") for i in range(len(names))))  # noqa: B023, E731
        spare += [of, handed, *(f"__i{forward:d}{i}" for i in range(len(names)))]
        out = out.join(F.broadcast(_handed_on(made, combine, forward).select("__part", F.col("__run_key").alias(of), F.col("__before").alias(handed))), "__part", "left")  # one row for each run
    for forward, names in ((True, list(before)), (False, list(after))):
        of, handed = (F.col(f"__{x}{forward:d}") for x in ("of", "handed"))
        out = out.withColumns({name: F.coalesce(f"__i{forward:d}{i}", F.when(of.eqNullSafe(_key(list(keys))), handed[f"v{i}"])) for i, name in enumerate(names)})
    return out.drop(*spare)


def running_sums(numbered: DataFrame, values: dict[str, Column], keys: list[Column] = ()) -> DataFrame:
    """Adds the sums of the values over the rows of the key up to each row; each null until its first value."""
    n = range(len(values))
    key, columns = _key(list(keys)), list(values.values())
    inside = Window.partitionBy("__part", *keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    combine = lambda end, w: F.struct(*(F.sum(F.col(end)[f"v{i}"]).over(w).alias(f"v{i}") for i in n))
    ends = _run_ends(numbered, key, lambda of: F.struct(*(F.sum(F.when(of, v)).alias(f"v{i}") for i, v in enumerate(columns))))
    before = _handed_on(ends, combine, True).select("__part", F.col("__run_key").alias("__of"), "__before")
    df = numbered.withColumns({f"__in{i}": F.sum(v).over(inside) for i, v in enumerate(columns)}).join(F.broadcast(before), "__part", "left")
    was = lambda i: F.when(F.col("__of").eqNullSafe(key), F.col("__before")[f"v{i}"])
    df = df.withColumns({name: F.when(F.col(f"__in{i}").isNull(), was(i)).otherwise(F.when(was(i).isNull(), F.col(f"__in{i}")).otherwise(F.col(f"__in{i}") + was(i))) for i, name in enumerate(values)})
    return df.drop("__of", "__before", *(f"__in{i}" for i in n))


def running_sum(numbered: DataFrame, name: str, value: Column, keys: list[Column] = ()) -> DataFrame:
    """Adds the sum of the value over the rows of the key up to each row; null until the first value."""
    return running_sums(numbered, {name: value}, keys)


def at_positions(t: Table, value: Column, keys: list[Column], at) -> DataFrame:
    """One row per key, k0, k1 and so on, with n (its values that are not null) and what `at(n)`, a dict of names and
    places from 0, picks from its values in ascending order. A value of very many rows is counted first, and the
    values are numbered in runs, so that neither a key's rows nor its distinct values meet in one task."""
    keys = keys or [F.lit(0)]
    names = [f"k{i}" for i in range(len(keys))]
    rows = t.df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), value.alias("v")).filter("v is not null")
    counted = rows.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("c"))
    numbered = Table(counted, tuple(Key(x) for x in (*names, "v"))).numbered()
    upto = running_sum(numbered, "upto", F.col("c"), [F.col(n) for n in names])
    total = upto.groupBy(*names).agg(F.max("upto").alias("n"))
    both = upto.join(total, names)  # which Spark can split where a key is large
    places = at(F.col("n"))
    picks = [F.min(F.when((F.col("upto") - F.col("c") <= p) & (p < F.col("upto")), F.col("v"))).alias(name) for name, p in places.items()]
    return both.groupBy(*names, "n").agg(*picks)


def quantile(low: str, high: str, n: Column, q: float) -> Column:
    """The quantile between two values at the places floor and ceil of q * (n - 1)."""
    place = (n - 1) * F.lit(q)
    return F.col(low) + (F.col(high) - F.col(low)) * (place - F.floor(place))
