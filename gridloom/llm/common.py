"""What the operators of this subpackage share: tables, intermediate results and word counting."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A local master may do without: it gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


_shipped: set[str] = set()


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package sent to the executors, once for each application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name))
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)


class Written:
    """A result written as Parquet to the shared folder, so that a lost executor costs no recomputation of what led to it."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    return Written(df, tag).df


def free_prefix(df: DataFrame) -> str:
    """Underscores with which no column of df begins, so that names made with them clash with none."""
    longest = max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return "_" * max(2, longest + 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; of the empty text for null."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def spread_buckets(count: int) -> int:
    """How many hash buckets a running number over `count` rows is split into: about the root, so that neither a bucket nor the list of buckets grows as the rows do."""
    return max(64, 4 * math.isqrt(count))


def starts_before(df: DataFrame, group: list[str], at: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of its group whose `at`, a number given once in a group, is less.
    Sums run within spans of `at`, and the spans' sums over the group, so that no group meets in one task."""
    df = df.withColumn("__span", F.expr(f"{at} div {span}"))
    spans = df.groupBy(*group, "__span").agg(F.sum(value).alias("__sum"))
    spans = spans.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*group, "__span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(spans, [*group, "__span"])
    return df.withColumn(out, F.col(out) + F.col("__before")).drop("__span", "__before")


def copied(df: DataFrame, copies: str, number: str, most: int, chunk: int = 4096) -> DataFrame:
    """Each row as often as its `copies`, which are `most` at most, with `number` from 0. Rows of very many copies are
    dealt over tasks in chunks."""
    if most <= 1:
        return df.withColumn(number, F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    if most > chunk:
        df = df.select("*", F.explode(F.sequence(zero, F.expr(f"({copies} - 1) div {chunk}"))).alias("__chunk"))
        df = df.repartition(*(F.col(c) for c in df.columns))
    else:
        df = df.withColumn("__chunk", zero)
    last = F.least(F.col("__chunk") * chunk + chunk, F.col(copies)) - 1
    return df.select("*", F.explode(F.sequence(F.col("__chunk") * chunk, last)).alias(number)).drop("__chunk")


def least_by_hash(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, those with the least hash of the key: the same for any partitioning. Rows whose hash is
    far too large are left out first, so that no more than about twice `limit` rows meet in one task."""
    rows = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(F.col(key)), 1))
    n = rows.count()
    if n > 4 * limit:
        rows = rows.filter(F.col("__hash") < F.lit(int(2**63 * 2 * limit / n)))
    return rows.orderBy("__hash", key).limit(limit).drop("__hash")
