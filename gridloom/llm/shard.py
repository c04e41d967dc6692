"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. On each level every child draws -ln(u) / weight from a
hash of the row's key and the child's name, and the least draw wins. A child's chance is its weight's share, and a
change of weights moves rows only into or out of the subtrees whose weights change, as all other draws stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import copied, spread_buckets, table, written


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 16, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """The first `base` shards fill `regions` regions of `racks` racks each. Every shard beyond them opens a region of
    its own, so that adding it changes no weight but its own subtree's and takes rows only into itself."""
    fill = min(n_shards, base)
    per_rack = -(-base // (regions * racks))
    leaves = [Leaf(i // (per_rack * racks), i // per_rack % racks, i) for i in range(fill)]
    return leaves + [Leaf(regions + i - base, 0, i) for i in range(base, n_shards)]


def unit_draw(key: list[Column], name: str) -> Column:
    """Uniform in (0, 1), decided by key and name."""
    return (F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def _least(key: list[Column], level: str, children: dict[int, float]) -> Column:
    """The child with the least weighted draw; ties, which two doubles hardly make, go to the smaller number."""
    draws = [F.struct((-F.log(unit_draw(key, f"{level}/{k}")) / F.lit(w)).alias("draw"), F.lit(k).alias("child")) for k, w in sorted(children.items())]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def _chosen(at: Column, parts: dict[int, Column]) -> Column:
    pairs = sorted(parts.items())
    return reduce(lambda acc, kv: acc.when(at == kv[0], kv[1]), pairs[1:], F.when(at == pairs[0][0], pairs[0][1]))


def tree_shard(df: DataFrame, key: list[str], leaves: list[Leaf], out: str, salt: str = "tree") -> DataFrame:
    """Adds the column `out`: the shard of each row's key. Leaves of no weight get no rows. A null key is a key like
    any other: all rows of it share a shard."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no leaf has a weight above 0")
    cols = [F.col(k) for k in key]
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[tuple[int, int], dict[int, float]] = {}
    for x in live:
        regions[x.region] = regions.get(x.region, 0) + x.weight
        racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0) + x.weight
        shards.setdefault((x.region, x.rack), {})[x.shard] = x.weight
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, _least(cols, f"{salt}/region", regions))
    df = df.withColumn(rack, _chosen(F.col(region), {r: _least(cols, f"{salt}/rack/{r}", c) for r, c in racks.items()}))
    in_rack = {
        r: _chosen(F.col(rack), {k: _least(cols, f"{salt}/shard/{r}/{k}", c) for (q, k), c in shards.items() if q == r})
        for r in racks
    }
    return df.withColumn(out, _chosen(F.col(region), in_rack).cast("int")).drop(region, rack)


def slots(df: DataFrame, group: str, order: list[str], copies: str, out: str, n_buckets: int) -> DataFrame:
    """Adds `out`: a number from 0 in each group, such that each row is followed by as many free numbers as it has
    copies beside itself. `order`: columns that tell all rows apart. Groups may be as large as they like: numbers are
    counted within hash buckets, and each bucket starts where the buckets before it in its group end."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(k) for k in order], F.lit("slot")), F.lit(n_buckets)).cast("int"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(group, "__bucket").agg(F.sum(copies).alias("__n"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before(group).orderBy("__bucket")), F.lit(0))).drop("__n")
    df = df.withColumn(out, F.coalesce(F.sum(copies).over(before(group, "__bucket").orderBy(*order)), F.lit(0)))
    return df.join(starts, [group, "__bucket"]).withColumn(out, (F.col(out) + F.col("__start")).cast("long")).drop("__bucket", "__start")


def shard_documents(docs: DataFrame, n_shards: int = 16, base: int = 16) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, law ('key'),
    shard, slot and grown_shard (the shard once there is one more).

    Nulls and ties: a null doc_id counts as one key, a null text as the empty text; equal rows get different slots.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Rows are counted where they lie, so that rows that are equal, even if they are most, make one.
    rows = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    count, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("copies"), F.lit(0))).first()
    rows = tree_shard(rows, ["doc_id"], topology(n_shards, base), "shard")
    rows = tree_shard(rows, ["doc_id"], topology(n_shards + 1, base), "grown_shard")
    rows = slots(rows, "shard", ["doc_id", "text_crc32", "size"], "copies", "slot", spread_buckets(count))
    rows = copied(rows, "copies", "copy", most)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
