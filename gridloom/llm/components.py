"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, map_arrow, written

#: Edges that a task contracts at once.
CONTRACTED = 400_000


def contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """edges (u, v) with each task's share replaced by stars around the least ids that it connects; and whether one
    task had them all, so that these are the components."""
    edges = written(edges, "edges")
    tasks = max(1, -(-edges.count() // CONTRACTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if not parts:
            return
        ids, ends = np.unique(np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)]), return_inverse=True)
        u, v = np.split(ends, 2)
        least = np.arange(len(ids))
        while True:  # the least neighbour, and that one's, until nothing changes
            new = least.copy()
            np.minimum.at(new, u, least[v])
            np.minimum.at(new, v, least[u])
            np.minimum.at(new, least[u], new[u])
            np.minimum.at(new, least[v], new[v])
            new = new[new]
            if (new == least).all():
                break
            least = new
        far = np.flatnonzero(least != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[least[far]])], names=["u", "v"])

    return map_arrow(edges.coalesce(tasks), run, "u long, v long"), tasks == 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with an edge to another; component is the least id of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) turn each component into a star around its least
    id in a number of rounds that grows as the logarithm of its diameter. Each round is written to the shared folder,
    so lineage stays short. Nodes with very many edges meet their least neighbour in a join that Spark can split.
    Before the first round each task contracts the edges it reads; where one task reads all, no round is left.
    """
    pairs, done = contracted(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u != v"))
    if done:
        return _named(written(pairs, "stars"))
    now = Written(pairs.distinct(), "edges")
    state = _state(now.df)
    while state[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now.drop()
        before, now, state = state, new, _state(new.df)
        if state == before:
            break
    return _named(now.df)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) that result from those given once links (a, b) are added. Only the links' ends
    and the components they join take part in the search."""
    ends = links
    for c in ("a", "b"):
        known = components.select(F.col("id").alias(c), F.col("component").alias("of"))
        ends = ends.join(known, c, "left").withColumn(f"{c}0", F.coalesce("of", c)).drop("of")
    wider = connected_components(ends.select(F.col("a0").alias("a"), F.col("b0").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("least"))
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    new = ids.join(components, "id", "left_anti").withColumn("component", F.col("id"))
    return components.unionByName(new).join(wider, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
