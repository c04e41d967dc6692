"""Near-duplicate embeddings by cross-polytope hashing.

A unit vector is turned by pseudorandom rotations (three rounds of random signs and a fast Hadamard transform); its
hash is the nearest signed axis. A table's bucket is the pair of two such hashes. A vector lies in its own bucket and
probes those that take the second nearest axis in either place. Pairs with the same label that meet where at least one
of them lies are candidates. Those whose 256-bit sign sketches differ in more bits than a pair at the threshold would
with any likelihood (7.5 standard deviations) are dropped, so that hardly any vector travels for a chance candidate;
the cosine of all others is computed in double precision.

A pair counts in the first bucket, by table, in which it meets, so that the links of large buckets are counted where
they are found: a dense group of n vectors has n * n links, of which none is written.

At cosine 0.93 in 64 dimensions a table brings a pair together with probability 0.66, so 12 tables miss 3 pairs in a
million; nearer pairs, and so nearly all, are missed still more rarely.

Rotations of two to four dimensions give only a handful of directions, so that neither buckets nor sketches hold
there. Vectors of up to NARROW components are compared with all of their label and width, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .components import connected_components

TABLES, HASHES, BITS = 12, 2, 256
#: Members of a bucket whose pairs are listed; those of larger buckets are compared in blocks of about this many.
LISTED, BLOCK = 32, 512
NARROW = 4
_ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def padded(unit: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two."""
    x = np.zeros((len(unit), 1 << max(1, (unit.shape[1] - 1).bit_length())))
    x[:, : unit.shape[1]] = unit
    return x


def codes(unit: np.ndarray, seed: int = 17) -> np.ndarray:
    """(row, table, 4): the bucket each row lies in, then those it probes. Rows are padded with zeros to a power of two."""
    x = padded(unit)
    width = x.shape[1]
    rng = np.random.default_rng([seed, width])
    out = np.zeros((len(x), TABLES, 4), np.int64)
    for t in range(TABLES):
        near = []
        for _ in range(HASHES):
            y = rotated(x, rng)
            axis = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(y, axis, 1)
            swap = np.abs(value[:, 0]) < np.abs(value[:, 1])
            axis[swap], value[swap] = axis[swap][:, ::-1], value[swap][:, ::-1]
            near.append(axis * 2 + (value < 0))
        for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            out[:, t, k] = near[0][:, i] * (2 * width) + near[1][:, j]
    return out


def rotated(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for signs in rng.choice([-1.0, 1.0], size=(_ROUNDS, x.shape[1])):
        x = hadamard(x * signs)
    return x


def sketches(unit: np.ndarray, seed: int = 29) -> np.ndarray:
    """(row, 4): 256 signs of rotated coordinates, as four 64-bit integers."""
    x = padded(unit)
    rng = np.random.default_rng([seed, x.shape[1]])
    y = np.concatenate([rotated(x, rng) for _ in range(-(-BITS // x.shape[1]))], axis=1)[:, :BITS]
    return np.packbits(y < 0, axis=1).view("<i8")


def differing_bits(least: float) -> int:
    """Bits in which two sketches may differ: at angle a each does with probability a / pi."""
    p = float(np.arccos(min(1.0, max(-1.0, least))) / np.pi)
    return int(BITS * p + 7.5 * np.sqrt(BITS * p * (1 - p)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one width as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rows_of_width(column: pa.Array) -> Iterator[np.ndarray]:
    width = np.diff(column.offsets.to_numpy())
    for w in np.unique(width):
        yield np.flatnonzero(width == w)


def bucket_rows(vectors: DataFrame) -> DataFrame:
    """A row per vector, table and bucket: bucket, table, code, rep, own (it lies there)."""
    rows = vectors.select("label", F.size("embedding").alias("width"), "rep", F.posexplode("codes").alias("at", "code"))
    rows = rows.withColumn("table", F.expr("cast(at div 4 AS int)"))
    return rows.select(_bucket().alias("bucket"), "table", "code", "rep", (F.col("at") % 4 == 0).alias("own"))


def _bucket() -> Column:
    return F.xxhash64("label", "width", "table", "code")


def with_hashes(classes: DataFrame) -> DataFrame:
    """classes (label, embedding, rep, copies) with sketches s0 to s3 and the codes of all tables, four for each; narrow
    vectors have no codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for rows in _rows_of_width(part.column("embedding")):
                    some = part.take(pa.array(rows))
                    x = _matrix(some.column("embedding"))
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    bits = sketches(unit)
                    lists = pa.nulls(len(x), pa.list_(pa.int64()))
                    if x.shape[1] > NARROW:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (4 * TABLES)), pa.array(codes(unit).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), lists], names=[*some.schema.names, "s0", "s1", "s2", "s3", "codes"])

    return map_arrow(classes.select("label", "embedding", "rep", "copies"), run, "label long, embedding array<double>, rep long, copies long, s0 long, s1 long, s2 long, s3 long, codes array<long>")


def _codes_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES, 4)


def first_meeting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of codes, row by row, the first table in which they meet where one of them lies, and that bucket's
    code, the lesser if there are two; table -1 if they never meet."""
    a, b = (x[:, :, :1] == y).any(axis=2), (y[:, :, :1] == x).any(axis=2)
    table = (a | b).argmax(axis=1)
    row = np.arange(len(x))
    a, b, mine, theirs = a[row, table], b[row, table], x[row, table, 0], y[row, table, 0]
    code = np.where(a & b, np.minimum(mine, theirs), np.where(a, mine, theirs))
    return np.where(a | b, table, -1), code


def listed_links(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of one label and width whose cosine is `least` or more, and the bucket in which they meet first."""
    side = lambda x: vectors.select(F.col("rep").alias(x), *(F.col(f"s{k}").alias(f"{x}{k}") for k in range(4)))
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(4)), F.lit(0))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(differ <= differing_bits(least)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for rows in _rows_of_width(part.column("ea")):
                    some = part.take(pa.array(rows))
                    x, y = _matrix(some.column("ea")), _matrix(some.column("eb"))
                    some = some.filter(pa.array(cosine(x, y) >= least))
                    t, c = first_meeting(_codes_of(some.column("ca")), _codes_of(some.column("cb")))
                    width = pa.array(np.full(len(t), x.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), some.column("la"), width, pa.array(t.astype(np.int32)), pa.array(c)], names=["a", "b", "label", "width", "table", "code"])

    left = vectors.select(F.col("rep").alias("a"), F.col("embedding").alias("ea"), F.col("label").alias("la"), F.col("codes").alias("ca"))
    right = vectors.select(F.col("rep").alias("b"), F.col("embedding").alias("eb"), F.col("label").alias("lb"), F.col("codes").alias("cb"))
    rows = pairs.join(left, "a").join(right, "b").filter((F.col("la") == F.col("lb")) & (F.size("ea") == F.size("eb")))
    found = map_arrow(rows.select("a", "b", "la", "ea", "eb", "ca", "cb"), run, "a long, b long, label long, width int, table int, code long")
    return found.select("a", "b", _bucket().alias("bucket"))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for (x, y) and (y, x)."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _components(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the first node of its component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] < 0:
            root[k] = k
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = k
    return root


def block_links(members: DataFrame, pieces: int, least: float) -> DataFrame:
    """Links within large buckets. members: bucket, n, table, code, rep, copies, own, label, embedding, codes. Members
    are dealt at random into blocks of about BLOCK; each pair of blocks is a piece of work of its own. A pair counts in
    the bucket where it meets first, whatever other buckets it shares. Links stay in their piece, of which there are as
    many as pairs; what leaves it is one row for each vector with links, n (how many vectors it is linked with), and one
    (a, b) that ties it to a vector of its component."""
    m = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    low = F.sequence(F.lit(0).cast("long"), F.col("block"))
    high = F.sequence(F.col("block"), F.col("blocks") - 1)
    columns = ["table", "code", "rep", "copies", "own", "label", "embedding", "codes"]
    as_first = m.select("bucket", F.col("block").alias("i"), F.explode(high).alias("j"), F.lit(0).alias("side"), *columns)
    as_second = m.select("bucket", F.explode(low).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *columns).filter("i < j")

    def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray) -> np.ndarray:
        dot = ux @ uy.T
        near = dot >= least + 1e-9
        p, q = np.nonzero((dot >= least - 1e-9) & ~near)  # too close to call without the exact value
        near[p, q] = cosine(x[p], y[q]) >= least
        return near

    def here_first(near: np.ndarray, cx: np.ndarray, cy: np.ndarray, table: int, code: int) -> np.ndarray:
        """Which of the pairs meet first in this bucket."""
        meet = lambda u: tuple(np.logical_or.reduce([f(u, k) for k in range(4)]) for f in (lambda u, k: cx[:, u, 0][:, None] == cy[:, u, k][None, :], lambda u, k: cx[:, u, k][:, None] == cy[:, u, 0][None, :]))
        for u in range(table):
            a, b = meet(u)
            near = near & ~(a | b)
        a, b = meet(table)
        mine, theirs = cx[:, table, 0][:, None], cy[:, table, 0][None, :]
        chosen = np.where(a & b, np.minimum(mine, theirs), np.where(a, mine, theirs))
        return near & (a | b) & (chosen == code)

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        side, table, code, rep, copies, label = (piece.column(c).to_numpy() for c in ("side", "table", "code", "rep", "copies", "label"))
        embedding, lists = piece.column("embedding").combine_chunks(), piece.column("codes").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = np.diff(embedding.offsets.to_numpy())
        kinds = np.unique(np.stack([width, label, table, code], axis=1), axis=0)
        for w, lab, t, c in kinds.tolist():  # one, unless buckets share a hash
            rows = np.flatnonzero((width == w) & (label == lab) & (table == t) & (code == c))
            x = _matrix(embedding.take(pa.array(rows)))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            first = np.flatnonzero(side[rows] == 0)
            second = first if key[1].as_py() == key[2].as_py() else np.flatnonzero(side[rows] == 1)
            near = linked(x[first], x[second], unit[first], unit[second])
            near &= rep[rows[first]][:, None] != rep[rows[second]][None, :]
            p, q = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(p):
                continue
            near, first, second = near[np.ix_(p, q)], rows[first[p]], rows[second[q]]
            if t >= 0:
                near = here_first(near, _codes_of(lists.take(pa.array(first))), _codes_of(lists.take(pa.array(second))), t, c)
            nodes = np.concatenate([first, second])
            both = np.zeros((len(nodes), len(nodes)), bool)
            both[: len(first), len(first) :] = near
            root = _components(both | both.T)
            n = [near @ copies[second]]
            n.append(np.zeros(len(second), np.int64) if key[1].as_py() == key[2].as_py() else near.T @ copies[first])
            out.append((rep[nodes], rep[nodes[root]], np.concatenate(n)))
        a, b, n = (np.concatenate([np.zeros(0, np.int64), *o]) for o in (zip(*out, strict=True) if out else ([], [], [])))
        keep = (n > 0) | (a != b)
        return pa.table({"a": a[keep], "b": b[keep], "n": n[keep]})

    rows = as_first.unionByName(as_second)
    tasks = int(min(pieces, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces // 16)))
    return rows.repartition(max(1, tasks), "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty or zero, hold null or non-finite components, or have a null label link with nothing,
    nor do vectors of different length. Rows with a null vec_id take no part: no links, a null component, kept. Equal
    vectors of a label are compared once; rows that share a vec_id count as one vector. Other columns are not read; an
    empty table gives no rows.
    """
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.col("label").cast("long")).alias("label"), F.when(good, F.transform(x, lambda v: v.cast("double"))).alias("embedding"))
    classes = rows.filter("label is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = written(with_hashes(classes.filter(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v * v) < float("inf"))), "vectors")
    narrow = F.size("embedding") <= NARROW
    b = written(bucket_rows(classes.filter(~narrow)), "buckets")
    counts = written(b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).filter("n > 1 and any_own").select("bucket", "n"), "bucket-sizes")
    members = b.join(counts, "bucket")
    few = members.filter(F.col("n") <= LISTED).groupBy("bucket").agg(F.collect_list(F.struct("rep", "own")).alias("s"))
    few = few.select("s", F.explode("s").alias("x")).select("x", F.explode("s").alias("y")).filter("x.rep < y.rep and (x.own or y.own)").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    large = counts.filter(F.col("n") > LISTED)
    many = members.filter(F.col("n") > LISTED).join(classes.select("rep", "label", "embedding", "codes", "copies"), "rep")
    whole = classes.filter(narrow).select(F.xxhash64("label", F.size("embedding")).alias("bucket"), F.lit(-1).alias("table"), F.lit(0).cast("long").alias("code"), "rep", F.lit(True).alias("own"), "label", "embedding", "codes", "copies")
    sizes = whole.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = many.unionByName(whole.join(sizes, "bucket"))
    blocks = F.ceil(F.col("n") / BLOCK)
    pieces = large.select("n").unionByName(sizes.select("n")).agg(F.sum(blocks * (blocks + 1) / 2)).first()[0] or 0
    listed = written(listed_links(few, classes, least).join(large, "bucket", "left_anti").select("a", "b"), "links")
    found = written(block_links(many, int(pieces), least), "block-links") if pieces else None
    both = listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").select("a", F.col("copies").alias("n"))
    links = listed
    if found is not None:
        others, links = others.unionByName(found.select("a", "n")), links.unionByName(found.filter("a != b").select("a", "b"))
    others = others.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    component = connected_components(links).withColumnRenamed("id", "rep")
    of_class = classes.join(others, "rep", "left").join(component, "rep", "left").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row. Vectors that are null, zero or hold null or non-finite
    components, or whose label is null, link with nothing; equal rows and ids count as one vector; a null vec_id has a
    null component and is kept; an empty table gives no rows; other columns are not read."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
