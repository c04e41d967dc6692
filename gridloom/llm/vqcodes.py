"""Compression of vectors into codes: each part of a vector becomes the number of its nearest codebook entry.

Components are integers, so distances, sums and codebooks are exact and agree on any partitioning. The nearest entry is
found from coarse to fine. A part and an entry are cut alike into segments; with m and r the mean and the residual
norm of a segment of length L, the squared distance is at least the sum over segments of L * (m - m')^2 + (r - r')^2,
that is, the squared distance of two short vectors of 2 numbers a segment. One segment bounds all entries at once; the
entries that stay under the best distance known are bounded again with 2, 4 and then 8 segments, and what still stays gets
its exact integer distance. Bounds are lowered by more than rounding can raise them, so no nearest entry is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SEGMENTS = (1, 2, 4, 8)
#: Bounds are lowered by this share of the lengths they come from, far more than rounding adds. Up to DENSE of all pairs are bounded one by one.
SLACK, DENSE = 1e-9, 0.1
#: Rows bounded at once; labels whose sums are broadcast (a long or two each), beyond which they are merge-joined.
CHUNK, FEW_LABELS = 2048, 100_000


def means_and_residuals(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row the scaled mean and the residual norm of each segment: short vectors no farther apart than the rows."""
    out = []
    for part in np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1)
        out += [mean * math.sqrt(part.shape[1]), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Where each row's pairs begin; no row is without one."""
    return np.flatnonzero(np.diff(rows, prepend=-1))


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


class Codebook:
    """The entries of one part position, and what bounds distances to them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [means_and_residuals(entries, s) for s in SEGMENTS]
        self.sizes = [_squares(g) for g in self.levels]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the entry of least squared distance, the first of several, and that distance."""
        code, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), CHUNK):
            code[at : at + CHUNK], distance[at : at + CHUNK] = self._nearest(x[at : at + CHUNK])
        return code, distance

    def exact(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return _squares(x[rows] - self.entries[entries])

    def survivors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows and entries, in order, that the bounds leave. While many are left a level bounds all pairs in
        one product, then only those left."""
        every, pairs = np.arange(len(x)), None
        best = np.full(len(x), np.iinfo(np.int64).max)
        for segments, theirs, size in zip(SEGMENTS, self.levels, self.sizes, strict=True):
            short = means_and_residuals(x, segments)
            slack = SLACK * (_squares(short) + size.max()) + 1e-6
            if pairs is None:
                bound = (_squares(short) - slack)[:, None] + size - 2 * short @ theirs.T
                best = np.minimum(best, self.exact(x, every, bound.argmin(axis=1)))  # the entry of least bound may well be the nearest
                left = bound <= best[:, None]
                if left.mean() <= DENSE or segments == SEGMENTS[-1]:
                    pairs = np.nonzero(left)
            else:
                rows, entries = pairs
                bound = _squares(short[rows] - theirs[entries]) - slack[rows]
                hit = np.flatnonzero(bound == np.minimum.reduceat(bound, _firsts(rows))[rows])
                np.minimum.at(best, rows[hit], self.exact(x, rows[hit], entries[hit]))
                keep = bound <= best[rows]
                pairs = rows[keep], entries[keep]
        return pairs

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, entries = self.survivors(x)
        distance = self.exact(x, rows, entries)
        least = np.minimum.reduceat(distance, _firsts(rows))
        hit = np.flatnonzero(distance == least[rows])[::-1]  # of equal ones the first is written last
        code = np.zeros(len(x), np.int64)
        code[rows[hit]] = entries[hit]
        return code, least


def largest_component(width: int) -> int:
    """Components are held within this, so that a vector's squared distance fits 63 bits: 2^27 for 64 of them, so that
    none below 131,072 before scaling is touched."""
    return math.isqrt((1 << 60) // max(1, width))


def _parts(column: pa.Array, width: int, parts: int) -> list[np.ndarray]:
    """Rows of integers, with zeros up to the width, cut into parts."""
    most = largest_component(width)
    x = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    x[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(np.clip(x, -most, most), parts, axis=1)


def kept_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints, the components as floor(scale * x), of all vectors that are whole."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return embeddings.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("ints"))


def _moved(vectors: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the mean, rounded down, of the parts nearest to it; unused ones stay.
    A task sends a row for each entry it has used; sums of all entries, a bounded table, reach the driver."""
    each = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Codebook(b) for b in books]
        n = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((*n.shape, each), np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch.column("ints"), width, len(books))):
                code, _ = lists[p].nearest(x)
                n[p] += np.bincount(code, minlength=n.shape[1])
                np.add.at(sums[p], code, x)
        part, entry = np.nonzero(n)
        lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * each), pa.array(sums[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists_of], names=["part", "entry", "n", "sums"])

    found = map_arrow(vectors.select("ints"), run, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(each)))
    new = [b.copy() for b in books]
    for r in total.collect():  # one row for each entry of the codebooks at most
        new[r.part][r.entry] = np.array(r[3:], np.int64) // r.n
    return new


def trained(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, which begin as the parts of the vectors of least vec_id (null ids last; of equal ids the lesser
    components first). Of fewer vectors than entries each is one."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = _parts(pa.array([r.ints for r in seeds], pa.list_(pa.int64())), width, parts)
    for _ in range(rounds):
        books = _moved(vectors, books, width)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits for each part) and error of every vector that is whole, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. Vectors of another width than the widest,
    or of a width that the parts do not divide, count as followed by zeros. Repeated rows are rows of their own; null
    ids and labels stay null; an empty table gives no rows and codebooks without entries."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    vectors = written(kept_vectors(embeddings, scale), "integer-vectors")
    width = -(-max(1, vectors.agg(F.max(F.size("ints"))).first()[0] or 1) // parts) * parts
    books = trained(vectors, width, parts, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Codebook(b) for b in books]
        for batch in batches:
            found = [book.nearest(x) for book, x in zip(lists, _parts(batch.column("ints"), width, parts), strict=True)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * parts
            codes = [code[k : k + step] for k in range(0, len(code), step)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return map_arrow(vectors, run, f"vec_id long, label {label}, code string, error long"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together; a sum beyond a long is the largest one."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = written(codes.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "__of")
    few = sums.count() <= FEW_LABELS
    # Beyond that Spark splits a label of very many rows where the two sides are merged.
    return codes.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("__of")), "left").drop("__of")


def op12_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector. Null vectors and those with null or
    non-finite components are left out; other cases as in `compressed`; an empty table gives no rows; columns of other
    names are not read."""
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    codes = written(codes, "vector-codes")
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def codebook_sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, by all distances, for vectors of one width."""
    each = width // parts
    ks = range(each)
    cols = ", ".join(f"x{k}" for k in ks)
    with_ = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p AS part, {', '.join(f'ints[p * {each} + {k + 1}] AS x{k}' for k in ks)} FROM kept, range({parts}) AS r(p))",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries})",
        f"book0 AS MATERIALIZED (SELECT part, entry, {cols} FROM cut JOIN seeds USING (vec_id))",
    ]
    apart = " + ".join(f"(c.x{k} - b.x{k}) * (c.x{k} - b.x{k})" for k in ks)
    for r in range(rounds + 1):
        with_.append(f"near{r} AS MATERIALIZED (SELECT c.vec_id, c.part, any_value(c.label) AS label, min(({apart}) * 256 + b.entry) AS v FROM cut c JOIN book{r} b USING (part) GROUP BY c.vec_id, c.part)")
        if r < rounds:
            means = ", ".join(f"CAST(floor(sum(c.x{k}) / count(*)) AS BIGINT) AS x{k}" for k in ks)
            with_.append(f"mean{r} AS (SELECT c.part, n.v % 256 AS entry, {means} FROM cut c JOIN near{r} n USING (vec_id, part) GROUP BY ALL)")
            with_.append(f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, {', '.join(f'coalesce(m.x{k}, b.x{k}) AS x{k}' for k in ks)} FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))")
    last = rounds
    with_.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(v % 256 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(v // 256) AS BIGINT) AS error FROM near{last} GROUP BY vec_id)")
    with_.append(f"told AS (SELECT sha256(string_agg(concat_ws(',', {cols}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last})")
    return "WITH " + ", ".join(with_) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, told"
