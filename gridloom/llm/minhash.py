"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text's shingle set gives a signature of 160 minima. Texts with equal sets form a class, of which one document,
   that with the least id, stands for all.
2. Signatures are cut into 32 bands of 5; representatives that agree in a band are candidates. A pair with similarity
   0.8 agrees in no band with probability 3e-6.
3. A candidate pair's signatures are compared 32 minima at a time. With a uniform prior, the posterior of the
   similarity after m of n agreements is Beta(m+1, n-m+1); once the chance that it reaches the threshold is below the
   chosen miss probability, the pair is dropped. Survivors are verified on their full shingle sets.
4. Links give components. Only reachability is asked for, so pairs that are already connected are never compared:
   first each bucket's members are tried against the bucket's least id, then each member left is tried against its best
   partner in the bucket, then whatever pairs of a bucket still lie in different components are tried, all of them.
   Large buckets are compared in blocks of bounded size, in which the last step verifies too, so neither a bucket's
   pairs nor its members meet in one task. What shares large buckets with a large component is compared with that
   component as a whole, so its members travel once and not once for each bucket.
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
from .components import connected_components, joined
from .shingles import shared, shingle_set

HASHES, BANDS, BATCH = 160, 32, 32
ROWS = HASHES // BANDS
#: Members of a bucket whose pairs are listed; those of larger buckets are compared in blocks of about this many.
LISTED, BLOCK = 12, 512
SALTS = 64
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048] * _A + high[at : at + 2048] * _B).min(axis=1), out=out)
    return out


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of minima compared, 32, 64, ..., the fewest agreements with which a pair goes on. The posterior
    chance of a similarity above t after m of n agreements is that of at most m successes among n + 1 trials at t."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of signatures a and b survive, and how many minima those agree in."""
    rows, count = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        count = count + (a[rows, part] == b[rows, part]).sum(axis=1, dtype=np.int32)
        keep = count >= need
        rows, count = rows[keep], count[keep]
    return rows, count


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest of the shingle set (null if empty), n_shingles, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                digest, n, sig = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, k)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s).astype("<u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "digest", "n_shingles", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, digest binary, n_shingles long, signature binary")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) with percent of 100 or more of their shingles shared, on full sets. hot: as in `_dealt`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last:
                    last, known = ta, shingle_set(ta, k)
                other = shingle_set(tb, k)
                both = shared(known, other)
                keep.append(both > 0 and 100 * both >= percent * (len(known) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b")
    return map_arrow((rows.join(left, "a") if hot is None else _dealt(rows, left, hot)).select("a", "b", "ta", "tb"), run, "a long, b long")


#: Pairs of one bucket's first member that meet one copy of it.
PAIRS_OF_ONE = 4096


def _dealt(pairs: DataFrame, left: DataFrame, hot: DataFrame) -> DataFrame:
    """pairs (a, b, salt and more) joined to left (a and more), of which those in hot (a, salt from 1) have a copy for
    each salt, so that no row meets all pairs of a large bucket's first member."""
    copies = left.withColumn("salt", F.lit(0)).unionByName(left.join(hot, "a"))
    return pairs.join(copies, ["a", "salt"])


def promising(pairs: DataFrame, signatures: DataFrame, least: list[int], hot: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b, and salt if there is a table hot, as in `_dealt`) that the sequential test of their signatures
    leaves."""
    names = ["a", "b"] if hot is None else ["a", "b", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, _ = surviving(_signatures(batch.column("sa")), _signatures(batch.column("sb")), least)
                yield batch.select(names).take(pa.array(rows))

    left = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    met = pairs.join(left, "a") if hot is None else _dealt(pairs, left, hot)
    return map_arrow(met.join(right, "b").select(*names, "sa", "sb"), run, "a long, b long" + ", salt int" * (hot is not None))


def block_sides(left: DataFrame) -> DataFrame:
    """The work on large buckets. left: bucket, band, rep, component, main (the bucket's main component) of all members
    of buckets in which components differ. Groups (kind, band, group) of two sides result, with rep and component:

    * Kind 0: group is a main component, side 1 its members in such buckets, side 0 the members of other components
      that share such a bucket with it. Each member is listed once, however many buckets it shares. Band is -1.
    * Kind 1: group is a bucket, side 1 its main component, side 0 the other members. A main component whose buckets
      overlap little is compared so, as the first way would make more than twice as many pairs.
    * Kind 2: group is a bucket, and both sides are its members outside the main component.
    """
    side = F.when(F.col("component") == F.col("main"), 1).otherwise(0).alias("side")
    sided = left.select("bucket", "band", "main", side, "rep", "component")
    of = lambda k: F.count(F.when(F.col("side") == k, True))
    whole = sided.select("main", "side", "rep", "component").distinct()
    by_bucket = sided.groupBy("main", "bucket").agg((of(0) * of(1)).alias("pairs")).groupBy("main").agg(F.sum("pairs").alias("pairs"))
    apart = whole.groupBy("main").agg((of(0) * of(1)).alias("all")).join(by_bucket, "main").filter(F.col("all") > 2 * F.col("pairs"))
    # A main component may hold most rows, so these are dealt over salts.
    apart = apart.select("main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    whole, sided = (x.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")) for x in (whole, sided))
    others = sided.filter("side = 0")
    several = others.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    kinds = (
        whole.join(apart, ["main", "salt"], "left_anti").select(F.lit(0).alias("kind"), F.lit(-1).alias("band"), F.col("main").alias("group"), "side", "rep", "component"),
        sided.join(apart, ["main", "salt"]).select(F.lit(1).alias("kind"), "band", F.col("bucket").alias("group"), "side", "rep", "component"),
        others.join(several, "bucket").select(F.lit(2).alias("kind"), "band", F.col("bucket").alias("group"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "rep", "component"),
    )
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


GROUP = ["kind", "band", "group"]


class Pieces:
    """Groups cut into pieces of bounded size: each side is dealt at random into blocks of about `size`, and a piece
    (i, j) of a group holds block i of side 0 and block j of side 1. Where both sides are the same, i <= j is enough."""

    def __init__(self, sides: DataFrame, size: int):
        n = [F.count(F.when(F.col("side") == k, True)) for k in (0, 1)]
        self.blocks = sides.groupBy(*GROUP).agg(*(F.ceil(x / size).alias(f"blocks{k}") for k, x in enumerate(n)))
        self.sides = sides
        self.number = self.blocks.agg(F.sum(F.col("blocks0") * F.col("blocks1"))).first()[0] or 0

    def apply(self, run, schema: str, *tables: DataFrame) -> DataFrame:
        """The results of all pieces, whose rows get the columns of `tables` by rep. Pieces are dealt to tasks by their
        number: by bytes alone Spark would take many for one task."""
        spark = self.sides.sparkSession
        rows = self.sides.join(self.blocks, GROUP)
        for t in tables:
            rows = rows.join(t, "rep")
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1")))
        other = F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("blocks1")).otherwise(F.col("blocks0")) - 1)
        rows = rows.select("*", own.alias("own"), F.explode(other).alias("other"))
        i, j = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("other")) for k in (0, 1))
        rows = rows.withColumn("i", i).withColumn("j", j).filter("kind < 2 or i <= j").drop("own", "other", "blocks0", "blocks1")
        tasks = int(min(self.number, max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.number // 16)))
        map_arrow(rows, lambda it: it, rows.schema)  # sends the package
        return rows.repartition(max(1, tasks), *GROUP, "i", "j").groupBy(*GROUP, "i", "j").applyInArrow(run, schema)


def _candidates(piece: pa.Table, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row of side 0, the rows of side 1 in other components that the sequential test leaves, and how many minima
    they share with it. Within a bucket, pairs are left out whose first common band is another."""
    side, comp = piece.column("side").to_numpy(), piece.column("component").to_numpy()
    sig, band = _signatures(piece.column("signature").combine_chunks()), piece.column("band")[0].as_py()
    theirs = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        others = theirs[comp[theirs] != comp[x]]
        alive, count = surviving(np.broadcast_to(sig[x], (len(others), HASHES)), sig[others], least)
        others = others[alive]
        if band >= 0 and len(others):
            agree = (sig[others].reshape(-1, BANDS, ROWS) == sig[x].reshape(1, BANDS, ROWS)).all(axis=2)
            here = agree.argmax(axis=1) == band
            others, count = others[here], count[here]
        if len(others):
            yield int(x), others, count


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    ends = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1)
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def block_partners(pieces: Pieces, signatures: DataFrame, least: list[int]) -> DataFrame:
    """For each member of side 0, the partner whose signature agrees best, in each piece."""

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        rep, out = piece.column("rep").to_numpy(), []
        for x, others, count in _candidates(piece, least):
            top = others[count >= count.max() - HASHES // 40]  # about as good: the least id, so that many share a partner
            out.append((rep[x], rep[top].min()))
        return _edges(out)

    return pieces.apply(run, "a long, b long", signatures)


def block_survivors(pieces: Pieces, signatures: DataFrame, least: list[int]) -> DataFrame:
    """(kind, band, group, rep) of the members that have a pair left to verify, by signatures alone: only their texts need travel."""

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        rep, out = piece.column("rep").to_numpy(), [np.zeros(0, np.int64)]
        for x, others, _ in _candidates(piece, least):
            out += [rep[[x]], rep[others]]
        found = np.unique(np.concatenate(out))
        return pa.table({"kind": np.full(len(found), key[0].as_py(), np.int32), "band": np.full(len(found), key[1].as_py(), np.int32), "group": np.full(len(found), key[2].as_py(), np.int64), "rep": found})

    return pieces.apply(run, "kind int, band int, group long, rep long", signatures).distinct()


def block_links(pieces: Pieces, signatures: DataFrame, texts: DataFrame, least: list[int], k: int, percent: int) -> DataFrame:
    """Every member of side 0 is compared with every member of another component on side 1: signatures first, then, for
    all pairs that survive, full sets. Pairs that links of the piece connect already are not compared, and only links
    leave the piece."""

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        rep, root, text = piece.column("rep").to_numpy(), piece.column("component").to_numpy().copy(), piece.column("text")
        sets: dict[int, np.ndarray] = {}

        def set_of(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = shingle_set(text[row].as_py(), k)
            return sets[row]

        out = []
        for x, others, _ in _candidates(piece, least):
            for y in others:
                if root[x] == root[y]:
                    continue
                mine, other = set_of(x), set_of(int(y))
                both = shared(mine, other)
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out.append((rep[x], rep[y]))
                    root[root == root[y]] = root[x]
        return _edges(out)

    return pieces.apply(run, "a long, b long", signatures, texts)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    A text that is null or has no words has no shingles and links with nothing. Rows that share a doc_id count as one
    document. Rows with a null doc_id link with nothing: their component_id is null and they are kept. An empty table
    gives no rows; other columns are not read.
    """
    least = least_matches(percent / 100, miss)
    rows = written(document_sets(docs, k), "sets")
    real = rows.filter("digest is not null and doc_id is not null")
    classes = written(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature")), "classes")

    bands = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band", "bucket"))
    counts = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter("n > 1")
    members = written(bands.join(counts, "bucket"), "members")
    # Members and their pairs grow with the documents, so what they are joined with is merged at every size: Spark would
    # broadcast them while they are few.
    ids = written(members.select(F.col("rep").alias("id")).distinct(), "ids").hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")
    if real.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["id", "text"])
    texts = written(texts, "texts")
    sigs = written(classes.select("rep", "signature").join(ids.withColumnRenamed("id", "rep"), "rep"), "signatures")

    def linked(pairs: DataFrame, many: bool = False, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        pairs = written(promising(pairs, sigs, least, hot).distinct(), "pairs")
        return pairs.select("a", "b"), written(verified(pairs.hint("merge") if many else pairs, texts, k, percent, hot), "links")

    first, hot = members.filter("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b"), F.expr(f"cast(n div {PAIRS_OF_ONE} AS int)").alias("salts")), None
    if first.agg(F.max("salts")).first()[0]:
        first = first.groupBy("a", "b").agg(F.max("salts").alias("salts"))
        hot = written(first.filter("salts > 0").groupBy("a").agg(F.max("salts").alias("salts")).select("a", F.explode(F.sequence(F.lit(1), F.col("salts"))).alias("salt")), "hot")
        first = first.withColumn("salt", F.pmod(F.hash("b"), F.col("salts") + 1).cast("int"))
    tried, links = linked(first.drop("salts").distinct(), True, hot)
    component = written(connected_components(links), "components")
    members = members.select("bucket", "band", "n", "rep")
    for best_only in (True, False):
        m = members.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        # A bucket of one component is done. Its main component is the most frequent one; ties go to the least id.
        per = m.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
        main = per.groupBy("bucket").agg(F.max(F.struct("c", (-F.col("component")).alias("negative"))).alias("x"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("bucket", (-F.col("x.negative")).alias("main"))
        left = written(m.join(main, "bucket"), "left")
        if not left.limit(1).count():
            break
        few = left.filter(F.col("n") <= LISTED).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rep", "component"))).alias("s"))
        few = few.select("s", F.explode("s").alias("x")).select("x", F.explode("s").alias("y")).filter("x.rep < y.rep and x.component != y.component").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        sides = written(block_sides(left.filter(F.col("n") > LISTED)), "sides")
        pieces = Pieces(sides, BLOCK)
        found = None
        if pieces.number and best_only:
            few = few.unionByName(block_partners(pieces, sigs, least))
        elif pieces.number:
            alive = written(block_survivors(pieces, sigs, least), "survivors")
            pieces = Pieces(written(sides.join(alive, [*GROUP, "rep"], "left_semi"), "sides"), BLOCK // 2)
            found = written(block_links(pieces, sigs, texts.withColumnRenamed("id", "rep"), least, k, percent).distinct(), "links")
        new_tried, links = linked(few.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(new_tried)
        component = written(joined(component, links if found is None else links.unionByName(found)), "components")
        members = left.select("bucket", "band", "n", "rep")
    # Texts without words have no class; left under one null key they would meet in one task.
    out = rows.filter("digest is not null").join(classes.select("digest", "rep"), "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    # A document listed with several texts belongs to several classes; the least id that any of them reaches is its component.
    out = out.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(rows.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, by shingles of four words; shorter texts are one
    shingle. Null texts and those without words have no shingles and link with nothing; a null doc_id has no component
    and is kept; of documents as near the least id is kept; repeated rows and ids count as one document; very long texts
    are read whole; an empty table gives no rows; columns of other names are not read."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
