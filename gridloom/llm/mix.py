"""Mixing sources to target weights in blocks of words.

Each source's documents are laid end to end and cut into blocks of `block` words. Every output shard has `per_shard`
slots and draws, by hashing, how many of them each source gets: a multinomial draw with the targets as weights. Draws
beyond a source's target pass to sources that are short of theirs, so that totals hold. A source's slots are numbered,
a number is mapped through the source's pseudorandom permutation of block indices, one permutation for each pass over
the source, and the block is joined by that index.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import copied, free_prefix, n_words, spread_buckets, starts_before, table, written

CELLS = 1024


def permuted(x: Column, n: Column, *keys: Column, rounds: int = 24, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1 by the swap-or-not shuffle (Hoang, Morris, Rogaway 2012), which needs
    no power of two: each round either keeps x or swaps it with its partner, as a hash of the larger of both says. A
    round undoes itself, so the inverse is the rounds in reverse order."""

    def step(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - acc + n, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(acc, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(acc)

    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, x.cast("long"), step)


def _before(*order) -> Window:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def source_plan(sizes: DataFrame, block: int, repeat: int, seed: int) -> DataFrame:
    """sizes: source, size, copies (rows of that size). One row per source: rank, weight, source_size, target, words to take, number of blocks, length of the last one
    and number of slots. Windows without a key run over this short list only."""
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("weight", F.pmod("rank", F.lit(3)) + 1)
    everything = Window.partitionBy()
    s = s.withColumn("cap", repeat * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    ratio = (F.col("cap") / F.col("weight"), F.col("rank"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(*ratio)))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(_before("place")), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(Window.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The level at which the remaining sources share by weight holds from the first source whose cap lies above it.
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    s = s.withColumn("first", F.min(F.when(F.col("cap") / F.col("weight") >= level, F.struct("place", level.alias("level")))).over(everything))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("first.level"), F.lit(0.0)) * F.col("weight")))
    size, want = F.col("source_size"), F.col("want")
    s = s.withColumn("want", F.round("target").cast("long")).filter(size >= 0)
    s = s.withColumn("blocks", F.ceil(size / block)).withColumn("last", size - (F.col("blocks") - 1) * block)
    live = size > 0
    s = s.withColumn("passes", F.when(live, F.expr("want div source_size")).otherwise(0))
    s = s.withColumn("over", F.when(live, F.expr("want % source_size")).otherwise(0))
    s = s.withColumn("last_at", F.when(live, last_index(F.col("passes"), seed)))
    m = F.ceil(F.col("over") / block)
    short = (F.col("last_at") < m) & (m * block - (block - F.col("last")) < F.col("over"))
    s = s.withColumn("slots", F.when(live, F.col("passes") * F.col("blocks") + m + F.when(short, 1).otherwise(0)).otherwise(0).cast("long"))
    total = F.greatest(F.sum("want").over(everything), F.lit(1))
    upto = F.sum("want").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("low", (upto - want) / total).withColumn("high", upto / total)
    return s.select("source", "rank", "weight", "source_size", "target", "want", "blocks", "last", "slots", "low", "high")


def last_index(epoch: Column, seed: int) -> Column:
    """The index that a source's last block, the only one that may be short, has in a pass."""
    return permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("rank"), epoch)


def mix_slots(spark: SparkSession, plan: DataFrame, block: int, per_shard: int, seed: int) -> DataFrame:
    """One row per slot of the mix: shard, slot, rank, epoch, block (that of the slot's index) and words (those that the
    slot takes of its block)."""
    # Merge joins are asked for where Spark would broadcast what grows with the data: it takes rows exploded from the
    # short plan for few, and draws for small as their files are.
    n = int(plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    g = spark.range(0, n).select((F.expr(f"id div {per_shard}")).alias("shard"), (F.col("id") % per_shard).alias("slot"))
    g = g.withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("shard"), F.col("slot")), 11)).cast("double") * F.lit(2.0**-53))
    g = g.withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = plan.filter("slots > 0").select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    drawn = g.join(cells, "cell").filter("u >= low and u < high").select("shard", "slot", "rank")
    drawn = written(drawn, "mix-draws")
    counts = written(drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    counts = written(starts_before(counts, ["rank"], "shard", "n", "start"), "mix-starts")
    counts = counts.join(plan.select("rank", "slots"), "rank")
    numbered = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")))
    numbered = numbered.hint("merge").join(counts, ["shard", "rank"]).withColumn("j", F.col("start") + F.col("rn") - 1)
    kept = numbered.filter("j < slots").select("shard", "slot", "rank", "j")
    # Draws beyond a source's slots, numbered over all shards, go to the sources that drew too few.
    spare = numbered.filter("j >= slots").select("shard", "slot")
    spare_counts = counts.withColumn("s", F.greatest(F.col("start") + F.col("n") - F.greatest(F.col("slots"), F.col("start")), F.lit(0)))
    spare_starts = starts_before(spare_counts.groupBy("shard").agg(F.sum("s").alias("s")).filter("s > 0"), [], "shard", "s", "q0").drop("s")
    spare = spare.withColumn("rn", F.row_number().over(Window.partitionBy("shard").orderBy("slot"))).join(spare_starts, "shard").select("shard", "slot", (F.col("q0") + F.col("rn") - 1).alias("q"))
    had = counts.groupBy("rank").agg(F.sum("n").alias("had"))
    short = plan.select("rank", "slots").join(had, "rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots")
    short = short.withColumn("q0", F.coalesce(F.sum(F.col("slots") - F.col("had")).over(_before("rank")), F.lit(0)))
    short = short.select("rank", "had", "q0", F.explode(F.sequence(F.lit(0), F.col("slots") - F.col("had") - 1)).alias("t"))
    moved = spare.join(short.select("rank", (F.col("had") + F.col("t")).alias("j"), (F.col("q0") + F.col("t")).alias("q")).hint("merge"), "q").select("shard", "slot", "rank", "j")
    passes = F.sequence(F.lit(0).cast("long"), F.expr("(slots - 1) div blocks"))  # 4 at most
    of = plan.filter("slots > 0").select("rank", "source_size", "want", "blocks", "last", F.transform(passes, lambda e: last_index(e, seed)).alias("last_in"))
    s = kept.unionByName(moved).join(of, "rank")
    s = s.withColumn("epoch", F.expr("j div blocks")).withColumn("index", F.expr("j % blocks")).withColumn("last_at", F.get("last_in", F.col("epoch").cast("int")))
    gone = F.col("epoch") * F.col("source_size") + F.col("index") * block - F.when(F.col("index") > F.col("last_at"), block - F.col("last")).otherwise(0)
    length = F.when(F.col("index") == F.col("last_at"), F.col("last")).otherwise(block)
    s = s.withColumn("words", F.greatest(F.lit(0), F.least(length, F.col("want") - gone)).cast("long"))
    return s.select("shard", "slot", "rank", "epoch", permuted(F.col("index"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch"), inverse=True).alias("block"), "words")


def mix(docs: DataFrame, block: int = 512, per_shard: int = 1024, repeat: int = 3, seed: int = 20240) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, slots). rows: doc_id, source, th (hash of the text), rank, row (number within its source), copy
    (number among rows equal in doc_id, source and text), copies (how many these are), size, source_size, target, start.
    pieces: the blocks' parts (rank, block, row, at, words; at: place in the block). slots: the mix (shard, slot, rank,
    epoch, block, words), in which a slot holds the first `words` words of its block.

    A null source is a source, the last; a null text has no words; equal rows are rows of their own, taken each for
    itself. With no words at all nothing is taken.
    """
    spark = docs.sparkSession
    # Rows are counted where they lie, so that rows that are equal, even if they are most, make one.
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    sizes = written(sizes.groupBy("doc_id", "source", "size", "th").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    count, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("copies"), F.lit(0))).first()
    n = spread_buckets(count)
    plan = written(source_plan(sizes, block, repeat, seed), "mix-plan")
    rows = sizes.join(plan.select(F.col("source").alias("src"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit("mix")), F.lit(n)).cast("int"))
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    weigh = F.col("size") * F.col("copies")
    starts = rows.groupBy("rank", "bucket").agg(F.sum(weigh).alias("w"), F.sum("copies").alias("c"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("rank", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    rows = rows.withColumn("w", F.coalesce(F.sum(weigh).over(within), F.lit(0))).withColumn("c", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    rows = copied(rows.join(starts, ["rank", "bucket"]), "copies", "copy", most)
    rows = rows.withColumn("start", F.col("w0") + F.col("w") + F.col("copy") * F.col("size")).withColumn("row", F.col("c0") + F.col("c") + F.col("copy"))
    rows = written(rows.select("doc_id", "source", "th", "rank", "row", "copy", "copies", "size", "source_size", "target", "start"), "mix-rows")
    pieces = rows.filter("size > 0").select("rank", "row", "size", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("rank", "block", "row", (low - F.col("block") * block).alias("at"), (high - low).alias("words"), (low - F.col("start")).alias("from"))
    return rows, pieces, mix_slots(spark, plan, block, per_shard, seed)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    rows, pieces, slots = mix(docs, **options)
    at = slots.groupBy("rank", "block").agg(F.collect_list("words").alias("takes"))  # one entry for each pass, 4 at most
    each = pieces.join(at, ["rank", "block"]).withColumn("t", F.aggregate("takes", F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), w - F.col("at")))))
    taken = each.groupBy("rank", "row").agg(F.sum("t").alias("taken"))
    out = rows.join(taken, ["rank", "row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _numbered_copies(docs: DataFrame, key: list[str], rows: DataFrame, p: str) -> DataFrame:
    """docs with p + "copy": each row's number among the rows of its key. Most keys have one row; those that `rows` says
    have more are written with running numbers, so that a key's rows are numbered task by task and never meet in one."""
    first, copy, m, part = F.lit(0).cast("long"), p + "copy", p + "m", p + "part"
    if not rows.filter("copies > 1").limit(1).count():
        return docs.withColumn(copy, first)
    repeated = rows.filter("copies > 1 and copy = 0").select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "th", "size"), (p + "a", p + "b", p + "c", p + "d"), strict=True)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(p + k)) for c, k in zip(key, "abcd", strict=True)))
    many = written(docs.join(repeated, same, "left_semi").withColumn(m, F.monotonically_increasing_id()), "mix-copies")
    many = many.withColumn(part, F.shiftright(m, 33))
    starts = many.groupBy(*key, part).count().withColumn(p + "start", F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbers = many.select(*key, part, m).withColumn(p + "rn", F.row_number().over(Window.partitionBy(*key, part).orderBy(m)))
    starts = starts.select(*(F.col(c).alias(p + k) for c, k in zip(key, "abcd", strict=True)), F.col(part).alias(p + "e"), p + "start")
    numbers = numbers.join(starts, same & (F.col(part) == F.col(p + "e"))).select(m, (F.col(p + "start") + F.col(p + "rn") - 1).alias(copy))
    many = many.join(numbers, m).drop(m, part)
    return docs.join(repeated, same, "left_anti").withColumn(copy, first).unionByName(many)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: a document that a pass takes whole keeps its text, one that it
    takes in part has the taken words in their order, joined by spaces; one row for each pass that takes any word."""
    rows, pieces, slots = mix(docs, **options)
    each = pieces.join(slots.select("rank", "block", "epoch", F.col("words").alias("w")), ["rank", "block"])
    each = each.withColumn("t", F.least(F.col("words"), F.col("w") - F.col("at"))).filter("t > 0")
    parts = each.groupBy("rank", "row", "epoch").agg(F.sum("t").alias("taken"), F.array_sort(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("t").cast("int").alias("t")))).alias("parts"))
    # A row is found again by its content and, among equal ones, its number.
    p = free_prefix(docs)
    t = rows.join(parts, ["rank", "row"]).select(*(F.col(c).alias(p + "of_" + c) for c in ("doc_id", "source", "th", "size", "copy", "taken", "parts")))
    key = ["doc_id", "source", p + "th", p + "size"]
    full = _numbered_copies(docs.withColumn(p + "th", F.xxhash64("text")).withColumn(p + "size", n_words(F.col("text"))), key, rows, p)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(p + "of_" + c.removeprefix(p))) for c in [*key, p + "copy"]))
    m = full.join(t, same)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform(p + "of_parts", lambda x: F.slice(words, x["from"] + 1, x["t"]))), " ")
    m = m.withColumn("text", F.when(F.col(p + "of_taken") == F.col(p + "size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        m = m.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return m.select(*docs.columns)


def op4_mix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document. A null source is a source, the last; a null or
    empty text has size 0 and is never taken; equal rows are rows of their own; an empty table gives no rows; no column
    is read but doc_id, text and source."""
    return taken_words(table(spark, sf_dir, "documents"))
