"""Grouping of spelling variants by full neighbourhoods.

Of every word of the vocabulary all distinct deletions, replacements and insertions over the observed alphabet are
made, as 64-bit hashes: a polynomial in the characters, so that each costs one addition to sums over what stands before
and behind the change. A candidate whose hash is that of a word is that word, spelled out and joined to the vocabulary;
no distance is computed.

Candidates are some hundred times the vocabulary, so they never travel. A change in the back half of a word leaves its
front half as it is, and the other way round. Words are dealt out by the length of the word that changes and the half
that stays, each as what may come of a change and as what changes, so that a word's candidates meet the words they may
equal in the task that makes them. What is shuffled is a few copies of the vocabulary and the links found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

# The characters of a run, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Rows that a task is meant to get, and the most of one bucket that meet in a piece.
ROWS_A_TASK, PIECE = 400_000, 200_000
#: Distinct words that a task counts before it sends them on; words whose candidates are made at once; characters of a text whose words are listed at once.
COUNTED, CHUNK, LISTED = 200_000, 2048, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _runs(low: str, pattern: re.Pattern) -> Iterator[list[str]]:
    if len(low) <= LISTED:
        yield pattern.findall(low)
        return
    found = pattern.finditer(low)
    while some := [m[0] for m in islice(found, 100_000)]:
        yield some


def word_counts(docs: DataFrame, least_length: int = 5, drop_one_in: int = 0) -> DataFrame:
    """word and n of all runs of letters of whole texts, A-Z lower-cased, that have the least length. With
    `drop_one_in`, a run whose crc32 after its document's id and a colon is divisible by it loses the character at that
    crc32 modulo its length; a null id counts as empty."""
    pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                low = text.as_buffer().to_pybytes().lower().decode() if text.is_valid else ""  # bytes have A-Z alone in two cases
                start = crc(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for words in _runs(low, pattern):
                    if drop_one_in:
                        for k, h in enumerate([crc(w.encode(), start) for w in words]):
                            if not h % drop_one_in:
                                at = h % len(words[k])
                                words[k] = words[k][:at] + words[k][at + 1 :]
                    total.update(words)
                if len(total) >= COUNTED:
                    yield flush()
        yield flush()

    counted = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "word string, n long")
    return counted.filter(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))


def _letter(c: np.ndarray) -> np.ndarray:
    """A pseudorandom odd number for each code point."""
    x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xAF251AF3B0F025B5)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


class Words:
    """Strings as code points, one after the other, and their hashes."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.length) - self.length
        longest = int(self.length.max(initial=0))
        self.powers = np.cumprod(np.array([1] + [_BASE] * (longest + 1), np.uint64))

    def hashes(self) -> np.ndarray:
        place = np.arange(len(self.points)) - np.repeat(self.start, self.length)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(_letter(self.points) * self.powers[place], out=sums[1:])
        return sums[self.start + self.length] - sums[self.start]

    def matrix(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.points[self.start[rows][:, None] + np.arange(length)]


class Known:
    """A set of hashes. Most questions are answered by a table of flags that fits a processor's cache."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = min(24, max(10, int(32 * len(self.sorted)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[self.sorted >> self.shift] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """The flat places of hashes that are in the set."""
        flat = hashes.reshape(-1)
        maybe = np.flatnonzero(self.flags[flat >> self.shift])
        at = np.minimum(np.searchsorted(self.sorted, flat[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == flat[maybe]]


def neighbours(words: Words, rows: np.ndarray, length: int, places: range, alphabet: np.ndarray, known: Known) -> Iterator[tuple[int, str]]:
    """(row, neighbour) for the distinct changes of words of one length at the given places that are known. Deleting
    any of several equal characters in a row gives the same, and so does inserting one before or behind its like: such
    a change counts where it is first."""
    letters = _letter(alphabet)
    marks = [chr(c) for c in alphabet]
    for at in range(0, len(rows), CHUNK):
        some = rows[at : at + CHUNK]
        points = words.matrix(some, length)
        terms = _letter(points) * words.powers[:length]
        before = np.concatenate([np.zeros((len(some), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        total = before[:, -1]
        for i in places:
            power = words.powers[i]
            behind = total - before[:, i]
            added = letters * power
            hits = known.among((before[:, i] + behind * np.uint64(_BASE))[:, None] + added)
            for r, c in zip(*np.divmod(hits, len(alphabet)), strict=True):
                if i == 0 or points[r, i - 1] != alphabet[c]:
                    w = words.words[some[r]]
                    yield int(some[r]), w[:i] + marks[c] + w[i:]
            if i == length:
                continue
            hits = known.among((total - terms[:, i])[:, None] + added)
            for r, c in zip(*np.divmod(hits, len(alphabet)), strict=True):
                if points[r, i] != alphabet[c]:
                    w = words.words[some[r]]
                    yield int(some[r]), w[:i] + marks[c] + w[i + 1 :]
            for r in known.among(before[:, i] + (behind - terms[:, i]) * np.uint64(_INVERSE)):
                if i == 0 or points[r, i - 1] != points[r, i]:
                    w = words.words[some[r]]
                    yield int(some[r]), w[:i] + w[i + 1 :]


def halves(vocabulary: DataFrame) -> DataFrame:
    """bucket, back, changes and word, six rows for each word. A word of length L that changes in its back half keeps
    the first L div 2 characters, one that changes in its front half keeps the others; what comes of it has length
    L - 1, L or L + 1. The bucket stands for L, the half that changes and the part that stays."""
    n = F.length("word")
    rows = vocabulary.select("word", n.alias("n"), F.explode(F.array(n - 1, n, n + 1)).alias("of")).filter("of > 0")
    rows = rows.select("word", (F.col("of") == F.col("n")).alias("changes"), "n", "of", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    kept = F.expr("of div 2")
    stays = F.when(F.col("back"), F.col("word").substr(F.lit(1), kept)).otherwise(F.col("word").substr(F.col("n") - (F.col("of") - kept) + 1, F.col("of")))
    return rows.select(F.xxhash64("of", "back", stays).alias("bucket"), "back", "changes", "word")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word and near for all words, distinct in the vocabulary, that differ by exactly one change; both directions."""
    # One row for each character that occurs.
    points = sorted(ord(r.c) for r in vocabulary.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("c")).distinct().collect())
    alphabet = np.array(points, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("word").to_pylist(), b.column("back").to_numpy(zero_copy_only=False), b.column("changes").to_numpy(zero_copy_only=False)) for b in batches]
        words = Words([w for part, _, _ in parts for w in part])
        if not words.words:
            return
        back, changes = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        known = Known(words.hashes())
        for side in (False, True):
            for length in np.unique(words.length[changes]).tolist():
                rows = np.flatnonzero(changes & (back == side) & (words.length == length))
                places = range(length // 2, length + 1) if side else range(length // 2)
                found = neighbours(words, rows, length, places, alphabet, known)
                while some := list(islice(found, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([words.words[r] for r, _ in some]), pa.array([s for _, s in some])], names=["word", "near"])

    rows = halves(vocabulary)
    # A bucket of very many words is cut into blocks; what changes in one block meets what may come of it in every block.
    # Two blocks of it may be dealt to one task, which then finds a link once for each.
    large = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > PIECE), "large-buckets")
    cut = large.limit(1).count() > 0
    if cut:
        blocks = F.coalesce(F.ceil(F.col("size") / PIECE), F.lit(1)).cast("int")
        rows = rows.join(large, "bucket", "left").select("bucket", "back", "changes", "word", blocks.alias("blocks"), F.pmod(F.hash("word"), blocks).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        asks = rows.filter("changes").select(F.xxhash64("bucket", "own", "other").alias("bucket"), "back", "changes", "word")
        answers = rows.select(F.xxhash64("bucket", "other", "own").alias("bucket"), "back", F.lit(False).alias("changes"), "word")
        rows = asks.unionByName(answers)
    tasks = max(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), 6 * vocabulary.count() // ROWS_A_TASK)
    found = map_arrow(rows.repartition(tasks, "bucket").select("word", "back", "changes"), run, "word string, near string")
    found = found.distinct() if cut else found
    return found.join(vocabulary.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for words with a form (word, form), whose chains have no circles: each round joins every word's
    last known form to that form's, so rounds grow as the logarithm of the longest chain."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(on, "root", "left").select("word", "root", "next"), "roots")
        if not new.filter("next is not null").limit(1).count():
            return now
        now = new.select("word", F.coalesce("next", "root").alias("root"))


def variants(vocabulary: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, form, form_n, n_near and root of each word of a vocabulary (word and n, words distinct).

    The form is the near word of largest n, the least by code points of several, if that n is at least `factor` times
    the word's; else null. The root is the last of a word's chain of forms, the word itself without one. n must be
    positive; an empty vocabulary gives no rows."""
    if factor < 2:
        raise ValueError("with a factor below 2 forms may run in circles")
    near = near_words(vocabulary).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("of")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("of")).alias("less"), "near")).alias("best"))
    larger = -F.col("best.less") >= factor * F.col("n")
    out = vocabulary.join(best, "word", "left").select("word", "n", F.when(larger, F.col("best.near")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    out = written(out, "forms")
    return out.join(roots(out.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of at least 5 characters that occur at least 3 times. Null
    and empty texts have no words, a null doc_id counts as the empty text, repeated documents count again, texts of any
    length are read whole, an empty table gives no rows, columns of other names are not read."""
    counts = word_counts(table(spark, sf_dir, "documents"), drop_one_in=97)
    vocabulary = written(counts.filter("n >= 3"), "vocabulary")
    return variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
