"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Terms are the hashed 1- to 3-grams of the lower-cased text, their frequencies shares of all of the text's n-grams, so
that a text's logits are a mean over its n-grams and texts of any length take one pass. The weights are trained with
follow-the-regularised-leader (FTRL-proximal) under an elastic net, then the logits are divided by a temperature fitted
on rows that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import id_crc, least_by_hash, map_arrow, table, written

TERMS = 1 << 15
#: Rows that the weights and the temperature are fitted on at most.
FIT_ROWS = 4000
#: Of each language, so many documents are learnt from at least, or all it has; of all languages together so many, shared alike.
LANG_ROWS, LANGS_ROWS = 100, 8000
#: Weights (terms times languages) at most: with very many languages, as in a column that holds something else, terms share weights.
WEIGHTS = 1 << 24
UNKNOWN = "und"
_ORDERS = 3
_SCALE = 40.0
_STEP = 1 << 22  # code points at once
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SEEDS = np.array([0x27D4EB2F, 0x165667B1, 0x9E3779B9], np.uint32)


def terms(text: str) -> Iterator[np.ndarray]:
    """The terms of a text, with repeats, in arrays of bounded size. A very long text is taken in parts: each begins
    with the last characters of the part before, and gives the n-grams that end within it."""
    low = text.lower()
    for at in range(0, len(low), _STEP):
        lead = min(at, _ORDERS - 1)
        c = np.frombuffer(low[at - lead : at + _STEP].encode("utf-32-le"), np.uint32)
        out = []
        for n in range(_ORDERS):
            first = max(0, lead - n)
            if len(c) - n > first:
                h = c[first : len(c) - n] * _FACTORS[0] + _SEEDS[n]
                for k in range(1, n + 1):
                    h = (h ^ h >> np.uint32(15)) * _FACTORS[k] + c[first + k : len(c) - n + k]
                h ^= h >> np.uint32(13)
                out.append((h * _FACTORS[1] >> np.uint32(32 - TERMS.bit_length() + 1)).astype(np.int32))
        yield np.concatenate(out)


def term_counts(text: str) -> np.ndarray:
    """How often the text has each term."""
    n = np.zeros(TERMS, np.int64)
    for t in terms(text):
        n += np.bincount(t, minlength=TERMS)
    return n


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """table: weight times idf times scale of each term and language, divided by the temperature; bias likewise. Where
    terms share weights, the table's columns stand for terms of one remainder, and idf, apart, weighs the terms."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    idf: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        z = np.zeros((len(texts), len(self.langs)))
        known = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if self.langs and has_letter(text):
                known[i] = True
                if self.idf is not None:
                    count = term_counts(text)
                    z[i] = self.table @ (count * self.idf).reshape(-1, self.table.shape[1]).sum(axis=0) / count.sum() + self.bias
                    continue
                n = 0
                for t in terms(text):
                    n += len(t)
                    z[i] += [np.take(row, t).sum(dtype=np.float64) for row in self.table]
                z[i] = z[i] / n + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True)) if self.langs else np.zeros((len(texts), 1))
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        best = p.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (term, class) and biases. A weight whose gradients sum to less than l1 is exactly 0."""
    z, n = (np.zeros((width or TERMS, n_classes)) for _ in range(2))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for (idx, x), label in zip(rows, y, strict=True):
            w, b = weights(z[idx], n[idx]), weights(zb, nb)
            logit = x @ w + b
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            for zz, nn, gg, ww, at in ((z, n, g, w, idx), (zb, nb, p, b, slice(None))):
                old = nn[at]
                new = old + gg * gg
                zz[at] += gg - (np.sqrt(new) - np.sqrt(old)) / alpha * ww
                nn[at] = new
    return weights(z, n), weights(zb, nb)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, between 1/20 and 20. Against the labels alone, rows that are
    all told apart would ask for ever surer scores; so the right language of a row is aimed at with (n + 1) / (n + 2),
    n the rows of that language, and the others share the rest."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    n = np.bincount(y, minlength=logits.shape[1])[y]
    right = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = log_p[np.arange(len(y)), y]
        return float(-(right * own + (1 - right) * (log_p.sum(axis=1) - own) / (logits.shape[1] - 1)).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(3)) == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts hold each term, over all of them, and their number. A task sums its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(TERMS + 1, np.int64), 0, np.zeros(TERMS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    n += 1
                    for t in terms(text):
                        seen[t] = True
                    df[:TERMS] += seen
                    seen[:] = False
        df[TERMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    rows = map_arrow(texts.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS + 1, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return df[:TERMS], int(df[TERMS])


def labelled_rows(docs: DataFrame, limit: int) -> tuple[list[str], list[np.ndarray]]:
    """Languages and terms of at most `limit` documents, and of the LANG_ROWS with the least hash of each language, or
    fewer, so that they are LANGS_ROWS in all. Of documents that share an id, the least language counts."""
    ids = written(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("label")), "labelled-ids")
    of = written(ids.groupBy("label").agg(F.count(F.lit(1)).alias("of")), "languages")
    each = min(LANG_ROWS, LANGS_ROWS // max(1, of.count()))
    near = ids.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).join(of, "label")
    near = near.filter((F.col("of") <= 4 * each) | (F.col("hash") * F.col("of").cast("double") < 2.0**64 * each))  # about twice as many as are taken
    place = F.row_number().over(Window.partitionBy("label").orderBy("hash", "doc_id"))
    of_each = near.withColumn("place", place).filter(F.col("place") <= each).select("doc_id", "label")
    ids = least_by_hash(ids, "doc_id", limit).union(of_each).distinct()  # limit and LANGS_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    n = term_counts(text)
                    t = np.flatnonzero(n).astype(np.int32)
                    x = (n[t] / n.sum()).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([label]), pa.array([t], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float32()))], names=["doc_id", "label", "t", "x"])

    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").filter("lang = label").select(F.col("doc_id").cast("long"), "label", "text")
    found = map_arrow(rows, run, "doc_id long, label string, t array<int>, x array<float>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("label", "t", "x")).alias("f")).select("doc_id", "f.*").toArrow().sort_by("doc_id")
    values = [(np.array(t.values), np.array(x.values, float)) for t, x in zip(found.column("t"), found.column("x"), strict=True)]
    return found.column("label").to_pylist(), values


def parts(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows for the weights and, a fifth of each language, for the temperature."""
    order = np.random.default_rng(7).permutation(len(y))
    by = order[np.argsort(y[order], kind="stable")]
    count = np.bincount(y)
    nth = np.arange(len(y)) - np.repeat(np.cumsum(count) - count, count)
    last = by[nth < count[y[by]] // 5]
    return order[~np.isin(order, last)], last


def fit(docs: DataFrame, limit: int = FIT_ROWS) -> Model:
    """docs: doc_id, text, lang, all of which may be learnt from. Document frequencies cover all of them."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels, rows = labelled_rows(docs, limit)
    langs = tuple(sorted(set(labels)))
    if not langs:
        return Model((), np.zeros((0, TERMS), np.float32), np.zeros(0))
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 1
    y = np.array([langs.index(x) for x in labels])
    rows = [(t, x * idf[t] * _SCALE) for t, x in rows]
    width = min(TERMS, 1 << max(6, (WEIGHTS // len(langs)).bit_length() - 1))
    if width < TERMS:
        folded = [np.bincount(t % width, x, width) for t, x in rows]
        rows = [(np.flatnonzero(x), x[x != 0]) for x in folded]
    rest, last = parts(y)
    w, b = ftrl([rows[i] for i in rest], y[rest], len(langs), width=width)
    t = temperature(np.array([rows[i][1] @ w[rows[i][0]] + b for i in last]).reshape(-1, len(langs)), y[last])
    if width < TERMS:
        return Model(langs, np.ascontiguousarray((w * _SCALE / t).T.astype(np.float32)), b / t, idf.astype(np.float32))
    return Model(langs, np.ascontiguousarray((w * idf[:, None] * _SCALE / t).T.astype(np.float32)), b / t)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, score = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op10_ngram_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. A text that is null or has no letter is 'und' with
    score 0, as is every text if nothing could be learnt; equal texts have equal results; a null doc_id counts as the
    empty id, which may be learnt from by frequency only. Very long texts are read whole, in parts; an empty table gives
    no rows; other columns are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs.filter(~held_out())))
