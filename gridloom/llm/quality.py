"""Quality of documents: the discriminant classifier and the tree rules, applied to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt, qda
from .common import id_crc, least_by_hash, map_arrow, table
from .stats import COUNTS, FEATURES, document_stats

#: Labelled rows that a classifier is fitted on at most: those with the least hash of their doc_id.
FIT_ROWS = 20_000
#: A text is kept from this score on.
THRESHOLD = 0.3
#: More of these never raises a score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "echo_share", "top_word_share")
_SLICE = 512


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(5)) == 0


def labelled_features(docs: DataFrame, labels: DataFrame, which: Column | None = None, limit: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `limit` labelled documents, in the order of the hash of their doc_id. Documents
    with labels that differ, or other than 0 and 1, are left out; of documents that share an id the least features count."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known if which is None else known.filter(which)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("__most")).filter("label = __most")
    sample = least_by_hash(known.select("doc_id", "label"), "doc_id", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                x = document_stats(part.column("text").to_pylist())[1]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample's size is bounded by `limit`
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    found = map_arrow(rows, run, "doc_id long, label int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("f")).select("f.label", "f.x", "doc_id").toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, found.column("label").to_numpy().astype(int)


def with_columns(docs: DataFrame, schema: str, make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """docs with columns that `make` gives for its texts; `schema` lists them."""
    from pyspark.sql.types import StructType

    own = docs.schema
    out = StructType(own.fields + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                arrays = [*part.columns, *make(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return map_arrow(docs, run, out)


def fit_discriminant(docs: DataFrame, labels: DataFrame, which: Column | None = None) -> qda.Discriminant:
    return qda.fit(*labelled_features(docs, labels, which))


def fit_rules(docs: DataFrame, labels: DataFrame) -> gbt.Forest:
    x, y = labelled_features(docs, labels)
    return gbt.fit(x, y.astype(float), np.array([-1 if f in FALLING else 0 for f in FEATURES]))


def with_score(docs: DataFrame, model: qda.Discriminant, name: str = "score") -> DataFrame:
    return with_columns(docs, f"{name} double", lambda texts: [pa.array(model.score(document_stats(texts)[1]))])


def with_rules(docs: DataFrame, forest: gbt.Forest, prefix: str = "") -> DataFrame:
    """Adds the counts, base_failed, tree_score and kept, each name after `prefix`."""
    names = [*(f"{prefix}{c} long" for c in COUNTS), f"{prefix}base_failed boolean", f"{prefix}tree_score double", f"{prefix}kept boolean"]

    def make(texts: list) -> list[pa.Array]:
        counts, x = document_stats(texts)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = forest.score(x)
        return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= THRESHOLD))]

    return with_columns(docs, ", ".join(names), make)


def op2_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. A null text is scored as the empty text; a null doc_id
    counts as the empty id, so is held out; equal texts have equal scores; without labels of both kinds every score is
    the smoothed share of label 1. No input is read but doc_id, text and the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_discriminant(docs, table(spark, sf_dir, "labels"), ~held_out())
    rows = with_score(docs, model).withColumn("held_out", held_out())
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and tree_score of every document. A null or empty text has counts of
    0 and fails; equal texts have equal results; without any labels the trees keep what the base keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "tree_score")
