"""The corpus pipeline: from documents to training ids, in five stages that each read what the one before wrote.

Each stage works on everything its predecessor kept. All but the last return the columns of the documents, extra ones
included, whatever their names. An empty table gives an empty table; a
null text counts as the empty text; repeated rows are rows of their own except in near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import minhash, mix, pieces, quality
from gridloom.llm.common import free_prefix, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores below the threshold go. It is fitted on labelled documents of the table;
    without labels of both kinds the smoothed share of label 1 decides for all alike. Empty texts are scored too."""
    model = quality.fit_discriminant(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_prefix(docs) + "score"
    return quality.with_score(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or that the trees reject. The trees are fitted on labelled documents of the
    table, not of those the classifier left: these hardly hold a rejected kind any more. A text of fewer than 50 words,
    so also a null or empty one, fails."""
    forest = quality.fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    prefix = free_prefix(docs)
    return quality.with_rules(docs, forest, prefix).filter(prefix + "kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays, once.
    Documents that share an id are documents of their own if their texts differ: a text goes only if it is linked with
    one that stays, and of texts of one id the one of least hash comes first. Of rows that share id and text the least
    stays, by all their columns. Documents without words or without an id stay as they are, each of their rows."""
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        found = written(minhash.near_duplicates(docs), "near-dedup")
        kept = found.filter("kept and doc_id is not null").select("doc_id").hint("merge")  # most ids, however few there are
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    p = free_prefix(docs)
    unit, digest, n = p + "unit", p + "digest", p + "n"
    named = docs.filter("doc_id is not null").withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    units = written(named.select("doc_id", digest).distinct().withColumn(unit, F.monotonically_increasing_id()), "units")
    named = written(named.join(units, ["doc_id", digest]), "units-texts")
    found = minhash.near_duplicates(named.select(F.col(unit).alias("doc_id"), "text"))
    found = written(found.select(F.col("doc_id").alias(unit), "n_shingles", "component_id").distinct().join(units, unit), "near-dedup")
    stay = found.groupBy("component_id").agg(F.min_by(F.struct(unit, "n_shingles"), F.struct("doc_id", digest)).alias("s")).select(F.col(f"s.{unit}").alias(unit), (F.col("s.n_shingles") > 0).alias(n))
    rows = named.join(stay, unit)
    many = written(rows.filter(n).groupBy(unit).count().filter("count > 1").select(unit), "units-many")
    every = F.struct(*(F.col(c) for c in docs.columns))
    once = rows.join(many, unit, "left_semi").groupBy(unit).agg(F.min_by(every, F.to_json(every)).alias(n)).select(f"{n}.*")
    rows = rows.join(many, unit, "left_anti").select(*docs.columns).unionByName(once)
    return rows.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: repeated, whole or in part. Null is a source of its own; documents without
    words are never taken."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, in the columns of op7."""
    return pieces.with_pieces(docs, pieces.default_model())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", encode),
]
#: Trees, signatures and path searches are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
