"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SPARE = ["score", "kept", "component", "rep", "taken", "parts", "shard", "rank", "n", "bucket", "size", "label"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in SPARE)
_WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "me", "sa", "lo") for b in ("n", "ra", "vi", "st", "", "dor")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """(doc_id, text, lang, source)"""
    base, rows = prose(1, 120), []
    rows += [(i, prose(i, 30 + 9 * i), ("en", "fr")[i % 2], f"s{i % 4}") for i in range(2, 30)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s1"), (101, base, "en", "s1"), (102, base.upper(), None, "s0")]
    words = base.split()
    near = [*words[:60], "zzz", *words[61:]]
    rows += [(103, " ".join(near), "en", "s0"), (104, "  ".join(words) + "\n\t", "en", None), (105, " ".join(words[:60]), "fr", "s2")]
    rows += [(200, None, "en", "s0"), (201, "", None, None), (202, " \n\t\x0b\x0c\r ", "fr", "s3"), (203, "x", "en", "s3"), (204, "one two three", "en", "s3"), (205, "One TWO three", "en", "é"), (206, "1234 +-+ 99", "en", "s0")]
    rows += [(207, "日本語 ▁x <|endoftext|> 🙂  ﬁ ​\n\n  end ", "en", "ß"), (208, "a" * 3000 + " " + "b" * 70, "fr", "s1"), (209, prose(9, 20000), "en", "s0"), (210, "same line\n" * 80, "fr", "s2"), (211, "| # $ % " * 60, "fr", "s2"), (None, prose(7, 60), "en", "s1"), (None, "no id", "fr", "s2")]
    return rows


def documents(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *("?" for _ in SPARE)) for r in rows], DOCUMENTS)


def write(spark, folder, docs=None, labels=None, embeddings=None, conversations=None) -> str:
    docs = documents(spark) if docs is None else docs
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] % 7 != 0), 0, "?") for r in docs.filter("doc_id is not null").select("doc_id").distinct().collect()] if labels is None else labels
    spark.createDataFrame([*labels, (None, 1, 0, "?"), (5, None, 0, "?")] if labels else [], "doc_id long, quality int, toxic int, text string").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(embeddings or [], "vec_id long, embedding array<float>, label int, n_links string, rep string").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(conversations or [], "conv_id long, turn long, role string, text string, record string, place string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)
