from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from gridloom.llm import components, embdup, minhash, mix
from gridloom.llm.components import connected_components

from . import tables


def test_stages_and_columns(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert out and all(r.exact for r in out)


def test_stages_on_empty_and_null_tables(spark, tmp_path):
    nothing = [(None, None, None, None), (None, None, None, None), (3, None, None, "s"), (4, "", "en", None)]
    for k, rows in enumerate(([], nothing)):
        folder = tables.write(spark, tmp_path / str(k), docs=tables.documents(spark, rows), labels=[])
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            n = stage(spark, docs, folder).count()
            assert n == {"quality rules": 0, "mixing sources": 0}.get(name, len(rows)), name


def test_dedup_keeps_one_of_each_group(spark, tmp_path):
    folder = tables.write(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect())
    assert kept[100] == 1 and not kept.keys() & {101, 102, 103, 104, 205} and kept[204] == kept[200] == kept[201] == 1 and kept[None] == 2


def test_repeated_ids(spark, tmp_path):
    """Rows that share an id: equal texts stay once, the least by its columns; texts that duplicate nothing stay;
    texts linked with one that stays go; rows without words stay as they are."""
    a, b, c = (tables.prose(k, 60) for k in (1, 2, 3))
    rows = [(1, a, "fr", "s"), (1, a, "en", "t"), (1, b, "en", "s"), (2, b + " more", "en", "s"), (2, c, "en", "s"), (3, c + " end", "en", "s"), (4, None, "en", "s"), (4, None, "en", "s"), (4, " ", "en", "s"), (None, a, "en", "s")]
    folder = tables.write(spark, tmp_path, docs=tables.documents(spark, rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("__unit", F.lit("?")).withColumn("__n", F.lit(1))
    for d in (docs, docs.repartition(3)):
        got = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_dedup(spark, d, folder).collect())
        assert got == Counter([(1, a, "en"), (1, b, "en"), (2, c, "en"), (4, None, "en"), (4, None, "en"), (4, " ", "en"), (None, a, "en")])
    assert corpus_pipeline.near_dedup(spark, docs, folder).columns == docs.columns


def test_mixed_texts_hold_the_taken_words(spark):
    docs = tables.documents(spark)
    taken = mix.taken_words(docs, block=16, per_shard=32)
    out = mix.mixed_documents(docs, block=16, per_shard=32)
    words = lambda t: len((t or "").encode().split())
    want, got = Counter(), Counter()
    for r in taken.collect():
        want[r.doc_id] += r.taken
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    assert +got == +want


def test_slots_of_the_mix(spark):
    docs = tables.documents(spark)
    _, pieces, slots = mix.mix(docs, block=16, per_shard=32)
    s = slots.collect()
    assert sorted((r.shard, r.slot) for r in s) == [(k // 32, k % 32) for k in range(len(s))]
    seen = Counter((r.rank, r.epoch, r.block) for r in s)
    assert max(seen.values()) == 1
    shares = {r.shard: Counter() for r in s}
    for r in s:
        shares[r.shard][r.rank] += 1
    assert len({tuple(sorted(c.items())) for c in shares.values()}) > len(shares) / 2  # counts differ from shard to shard


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mix.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(4))).collect()]
        assert sorted(got) == list(range(n)) and (n < 60 or got != sorted(got))


@pytest.mark.parametrize("contracted", [400_000, 7])
def test_components(spark, monkeypatch, contracted):
    """Contracted by one task, or by many and then in rounds."""
    monkeypatch.setattr(components, "CONTRACTED", contracted)
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*path, *star, (5000, 4000), (4000, 5000), (7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == got[4000] == 4000
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Copies of a base that differ among themselves more than from it, a chain, and a dense group, in listed pairs and
    in blocks."""
    base = tables.prose(1, 200).split()
    rows = []
    for i in range(60):  # each shares about 0.9 with the base, 0.8 with each other
        w = list(base)
        for k in range(2):
            w[(i * 3 + k * 97) % 200] = f"n{i}x{k}"
        rows.append((i, " ".join(w), "en", "s"))
    other = tables.prose(2, 200).split()
    for i in range(30):  # a chain: neighbours alike, ends not
        rows.append((100 + i, " ".join([f"c{k}" for k in range(i * 3)] + other[i * 3 :]), "en", "s"))
    sets = {}
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    want = {i: find(i) for i in sets}
    for listed, block, of_one in ((12, 512, 4096), (2, 8, 1)):
        monkeypatch.setattr(minhash, "LISTED", listed)
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "PAIRS_OF_ONE", of_one)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(tables.documents(spark, rows), k=4).collect()}
        assert got == want


def test_dense_groups_of_vectors(spark, monkeypatch):
    """Vectors around one, many near the threshold, with copies; in listed buckets, in blocks, and in both."""
    r = np.random.default_rng(6)
    axis = r.normal(size=(3, 24))
    rows = [(i, (axis[i % 3] / np.linalg.norm(axis[i % 3]) + r.normal(size=24) * (0.03 + 0.08 * (i % 5 == 0))).tolist(), i % 2) for i in range(150)]
    rows += [(1000 + i, rows[7 * i][1], rows[7 * i][2]) for i in range(8)] + [(2000 + i, r.normal(size=24).tolist(), 0) for i in range(40)]
    x = np.array([v for _, v, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    root = embdup._components(near)
    want = {rows[i][0]: (int(near[i].sum()), min(rows[j][0] for j in np.flatnonzero(root == root[i]))) for i in range(len(rows))}
    assert near.sum() > 2000
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for listed, block in ((32, 512), (4, 16), (10_000, 512)):
        monkeypatch.setattr(embdup, "LISTED", listed)
        monkeypatch.setattr(embdup, "BLOCK", block)
        got = {g.vec_id: (g.n_links, g.component_id) for g in embdup.near_duplicates(table).collect()}
        assert got == want


def test_words_taken_of_each_document(spark):
    """Documents tile their source without gaps, and each loses to the slots just the words that they hold of it."""
    docs = tables.documents(spark)
    rows, _, slots = mix.mix(docs, block=16, per_shard=32)
    rows, taken = rows.collect(), Counter()
    by = {}
    for r in rows:
        by.setdefault(r["rank"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.row)
        assert [r.row for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x["size"] for x in own[:k]) for k in range(len(own))]
    for s in slots.collect():
        for r in by[s["rank"]]:
            low, high = max(r.start, s.block * 16), min(r.start + r["size"], s.block * 16 + s.words)
            taken[r.doc_id, r["size"], r.source_size] += max(0, high - low)
    got = Counter()
    for r in mix.taken_words(docs, block=16, per_shard=32).collect():
        got[r.doc_id, r["size"], r.source_size] += r.taken
    assert +got == +taken and sum(got.values()) > 0


def test_recall_of_vectors_near_the_threshold(spark):
    """6,000 pairs of one label with cosines from 0.93 to 0.94 among 20,000 vectors: all links are found."""
    r = np.random.default_rng(12)
    x = r.normal(size=(14_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=(6_000, 64))
    side -= (side * x[:6_000]).sum(axis=1, keepdims=True) * x[:6_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.93001, 0.94, (6_000, 1))
    x = np.concatenate([x, c * x[:6_000] + np.sqrt(1 - c * c) * side])
    links = np.zeros(len(x), int)
    for at in range(0, len(x), 1000):
        links[at : at + 1000] = (x[at : at + 1000] @ x.T >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = embdup.near_duplicates(table).collect()
    assert links.sum() >= 12_000
    assert sum(g.n_links for g in got) >= 0.999 * links.sum() and all(g.n_links <= links[g.vec_id] for g in got)


def test_recall_of_texts_near_the_threshold(spark):
    """1,500 pairs of texts with similarities from 0.73 to 0.88: those of 0.8 or more are linked, no others."""
    rows, sets = [], {}
    for i in range(1500):
        w = [f"w{i}x{k}" for k in range(320)]
        v = list(w)
        for k in range(5 + i % 8):  # each change alters four shingles
            v[3 + (k * 17 + i) % 310] = f"v{i}x{k}"
        rows += [(2 * i, " ".join(w), "en", "s"), (2 * i + 1, " ".join(v), "en", "s")]
        sets[2 * i], sets[2 * i + 1] = ({tuple(t[k : k + 4]) for k in range(len(t) - 3)} for t in (w, v))
    alike = {i: 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1]) for i in range(1500)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(tables.documents(spark, rows), k=4).collect()}
    assert 300 < sum(alike.values()) < 1200
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] == (2 * i if alike[i] else 2 * i + 1) for i in alike)
