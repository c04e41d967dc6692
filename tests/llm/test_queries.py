"""Each registered query against a plain version, on tables with awkward rows; and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import embdup, gbt, langid, pieces, qda, quality, stats
from gridloom.llm.queries import QUERIES

from . import tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 20))
    emb = [(i, [float(v) for v in base[i % 6] + rng.normal(size=20) * (0.02 if i < 60 else 0.5)], i % 3, "?", "?") for i in range(90)]
    emb += [(200, emb[0][1], 0, "?", "?"), (201, emb[0][1], 1, "?", "?"), (202, [x * 2 for x in emb[0][1]], 0, "?", "?"), (202, [x * 2 for x in emb[0][1]], 0, "?", "?")]
    emb += [(210, None, 0, "?", "?"), (211, [], 0, "?", "?"), (212, [0.0] * 20, 0, "?", "?"), (213, [None] + [1.0] * 19, 0, "?", "?"), (214, [float("nan")] * 20, 0, "?", "?"), (215, [float("inf")] + [1.0] * 19, 0, "?", "?"), (216, emb[0][1], None, "?", "?"), (217, emb[0][1][:10], 0, "?", "?"), (None, emb[0][1], 0, "?", "?")]
    conv = [(i, t, ("user", "assistant")[t % 2], f"turn {t} of {i} ### x </turn>\n\\") for i in range(5) for t in range(i + 1)]
    conv += [(7, 0, "system", None), (7, 1, None, "no role"), (7, None, "assistant", "first"), (7, 1, "a: b", "other role"), (8, 0, "assistant", ""), (8, 0, "assistant", ""), (None, 0, "assistant", "no id"), (9, 0, "user", "long " * 50_000)]
    return tables.write(spark, tmp_path_factory.mktemp("sf"), embeddings=emb, conversations=[(*c, "?", "?") for c in conv])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("empty"), docs=tables.documents(spark, []), labels=[])


def rows_of(spark, folder):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-7] if name.startswith("op9") else rows == []


def test_op1(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op1_token_blocks"](spark, folder).orderBy("start").collect()
    rows = rows_of(spark, folder)
    assert len(got) == len(rows)
    ids = [g.doc_id for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start, want = 0, Counter()
    for doc_id, text, _, _ in rows:
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc_id, len(x), zlib.crc32(x.tobytes())] += 1
    for g in got:
        assert g.start == start
        start += g.n_tokens
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == want


def test_op2(spark, folder):
    got = QUERIES["op2_discriminant"](spark, folder).collect()
    docs, labels = rows_of(spark, folder), spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 0
    label = {r.doc_id: r.quality for r in labels if r.quality is not None and r.doc_id is not None}
    text = {}
    for i, t, _, _ in docs:
        text.setdefault(i, t)
    known = sorted(i for i in text if i in label and not held(i))
    model = qda.fit(stats.document_stats([text[i] for i in known])[1], np.array([label[i] for i in known]))
    want = Counter((i, held(i), round(float(s), 9)) for (i, t, _, _), s in zip(docs, model.score(stats.document_stats([d[1] for d in docs])[1]), strict=True))
    assert Counter((g.doc_id, g.held_out, round(g.score, 9)) for g in got) == want
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)


def test_op2_without_labels(spark, tmp_path):
    rows = QUERIES["op2_discriminant"](spark, tables.write(spark, tmp_path, labels=[])).collect()
    assert {r.score for r in rows} == {0.5}


def test_op3_verdicts(spark, folder):
    """kept, by a walk through the trees node by node."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    f = quality.fit_rules(docs, labels)

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    want = Counter()
    for i, t, _, _ in rows_of(spark, folder):
        counts, x = stats.document_stats([t])
        n, repeat = counts[0][0], counts[0][4]
        failed = n < 50 or 100 * repeat > 50 * n
        want[i, bool(not failed and 1 / (1 + np.exp(-f.base - sum(walk(r, x[0]) for r in f.roots))) >= quality.THRESHOLD)] += 1
    assert Counter((g.doc_id, g.kept) for g in QUERIES["op3_tree_rules"](spark, folder).collect()) == want


def test_features_in_plain_words():
    """The inputs of the classifiers, counted by hand."""
    text = "Ab ab #x\nab ab #x\n\nZ9, é"
    x = dict(zip(stats.FEATURES, stats.document_stats([text])[1][0], strict=True))
    w = text.split()
    chars, letters = len(text), [c for c in text if c.isascii() and c.isalpha()]
    want = {
        "words": len(w), "word_length": sum(map(len, w)) / len(w), "upper_share": sum(c.isupper() for c in letters) / len(letters), "symbol_share": text.count("#") / chars,
        "punctuation_share": text.count(",") / chars, "digit_share": 1 / chars, "dup_line_share": 0.0, "repeat_share": 0.0, "unique_share": len(set(w)) / len(w), "lines_per_word": 3 / len(w),
        "non_ascii_share": 2 / len(text.encode()), "echo_share": sum(a == b for a, b in zip(w, w[1:])) / len(w), "top_word_share": max(Counter(w).values()) / len(w),
    }
    assert x == pytest.approx(want)


def test_op3(spark, folder):
    got = Counter(tuple(r)[:8] for r in QUERIES["op3_tree_rules"](spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    seen = Counter()
    for doc_id, text, _, _ in rows_of(spark, folder):
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        seen[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += 1
    assert Counter({k: n for k, n in ((k[:7], sum(m for q, m in got.items() if q[:7] == k[:7])) for k in got)}) == seen
    assert not any(k[6] and k[7] for k in got)


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while True:
        rest, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]] if w else []
        if not over:
            return out | {s: rest * weight[s] / w for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)


def test_op4(spark, folder):
    got = QUERIES["op4_mix_blocks"](spark, folder).collect()
    rows = rows_of(spark, folder)
    assert Counter((g.doc_id, g.size) for g in got) == Counter((i, len(words(t))) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = targets(sizes)
    by = {}
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        k = (g.source_size, round(g.target, 6))
        by[k] = by.get(k, 0) + g.taken
    assert sorted(by) == sorted({(n, round(want[s], 6)) for s, n in sizes.items()})
    for (n, target), taken in by.items():
        assert abs(taken - target * sum((m, round(want[s], 6)) == (n, target) for s, m in sizes.items())) <= 1 + 0.01 * target
    again = QUERIES["op4_mix_blocks"](spark, folder).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def cosine_graph(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = defaultdict(set), {}
    for k, (i, x, p) in enumerate(good):
        for j, y, q in good[:k]:
            if i != j and p == q and len(x) == len(y) and (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    return links, components(links)


def components(links):
    out = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def test_op5(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, comp = cosine_graph(rows)
    got = QUERIES["op5_cross_polytope"](spark, folder).collect()
    assert len(got) == len(rows) and sum(map(len, links.values())) > 300
    for g in got:
        assert (g.n_links, g.component_id, g.kept) == (len(links.get(g.vec_id, ())), comp.get(g.vec_id, g.vec_id), comp.get(g.vec_id, g.vec_id) == g.vec_id)


@pytest.mark.parametrize("width", [2, 3, 4])
def test_narrow_embeddings(spark, width):
    """Pairs just above the threshold, a label each, and a label of many vectors."""
    r = np.random.default_rng(width)
    rows = []
    for k in range(120):
        x, y = np.linalg.qr(r.normal(size=(width, 2)))[0].T
        rows += [(2 * k, x.tolist(), k), (2 * k + 1, (0.935 * x + np.sqrt(1 - 0.935**2) * y).tolist(), k)]
    rows += [(1000 + k, r.normal(size=width).tolist(), 1000) for k in range(60)]
    links, comp = cosine_graph(rows)
    assert all(links[2 * k] == {2 * k + 1} for k in range(120))
    got = embdup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {g.vec_id: (g.n_links, g.component_id) for g in got} == {i: (len(links.get(i, ())), comp.get(i, i)) for i, _, _ in rows}


M64 = (1 << 64) - 1


def test_op6_draws(spark, folder):
    """The descent, from the same uniform draws, in plain Python."""
    from pyspark.sql import functions as F

    from gridloom.llm.shard import topology

    def draws(name):
        h = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.xxhash64("doc_id", F.lit(name)).alias("h")).distinct().collect()
        return {r.doc_id: (((r.h & M64) >> 11) + 0.5) * 2.0**-53 for r in h}

    def descend(n):
        tree = {}
        for x in topology(n):
            tree.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = 1.0
        weight = lambda node: sum(map(weight, node.values())) if isinstance(node, dict) else node
        names = {("tree/region", r) for r in tree} | {(f"tree/rack/{r}", k) for r in tree for k in tree[r]} | {(f"tree/shard/{r}/{k}", s) for r in tree for k in tree[r] for s in tree[r][k]}
        u = {at: draws(f"{at[0]}/{at[1]}") for at in names}
        out = {}
        for key in next(iter(u.values())):
            pick = lambda level, node: min(node, key=lambda k: (-np.log(u[level, k][key]) / weight(node[k]), k))  # noqa: B023, E731
            r = pick("tree/region", tree)
            k = pick(f"tree/rack/{r}", tree[r])
            out[key] = pick(f"tree/shard/{r}/{k}", tree[r][k])
        return out

    now, grown = descend(16), descend(17)
    for g in QUERIES["op6_hash_tree"](spark, folder).collect():
        assert (g.shard, g.grown_shard) == (now[g.doc_id], grown[g.doc_id])


def test_equal_rows_in_masses(spark):
    """Most rows are the same one: each gets a slot of its own and is taken for itself."""
    from gridloom.llm import mix
    from gridloom.llm.shard import shard_documents

    rows = [(None, "same words here", "en", "s")] * 9000 + [(i, tables.prose(i, 20), "en", "t") for i in range(300)]
    docs = tables.documents(spark, rows)
    got = shard_documents(docs).collect()
    of = defaultdict(list)
    for g in got:
        of[g.shard].append(g.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in of.values())
    taken = mix.taken_words(docs).collect()
    assert len(taken) == len(rows) and all(0 <= t.taken <= 3 * t.size for t in taken)
    for source, size in (("s", 27000), ("t", 6000)):
        mine = [t for t in taken if t.source_size == size]
        assert abs(sum(t.taken for t in mine) - mine[0].target) <= 1, source


def test_op6(spark, folder):
    got = QUERIES["op6_hash_tree"](spark, folder).collect()
    rows = rows_of(spark, folder)
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    shards, of = defaultdict(list), defaultdict(set)
    for g in got:
        assert g.law == "key" and 0 <= g.shard < 16 and g.grown_shard in (g.shard, 16)
        shards[g.shard].append(g.slot)
        of[g.doc_id].add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in of.values())


def test_op6_growth_and_weights(spark):
    from gridloom.llm.shard import Leaf, topology, tree_shard

    ids = spark.range(20000).withColumnRenamed("id", "k")
    for n in (16, 17, 20):
        d = tree_shard(tree_shard(ids, ["k"], topology(n), "a"), ["k"], topology(n + 1), "b").groupBy("a", "b").count().collect()
        assert all(r.a == r.b or r.b == n for r in d)
        sizes = Counter()
        for r in d:
            sizes[r.b] += r["count"]
        assert all(abs(sizes[s] - 20000 / (n + 1)) < 250 for s in range(n + 1))
    a, b = [Leaf(0, 0, 0), Leaf(0, 1, 1), Leaf(1, 0, 2), Leaf(1, 1, 3)], [Leaf(0, 0, 0), Leaf(0, 1, 1), Leaf(1, 0, 2), Leaf(1, 1, 3, 2.0)]
    moved = {(r.a, r.b) for r in tree_shard(tree_shard(ids, ["k"], a, "a"), ["k"], b, "b").filter("a != b").select("a", "b").distinct().collect()}
    assert moved and all(y in (2, 3) for _, y in moved)


def whole_viterbi(v, text):
    """Ids of a text by the search over all its places at once."""
    if not text:
        return []
    out = []
    for k, part in enumerate(text.split("▁")):
        out += [v.byte[b] for b in "▁".encode()] if k else []
        s = ("▁" if not k else "") + part.replace(" ", "▁")
        best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - v.longest), j):
                if s[i:j] in v.piece and (best[j] is None or best[i] + v.score[s[i:j]] > best[j]):
                    best[j], back[j] = best[i] + v.score[s[i:j]], (i, v.piece[s[i:j]])
            if best[j] is None or best[j - 1] + v.unknown > best[j]:
                best[j], back[j] = best[j - 1] + v.unknown, (j - 1, None)
        ids, j = [], len(s)
        while j:
            i, piece = back[j]
            ids.append([piece] if piece is not None else [v.byte[b] for b in s[i:j].encode()])
            j = i
        out += [x for run in ids[::-1] for x in run]
    return out


def test_op7(spark, folder):
    got = QUERIES["op7_viterbi_pieces"](spark, folder).collect()
    rows = rows_of(spark, folder)
    v = pieces.encoder(pieces.default_model()).vocabulary
    assert Counter((g.doc_id, tuple(g.ids)) for g in got) == Counter((i, tuple(whole_viterbi(v, t))) for i, t, _, _ in rows)
    assert all(g.exact and g.text_crc32 == g.decoded_crc32 and g.n_ids == len(g.ids) for g in got)
    assert Counter((g.doc_id, g.text_crc32) for g in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)


def test_op8(spark, folder):
    sets, rows = {}, rows_of(spark, folder)
    for i, t, _, _ in rows:
        w = [x.encode().lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    links = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    comp = components(links)
    got = QUERIES["op8_minhash_bayes"](spark, folder).collect()
    assert len(got) == len(rows) and {100, 101, 102, 103, 104, 204, 205} <= set(links)
    for g in got:
        if g.doc_id is None:
            assert (g.component_id, g.kept) == (None, True)
        else:
            want = comp.get(g.doc_id, g.doc_id)
            assert (g.n_shingles, g.component_id, g.kept) == (len(sets[g.doc_id]), want, want == g.doc_id)


def test_op9(spark, folder):
    conv = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        conv[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    probe = "\\### Assistant: </turn> ok"
    conv[-7] = [(True, 0, "user", probe), (True, 1, "assistant", probe)]
    got = {g.conv_id: g for g in QUERIES["op9_chat_template"](spark, folder).collect()}
    assert set(got) == set(conv)
    for k, turns in conv.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars >= sum(len(t) for _, t in turns)


def test_op10(spark, folder):
    got = QUERIES["op10_ngram_ftrl"](spark, folder).collect()
    rows = rows_of(spark, folder)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 3 == 1
    assert Counter((g.doc_id, g.held_out) for g in got) == Counter((i, held(i)) for i, _, _, _ in rows)
    und = Counter(i for i, t, _, _ in rows if not any(c.isalpha() for c in t or ""))
    assert Counter(g.doc_id for g in got if g.lang_pred == "und") == und
    assert all(0 <= g.score <= 1 and g.lang_pred in ("en", "fr", "und") for g in got)


def test_op10_scores(spark, folder):
    """Terms, frequencies and scores by dictionaries; the weights are the model's own."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    got = defaultdict(list)
    for g in QUERIES["op10_ngram_ftrl"](spark, folder).collect():
        got[g.doc_id].append((g.lang_pred, round(g.score, 6)))

    def term(gram):
        h = (ord(gram[0]) * int(langid._FACTORS[0]) + int(langid._SEEDS[len(gram) - 1])) & 0xFFFFFFFF
        for k, c in enumerate(gram[1:], 1):
            h = ((h ^ h >> 15) * int(langid._FACTORS[k]) + ord(c)) & 0xFFFFFFFF
        h ^= h >> 13
        return ((h * int(langid._FACTORS[1])) & 0xFFFFFFFF) >> 17

    def expected(text):
        low = (text or "").lower()
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        grams = Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))
        total = sum(grams.values())
        z = np.array([sum(c * float(row[term(g)]) for g, c in grams.items()) / total for row in model.table]) + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        return model.langs[int(p.argmax())], round(float(p.max()), 6)

    want = defaultdict(list)
    for i, t, _, _ in rows_of(spark, folder):
        want[i].append(expected(t))
    assert set(got) == set(want)
    for i in want:
        for (a, p), (b, q) in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a == b and abs(p - q) < 1e-5
    df, n = langid.document_frequencies(docs.filter("text is not null"))
    seen = Counter(t for _, x, _, _ in rows_of(spark, folder) if x and any(map(str.isalpha, x)) for t in {term(x.lower()[i : i + k]) for k in (1, 2, 3) for i in range(len(x.lower()) - k + 1)})
    assert {int(t): int(df[t]) for t in np.flatnonzero(df)} == dict(seen)


def test_rare_languages_are_learnt(spark):
    """Two languages of 40 and 2 documents among 2,000, beyond what a sample of 30 is sure to hold."""
    r = np.random.default_rng(8)
    voices = {"en": "the of and with shall thing", "fr": "le des été pour nous vous", "eo": "ĉiuj ĝojo ŝipo kaj ĵaŭdo"}
    lang = lambda i: "eo" if i % 50 == 7 else "tr" if i in (600, 1601) else ("en", "fr")[i % 2]
    rows = [(i, " ".join(r.choice(voices[lang(i)].split(), 12)) if lang(i) != "tr" else "ığdır ağaç çığ", lang(i)) for i in range(2000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30)
    assert model.langs == ("en", "eo", "fr", "tr")
    assert model.predict([t for _, t, x in rows if x in ("eo", "tr")])[0] == [x for _, _, x in rows if x in ("eo", "tr")]


def test_language_accuracy(spark, tmp_path):
    r = np.random.default_rng(4)
    voices = {"en": "the of and with shall thing", "fr": "le des été pour nous vous", "de": "der und nicht für über ich"}
    rows = [(i, " ".join(r.choice(voices[lang].split(), 12)), lang, "s") for i in range(300) for lang in [list(voices)[i % 3]]]
    folder = tables.write(spark, tmp_path, docs=tables.documents(spark, rows))
    want = {i: lang for i, _, lang, _ in rows}
    got = [g for g in QUERIES["op10_ngram_ftrl"](spark, folder).collect() if g.held_out]
    assert sum(g.lang_pred == want[g.doc_id] for g in got) >= 0.98 * len(got)


def test_classifiers_on_junk(spark, tmp_path):
    rows = [(i, tables.prose(i, 120) if i % 4 else " ".join(x + "###" for x in tables.prose(i, 120).split()), "en", "s") for i in range(200)]
    folder = tables.write(spark, tmp_path, docs=tables.documents(spark, rows), labels=[(i, int(i % 4 > 0), 0, "?") for i in range(200)])
    assert all(g.predicted == int(g.doc_id % 4 > 0) for g in QUERIES["op2_discriminant"](spark, folder).collect())
    assert all(g.kept == (g.doc_id % 4 > 0) for g in QUERIES["op3_tree_rules"](spark, folder).collect())


def test_trees_are_monotone_and_flat():
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + r.normal(size=600) * 0.3) < 0.6).astype(float)
    f = gbt.fit(x, y, np.array([-1, 0, 1]))
    at = np.repeat(r.random((50, 3))[:, None], 40, axis=1)
    for k, sign in ((0, -1), (2, 1)):
        g = at.copy()
        g[:, :, k] = np.linspace(0, 1, 40)
        s = f.score(g.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    assert np.allclose(f.score(x[:20]), [1 / (1 + np.exp(-f.base - sum(walk(t, row) for t in f.roots))) for row in x[:20]])
    assert ((f.score(x) > 0.5) == y).mean() > 0.8


def test_discriminant_against_densities():
    r = np.random.default_rng(2)
    x = np.abs(r.normal(size=(400, len(stats.FEATURES)))) * 0.1
    x[:, 0] = r.integers(20, 400, 400)
    y = r.integers(0, 2, 400)
    x[y == 0, 3] += 0.2
    m = qda.fit(x, y)
    z, odds = qda.steadied(x, m.centre), np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    for k, sign in ((1, 1), (0, -1)):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        d = z - m.means[k]
        odds = odds - sign * 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-odds)))


def test_fit_is_bounded_and_repeatable(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    x, y = quality.labelled_features(docs, labels, limit=7)
    again, _ = quality.labelled_features(docs.repartition(7), labels.repartition(5), limit=7)
    assert len(y) == 7 and (x == again).all()


def test_temperature_and_sparsity():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 500)
    logits = np.eye(3)[y] * 2 + rng.normal(size=(500, 3))
    t = langid.temperature(logits * 5, y)
    assert t > 2
    rows = [(np.array([k, 10 + i % 200]), np.array([1.0, 0.01])) for i, k in enumerate(y)]
    w, _ = langid.ftrl(rows, y, 3)
    assert (w[10:210] == 0).mean() > 0.5 and (np.argmax(w[:3], axis=1) == np.arange(3)).all()


def test_scores_rank_mixed_texts_below_pure_ones(spark):
    r = np.random.default_rng(9)
    voices = {"en": "the of and with shall thing where house", "fr": "le des été pour nous vous maison près", "de": "und nicht über groß wir haben ein Straße"}
    say = lambda x, n: " ".join(r.choice(voices[x].split(), n))
    rows = [(i, say(x := ("en", "fr", "de")[i % 3], 40), x) for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pure = [(x, say(x, 40)) for x in voices for _ in range(20)]
    said, sure = model.predict([t for _, t in pure])
    assert said == [x for x, _ in pure] and 0.9 < sure.min() and len(set(sure.round(6))) > 10
    _, mixed = model.predict([say(a, 20) + " " + say(b, 20) for a in voices for b in voices if a < b for _ in range(10)])
    assert mixed.mean() < 0.9 * sure.mean() and (mixed < sure.min()).mean() > 0.9


def test_very_many_languages(spark, monkeypatch):
    """Terms share weights, and rows of all languages together stay within their bound."""
    monkeypatch.setattr(langid, "WEIGHTS", 1 << 15)
    monkeypatch.setattr(langid, "LANGS_ROWS", 64)
    words = [f"{a}{b}{c}" * 3 for a in "bdgk" for b in "aeio" for c in "lmn"]
    rows = [(i, " ".join([words[i % 48]] * 5), f"l{i % 48}") for i in range(480)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 300)
    assert model.table.size <= 1 << 15 and model.idf is not None and len(model.langs) >= 40
    said, score = model.predict([t for _, t, _ in rows[:48]])
    assert sum(a == x for a, (_, _, x) in zip(said, rows, strict=False)) >= 40 and (score <= 1).all()


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_tables_of_nulls(spark, tmp_path, name):
    """Rows without text, source or id, and nothing else."""
    docs = [(None, None, None, None), (None, None, None, None), (3, None, None, "s"), (4, "", "en", None)]
    folder = tables.write(spark, tmp_path, docs=tables.documents(spark, docs), labels=[], embeddings=[(None, None, None, "?", "?"), (1, None, None, "?", "?")], conversations=[(None, None, None, None, "?", "?")] * 2)
    n = QUERIES[name](spark, folder).count()
    assert n == (0 if name.startswith(("op11", "op12")) else 2 if name.startswith(("op5", "op9")) else 4)
