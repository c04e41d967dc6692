"""Operators 11 to 13 against plain versions, on tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import counts, spelling, vqcodes
from gridloom.llm.queries import QUERIES

from . import tables

WORD_FILE = "word_bpe_49k.json"


# --- spelling variants


def plain_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(v):
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w, n in v.items():
        best = min(((-v[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    out = {}
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    words = ["balloon", "baloon", "ballooon", "balloom", "allon", "ÀÉîoñ", "àéîoñ", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "abcdef", "bcdef", "Straße", "straÿe", "x×y÷zß"]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(1 + (i * (k + 1)) % 5)) + "." * (i % 3), "en", "s") for i in range(40)]
    rows += [(None, "balloon balloon abcde", "en", "s"), (40, None, "en", "s"), (41, "", "en", "s"), (42, " ".join(["balloon"] * 3 + ["q" * 30_000] * 3 + ["q" * 30_001] * 7), "en", "s"), (7, "balloon", "en", "s"), (7, "balloon", "en", "s")]
    rows += [(43, " ".join(["quickest"] * 100 + ["quickes"] * 40 + ["quicke"] * 15), "en", "s")]
    rows += [(100 + i, tables.prose(i, 400), "fr", "s") for i in range(12)]
    return rows, tables.write(spark, tmp_path_factory.mktemp("spelled"), docs=tables.documents(spark, rows))


@pytest.mark.parametrize("piece,listed", [(200_000, 1 << 20), (40, 100)])
def test_op11(spark, spelled, monkeypatch, piece, listed):
    """Also where buckets are cut into blocks and texts are listed in parts."""
    monkeypatch.setattr(spelling, "PIECE", piece)
    rows, folder = spelled
    monkeypatch.setattr(spelling, "LISTED", listed)
    got = {r.word: tuple(r) for r in QUERIES["op11_spelling_variants"](spark, folder).collect()}
    want = plain_variants(plain_counts([(r[0], r[1]) for r in rows]))
    assert got == want
    assert len({r[2] for r in want.values()}) < len(want) and any(r[1] and r[2] != r[1] for r in want.values())


def test_neighbours_are_all_changes_once():
    alphabet = "abc"
    for w in ("aab", "abcab", "aaaaa", "cab"):
        changes = {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in ["", *alphabet]}
        changes.discard(w)
        known = spelling.Known(spelling.Words(sorted(changes | {w, "zzz"})).hashes())
        words = spelling.Words([w])
        found = [s for places in (range(2), range(2, len(w) + 1)) for _, s in spelling.neighbours(words, np.array([0]), len(w), places, np.array([ord(c) for c in alphabet], np.uint32), known)]
        assert sorted(found) == sorted(changes)


def test_long_chain_of_forms(spark):
    n = 30
    v = {"a" * (5 + k): 3 * 2**k for k in range(n)}
    got = spelling.variants(spark.createDataFrame(list(v.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"a" * (4 + n)} and {r.word: r.form for r in got} == {w: w + "a" if len(w) < 4 + n else None for w in v}


def test_vocabulary_beyond_one_byte(spark):
    v = {"дружба": 10, "дружби": 3, "🙂🙂🙂🙂🙂": 5, "🙂🙂🙃🙂🙂": 2, "ab": 1, "a": 9}
    got = {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(v.items()), "word string, n long")).collect()}
    assert got == plain_variants(v)


# --- vector codes


def plain_codes(rows, width, parts=4):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    vectors = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    each = width // parts
    cut = [[v[p * each : (p + 1) * each] for v in vectors] for p in range(parts)]
    books = [c[:256] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut[p]:
                groups[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    final = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    out = [(kept[k][0], "".join(f"{final[p][k][1]:02x}" for p in range(parts)), sum(final[p][k][0] for p in range(parts)), kept[k][2]) for k in range(len(kept))]
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=str)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width)) * 0.2
    rows = [(i * 3, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(size=width) * 0.05], (i % 4) or None) for i in range(n)]
    odd = [(-1, None, 1), (-2, [float("nan")] * width, 1), (-3, [float("inf")] + [0.0] * (width - 1), 1), (-4, [None] + [0.0] * (width - 1), 1), (-5, [0.0] * width, 2), (-6, [], 2), (3, rows[0][1], 3), (3, rows[0][1], 3), (None, rows[1][1], None), (5, [0.5] * (width - 3), 1), (-7, [100.0, -100.0] + [0.001] * (width - 2), 1)]
    return rows + odd


@pytest.mark.parametrize("n,width", [(330, 16), (40, 64), (300, 7)])
def test_op12(spark, tmp_path, n, width):
    """More and fewer vectors than entries, and a width that four parts do not divide."""
    rows = vectors(n, width)
    folder = tables.write(spark, tmp_path, embeddings=[(*r, "?", "?") for r in rows])
    for few in (100_000, 0):  # labels broadcast and merged
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vqcodes, "FEW_LABELS", few)
            got = sorted((tuple(r) for r in QUERIES["op12_segment_bounds"](spark, folder).collect()), key=str)
        assert got == plain_codes(rows, -(-width // 4) * 4)


def test_bounds_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for d, spread in ((1, 50), (2, 3), (16, 400), (33, 10_000_000)):
        x, e = rng.integers(-spread, spread, (3000, d)), rng.integers(-spread, spread, (256, d))
        e[7] = e[3]
        x[:256] = e
        book = vqcodes.Codebook(e)
        rows, entries = book.survivors(x[:1000])
        every = ((x[:1000, None] - e) ** 2).sum(axis=2)
        left = np.zeros(every.shape, bool)
        left[rows, entries] = True
        assert left[every == every.min(axis=1, keepdims=True)].all()
        code, least = book.nearest(x)
        every = ((x[:, None] - e) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


def test_bounds_drop_most_entries_of_grouped_vectors():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (256, 16))
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-40, 40, (2000, 16))
    rows, _ = vqcodes.Codebook(centres).survivors(x)
    assert len(rows) < 2 * len(x)


def test_huge_components_do_not_overflow(spark, tmp_path):
    folder = tables.write(spark, tmp_path, embeddings=[(i, [3e38 * (-1) ** i, 1e30, 1.0, 0.0] * 4, 0, "?", "?") for i in range(5)])
    got = QUERIES["op12_segment_bounds"](spark, folder).collect()
    assert len(got) == 5 and all(r.error == 0 for r in got)


# --- token counts


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(WORD_FILE), Tokenizer.from_file(public_tokenizers.path(WORD_FILE))


def test_op13(spark, tmp_path, monkeypatch):
    rows = [*tables.awkward_texts(), (300, "It's <|endoftext|>THE<|startoftext|><|ENDOFTEXT|> we'll 12½ é é ΣΑΣ İx Ⅷ\x85 ", "en", "s"), (301, "word " * 3000, "en", "s"), (302, "\x00\x1c�" * 3, "en", "s")]
    folder = tables.write(spark, tmp_path, docs=tables.documents(spark, rows))
    _, t = library()
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x, _, _ in rows), key=str)
    assert sorted((tuple(r) for r in QUERIES["op13_token_counts"](spark, folder).collect()), key=str) == want
    assert any(w[3] for w in want)


def test_counts_of_odd_texts_and_slices(monkeypatch):
    import random

    path, t = library()
    c = counts.TokenCounter(path)
    r = random.Random(2)
    pool = "abcXYZ 'stmdrvel\n\t09²½ÀßÿĀſİŉ×÷ªµ.,<|>-–€日本é́̀🙂ΣςΑ \x85\x1cK­​１Ⅷ"
    more = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", " ", "the", "quick"]
    texts = ["".join(r.choice(pool) if r.random() < 0.8 else r.choice(more) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    want = [len(t.encode(s, add_special_tokens=False).ids) for s in texts]
    assert [c.count(s) for s in texts] == want
    monkeypatch.setattr(counts, "SLICE", 8)
    assert [c.count(s) for s in texts] == want


def test_proven_strings_encode_alone_and_no_others_do():
    path, t = library()
    proven = counts.whole_tokens(t)
    vocabulary = t.get_vocab(with_added_tokens=False)
    alone = {s.removesuffix("</w>") for s in vocabulary if s.endswith("</w>") and len(t.model.tokenize(s.removesuffix("</w>"))) == 1}
    assert proven == alone - {""} and len(proven) > 30_000
    assert len(t.encode("hello", add_special_tokens=False).ids) == 1 and "hello" in proven


def test_other_tokenizer_files_go_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    c, t = counts.TokenCounter(path), Tokenizer.from_file(path)
    assert not c.plain
    for s in ("Hello  world's\n\n end", "", "<|endoftext|> é 日本", "a  b   c "):
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids)
