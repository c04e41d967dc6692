import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import chat, langid, minhash, pfor, pieces, shingles, stats


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([0.5, 0.9, 1.0]))
def test_pfor_round_trip(ids, share):
    a = np.array(ids, np.uint32)
    data = pfor.encode(a, share)
    assert (pfor.decode(data) == a).all()
    blocks = [pfor.decode_block(data, k) for k in range(-(-len(a) // pfor.BLOCK))]
    assert not blocks or (np.concatenate(blocks) == a).all()


def test_pfor_patches_outliers():
    a = np.arange(2560, dtype=np.uint32) % 8
    plain = len(pfor.encode(a))
    a[::100] = 2**31
    assert len(pfor.encode(a)) < plain + 26 * 5 + 20
    with pytest.raises(ValueError):
        pfor.decode(b"nope" + pfor.encode(a)[4:])


def best_path(v, s):
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            p = s[i:j]
            if p in v.piece and (best[j] is None or best[i] + v.score[p] > best[j]):
                best[j], back[j] = best[i] + v.score[p], (i, v.piece[p])
        if best[j] is None or best[j - 1] + v.unknown > best[j]:
            best[j], back[j] = best[j - 1] + v.unknown, (j - 1, None)
    out, j = [], len(s)
    while j:
        i, k = back[j]
        out.append([k] if k is not None else [v.byte[b] for b in s[i:j].encode()])
        j = i
    return [x for y in out[::-1] for x in y]


def test_streaming_viterbi_is_the_best_path():
    e = pieces.encoder(pieces.default_model())
    r = random.Random(1)
    for _ in range(300):
        s = "".join(r.choice("abcthe inrs aeou▁▁ßé日🙂\n.!0") for _ in range(r.randint(0, 150)))
        assert e.decode(e.encode([s])[0].tolist()) == s
        if s and "▁" not in s:
            assert e.encode([s])[0].tolist() == best_path(e.vocabulary, "▁" + s.replace(" ", "▁"))
    long = "a" * 3000 + "thein" * 900
    runs = list(pieces.stream(e.vocabulary, long))
    assert len(runs) > 1 and [x for run in runs for x in run] == best_path(e.vocabulary, long)


def test_viterbi_takes_time_in_proportion():
    e = pieces.encoder(pieces.default_model())
    for c in "a- ":
        took = []
        for n in (10_000, 100_000):
            began = time.process_time()
            ids = e.encode([c * n])[0]
            took.append(time.process_time() - began)
            assert e.decode(ids.tolist()) == c * n
        assert took[1] < 30 * took[0] + 1
    s = ("-" * 700 + "a" * 900).replace(" ", "▁")
    assert [x for run in pieces.stream(e.vocabulary, s) for x in run] == best_path(e.vocabulary, s)


def test_language_terms_of_parts(monkeypatch):
    """A text's terms do not depend on where it is cut, nor on its case folding there."""
    text = "Iİ ΑΣ ΑΣΑ straße XYZ 日本語 " * 7 + "x"
    whole = langid.term_counts(text)
    model = langid.Model(("a", "b"), np.random.default_rng(3).normal(size=(2, langid.TERMS)).astype(np.float32), np.zeros(2))
    at_once = model.predict([text, "x", ""])
    low = text.lower()
    assert whole.sum() == sum(len(low) - n for n in range(3))
    for step in (1, 2, 3, 5, 64):
        monkeypatch.setattr(langid, "_STEP", step)
        assert (langid.term_counts(text) == whole).all()
        langs, score = model.predict([text, "x", ""])
        assert langs == at_once[0] and np.allclose(score, at_once[1], rtol=1e-12)


def test_chat_layouts_agree():
    c = chat.Canonical()
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": None, "output": "a"},
    ):
        assert c.turns(record) == want
    assert c.turns({"role": "user", "text": None}) == [("user", "")]
    assert c.turns({"messages": []}) == []
    with pytest.raises(ValueError, match="fingerprint"):
        c.turns({"odd": {"layout": 1}})
    assert chat.Canonical(skip_unknown=True).turns({"odd": 1}) == []
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "=x", "a: b", "", "### ", "\\"]), st.lists(st.sampled_from(["\\", "#", "##", "### ", "</turn>", "<", "/", " </turn>\n", ":", " ", "x", "\n", "é"])).map("".join)), max_size=4))
def test_chat_template_round_trip(turns):
    pieces_ = [chat.format_turn(*t) for t in turns]
    assert chat.parse("".join(p[0] for p in pieces_)) == turns
    for (text, a, b), (_, said) in zip(pieces_, turns, strict=True):
        assert chat.unescape(text[a:b]) == said and "###" not in text[a:b] and "</turn>" not in text[a:b]


def test_shingles_match_plain_sets():
    r = random.Random(3)
    for n in (0, 1, 3, 4, 5, 60, 400):
        text = "".join(r.choice(["Ab", "é", "cd", "E"]) + r.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        w = text.encode().lower().split()
        plain = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        assert len(shingles.shingle_set(text, 4)) == len(plain)
    assert (shingles.shingle_set("A b\nc  d e", 4) == shingles.shingle_set(" a B c d E ", 4)).all()
    assert not len(np.intersect1d(shingles.shingle_set("a b c", 4), shingles.shingle_set("a b c c", 4)))


def test_words_in_parts(monkeypatch):
    text = " ".join(f"w{k * k}" for k in range(3000)) + " " + "y" * 5000 + " z"
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "_PART", 700)
    assert (shingles.word_hashes(text) == whole).all()


def test_sequential_test_keeps_similar_pairs():
    least = minhash.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (4000, minhash.HASHES), dtype=np.uint32)
    for share, low, high in ((0.8, 0.9995, 1), (0.5, 0, 0.02)):
        b = np.where(rng.random(a.shape) < share, a, a + 1)
        kept = len(minhash.surviving(a, b.astype(np.uint32), least)[0]) / len(a)
        assert low <= kept <= high


def test_signature_estimates_similarity():
    s = np.unique(np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64))
    a, b = minhash.signature(s[:2700]), minhash.signature(s[300:])
    assert abs((a == b).mean() - 2400 / 3000) < 0.12


def test_repeated_words_of_long_texts():
    assert stats.repeated_words(np.arange(1_100_000)) == 0
    ids = np.arange(1_100_000)
    ids[-3:] = [0, 1, 2]
    assert stats.repeated_words(ids) == 6
