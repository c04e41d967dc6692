"""SentencePiece encoding by a streaming Viterbi search, and decoding.

A text is encoded as the sequence of vocabulary pieces with the highest sum of scores. The search runs forward over
the characters and keeps scores only for starts within the longest piece from where it stands. Whenever the back
pointers of all surviving paths meet in one boundary, the ids up to it are final: they are emitted and their states
dropped. A vocabulary made by merging pairs stores ranks instead of log probabilities; by Zipf's law, the score of rank
r is then -log(r + 2). (The ids are therefore those of the best path, not those of replaying the merges.)

Spaces are written as U+2581, with one before the text. Characters without a piece, and U+2581 itself, become the ids
of their UTF-8 bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table
from .units import UnitCache

SPACE = "▁"
#: Scores are whole numbers of this part, so that sums are exact and ties are ties.
_UNIT = 1 << 20


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        scores = [m.get_score(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ranks = all(s == int(s) and s <= 0 for s in (scores[i] for i in normal)) and len({scores[i] for i in normal}) == len(normal)
        self.piece = {m.id_to_piece(i): i for i in normal}
        self.score = {p: round((-math.log(2 - scores[i]) if ranks else scores[i]) * _UNIT) for p, i in self.piece.items()}
        self.byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces, so it cannot hold every text")
        self.longest = max(map(len, self.piece))
        self.unknown = min(self.score.values()) - 10 * _UNIT
        # No piece goes on with U+2581 after another character: then a text may be cut before each word.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece)
        self.trie: dict = {}
        for p, i in self.piece.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (i, self.score[p])
        self.bytes_of = [b""] * n
        for p, i in self.piece.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True


def stream(vocabulary: Vocabulary, chars: Iterable[str]) -> Iterator[list[int]]:
    """The ids of a text given character by character, in runs, each as soon as it is final. Of paths with equal
    scores the one whose last piece is longer wins, then the one before it, and so on.

    Scores are kept only for where pieces begin that may still go on, so for no more places than the longest piece has
    characters. Of each place since the last boundary where all paths met, its best piece's length and id are kept (8
    bytes): where paths never meet, as in a long run of one character, these must stay. A search for the next such
    boundary walks them all, so the next search waits until they have doubled in number, and time is linear."""
    trie, unknown, piece_of = vocabulary.trie, vocabulary.unknown, vocabulary.byte
    wait = 2 * vocabulary.longest
    length, chosen = array("I"), array("i")  # by place since the last boundary: the best piece that ends there; -1 - code point: bytes
    open_: list[tuple[int, int, dict]] = []  # pieces begun before here: place, score there, trie node
    here, score, check = 0, 0, wait

    def commit(upto: int) -> list[int]:
        ids: list[int] = []
        end = upto
        while end > 0:
            i = chosen[end - 1]
            ids.extend([i] if i >= 0 else [piece_of[b] for b in reversed(chr(-1 - i).encode())])
            end -= length[end - 1]
        return ids[::-1]

    for c in chars:
        open_.append((here, score, trie))
        best, start, i, kept = score + unknown, here, -1 - ord(c), []
        found = False
        for begun, before, node in open_:  # earlier starts first: the longest piece is met first
            child = node.get(c)
            if child is None:
                continue
            kept.append((begun, before, child))
            hit = child.get("")
            if hit is not None and (before + hit[1] > best or not found and before + hit[1] == best):
                best, start, i, found = before + hit[1], begun, hit[0], True
        open_, score = kept, best
        here += 1
        length.append(here - start)
        chosen.append(i)
        if here >= check:
            # Paths that can still win end here, or where an open piece began.
            ends = sorted({here, *(begun for begun, _, _ in open_)})
            while len(ends) > 1:
                last = ends.pop()
                before = last - length[last - 1]
                place = bisect_left(ends, before)
                if place == len(ends) or ends[place] != before:
                    ends.insert(place, before)
            meet = ends[0]
            if meet > 0:
                yield commit(meet)
                del length[:meet], chosen[:meet]
                open_ = [(begun - meet, before, node) for begun, before, node in open_]
                here -= meet
            check = max(2 * here, here + wait)
    if here:
        yield commit(here)


class Encoder:
    """Encodes texts. Where no piece goes on with a space after another character, all paths meet before each word, so
    words are searched one by one and those met before are not searched again."""

    def __init__(self, model_file: str):
        self.vocabulary = Vocabulary(model_file)
        self.cache = UnitCache(lambda words: [self._path(SPACE + w.decode().removeprefix(" ")) for w in words], self.whole)

    def _path(self, text: str) -> np.ndarray:
        return np.array([i for run in stream(self.vocabulary, text) for i in run], np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """The ids of any text; a part between two U+2581 is a path of its own."""
        if not text:
            return np.zeros(0, np.uint32)
        mark = np.array([self.vocabulary.byte[b] for b in SPACE.encode()], np.uint32)
        first, *rest = text.split(SPACE)
        runs = [self._path(SPACE + first.replace(" ", SPACE))]
        for x in rest:
            runs += [mark, self._path(x.replace(" ", SPACE))]
        return np.concatenate(runs)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and self.vocabulary.cuts and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                plain.append(i)
            else:
                out[i] = self.whole(t)
        for i, ids in zip(plain, self.cache.encode([texts[i].encode() for i in plain]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))
        return raw.decode(errors="replace")[1:]


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


def with_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (of the ids as little-endian 32-bit integers), text_crc32, decoded_crc32
    (of the UTF-8 text before, and after encoding and decoding), exact (both texts are equal) and ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, text_crc32 long, decoded_crc32 long, exact boolean, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        is_byte = enc.vocabulary.is_byte
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = enc.encode(texts)
                decoded = [enc.decode(x.tolist()) for x in ids]
                size = np.array([0, *map(len, ids)])
                values = pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
                columns = [
                    part.column("doc_id"), pa.array(size[1:]), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in decoded], pa.int64()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), values),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "text_crc32", "decoded_crc32", "exact", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the check of their round trip. A null text is encoded as the empty text, which
    has no ids; repeated rows give repeated rows; an empty table gives none; other columns are not read."""
    return with_pieces(table(spark, sf_dir, "documents"), default_model())
