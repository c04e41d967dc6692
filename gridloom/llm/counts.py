"""Token counts of documents, without encoding what the vocabulary holds whole.

A text is cut into pre-tokens, and merges never cross their borders. Which strings of the vocabulary encode alone as
one token is proved once, before any text is read, by merging each of them (`whole_tokens`): a string may stand in the
vocabulary and still be out of the merges' reach. A pre-token among the proven ones counts one; only the others are
merged, and what they gave is kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Pre-tokens kept besides the proven ones, and the longest that is kept.
KEPT, KEPT_LENGTH = 1_000_000, 256
#: Texts are worked on in slices of about this many characters, cut before white space.
SLICE = 1 << 16
# The normalisers and the pattern of pre-tokens for which `_CUT` stands.
_NORMAL = ("NFC", "Replace", "Lowercase")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Of lower-cased texts without uncommon characters: letters, an ending, a digit, or a run of others.
_CUT = re.compile(r"[a-zªµºß-öø-ÿĀ-ſ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼½¾]|[^\s0-9a-zªµºß-öø-ÿĀ-ſ²³¹¼½¾]+")
# In other texts normal forms, cases or classes of characters need the library's own tables.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧€]")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_LETTERS = _byte_letters()
_BYTES = {c: b for b, c in enumerate(_LETTERS)}


def as_letters(text: str) -> str:
    return "".join([_LETTERS[b] for b in text.encode()])


def whole_tokens(tokenizer) -> frozenset[str]:
    """The pre-tokens, written in byte letters, that the model's merges make into one token: proved one by one."""
    suffix = tokenizer.model.end_of_word_suffix or ""
    strings = (s[: len(s) - len(suffix)] for s in tokenizer.get_vocab(with_added_tokens=False) if s.endswith(suffix))
    return frozenset(s for s in strings if s and len(tokenizer.model.tokenize(s)) == 1)


class _Counts(dict):
    """How many tokens a pre-token has; merged when it is asked for the first time."""

    def __init__(self, proven: Iterator[str], merge):
        super().__init__((s, 1) for s in proven)
        self.merge, self.room = merge, len(self) + KEPT

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= KEPT_LENGTH and len(self) < self.room:
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens as the tokenizers library gives them for a file of kind BPE, without tokens added around a text.
    Strings of added tokens within a text count one, as by the library's default. Common texts are cut here, by a
    pattern that agrees with the file's on them; others go through the library's normaliser and splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        model = self.tokenizer.model
        proven = whole_tokens(self.tokenizer)
        self.by_letters = _Counts(proven, lambda piece: len(model.tokenize(piece)))
        texts = (bytes([_BYTES[c] for c in s]) for s in proven if all(c in _BYTES for c in s))
        self.by_text = _Counts((t.decode() for t in texts if _valid(t)), lambda text: self.by_letters[as_letters(text)])
        self.plain = _is_known(json.loads(Path(path).read_text(encoding="utf-8")))

    def count(self, text: str) -> int:
        n = 0
        for part in _slices(text):
            for k, segment in enumerate(self.added.split(part) if self.added else [part]):
                n += (k > 0) + (self._count(segment) if segment else 0)
        return n

    def _count(self, segment: str) -> int:
        if self.plain and not _UNCOMMON.search(segment):
            return sum(map(self.by_text.__getitem__, _CUT.findall(segment.lower())))
        if self.tokenizer.normalizer:
            segment = self.tokenizer.normalizer.normalize_str(segment)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(segment) if segment else []
        return sum([self.by_letters[piece] for piece, _ in pieces])


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _is_known(file: dict) -> bool:
    """Whether the file normalises and cuts as `_CUT` takes it."""
    normal = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    cut = steps and steps[0].get("pattern", {}).get("Regex") == _PATTERN and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    return tuple(normal) == _NORMAL and bool(cut) and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(" ", at + 1, at + SLICE), text.rfind("\n", at + 1, at + SLICE))
        if cut < 0:
            ends = [k for k in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if k >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def with_token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row. A null or empty text has no bytes and no tokens.
    A very long text is counted in slices; equal rows and ids are rows of their own; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 2048) of every document. Null texts count as empty ones, an
    empty table gives no rows, repeated rows and ids stay, columns of other names are not read."""
    import public_tokenizers

    return with_token_counts(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
