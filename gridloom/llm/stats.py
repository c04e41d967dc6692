"""Statistics of whole texts, for the quality operators."""

from __future__ import annotations

import numpy as np

#: Columns of the first result of `document_stats`, exact counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Columns of the second result, the inputs of the classifiers.
FEATURES = (
    "words", "word_length", "upper_share", "symbol_share", "punctuation_share", "digit_share", "dup_line_share",
    "repeat_share", "unique_share", "lines_per_word", "non_ascii_share", "echo_share", "top_word_share",
)
_SYMBOLS = list(b"#*$%&|<>")
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _SYMBOLS]


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in windows of three words that the text holds twice or more. `ids`: equal for equal words,
    below their number."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # keeps the keys below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())


def document_stats(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (long) and features (double) of each text; null counts as empty, whose counts and features are 0."""
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = len(text)
        words = raw.split()  # bytes split at the six separators of a word, no others
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] * (n > 0)
        symbols, dup = int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines))
        first: dict[bytes, int] = {}
        put = first.setdefault
        ids = np.array([put(w, k) for k, w in enumerate(words)], np.int64)
        repeat = repeated_words(ids)
        word_chars = chars - int(seen[9:14].sum() + seen[32])
        counts[i] = n, word_chars, symbols, dup, repeat
        if not n:
            continue
        upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
        out[i] = (
            n, word_chars / n, upper / max(1, upper + lower), symbols / chars, seen[_PUNCTUATION].sum() / chars,
            seen[48:58].sum() / chars, dup / len(lines), repeat / n, len(first) / n, len(lines) / n,
            seen[128:].sum() / len(raw), (ids[1:] == ids[:-1]).sum() / n, np.bincount(ids).max() / n,
        )
    return counts, out
