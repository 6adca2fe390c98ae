"""Exact counts of one text, shared by the quality rules and the quality classifier.

Words are runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``), lines are split at ``\\n``.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def repeated(words: list[bytes]) -> tuple[int, int]:
    """How many words lie in three-word windows that occur twice or more, and of distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(words) < 4:
        return 0, len(numbers)
    base = len(numbers)
    if base > 2_000_000:  # three numbers don't fit into one: number the pairs first
        pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1]
        windows = pairs * base + ids[2:]
    else:
        windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0, base
    hit = np.zeros(len(windows), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum()), base


def base_counts(text: str) -> dict[str, int]:
    """The base features of a text; an absent text is passed as ''."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    many, distinct = repeated(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": many,
        "n_lines": len(lines),
        "n_distinct": distinct,
    }
