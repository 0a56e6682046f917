"""Measurements of whole texts that the quality rules and the quality classifier share."""

from __future__ import annotations

import re

import numpy as np

from entitygraph.llm.common import WORD_PATTERN

_words = re.compile(WORD_PATTERN)
_shout = re.compile(r"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*")

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Measured of every text, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words", "n_stutters", "n_distinct_words", "n_window_distinct", "n_window_words")
#: Words of a window of n_window_distinct: the text's windows one after another, the last one up to its end.
VARIETY_WINDOW = 60


def repeated_window_words(codes: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; ``codes`` numbers the words of one text.

    Windows are numbered by doubling: pairs, pairs of pairs, and so on, each level
    an exact renumbering.  ``window`` is a power of two.
    """
    n, size, ranks = len(codes), 1, codes
    if n <= window or distinct == n:
        return 0
    top = distinct
    while size < window:
        keys = ranks[:-size].astype(np.int64) * top + ranks[size:]
        found, ranks = np.unique(keys, return_inverse=True)
        top = len(found)
        if top == len(keys):
            return 0
        size *= 2
    often = np.bincount(ranks, minlength=top)[ranks] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def window_distinct(codes: np.ndarray, window: int = VARIETY_WINDOW) -> tuple[int, int]:
    """Distinct words summed over successive windows of the whole text, and the words of these windows."""
    n = len(codes)
    if n <= window:
        return len(set(codes.tolist())), n
    rows = codes[: n - n % window].reshape(-1, window)
    if n % window:
        rows = np.vstack([rows, codes[-window:]])
    rows = np.sort(rows, 1)
    return int((rows[:, 1:] != rows[:, :-1]).sum()) + len(rows), rows.size


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    words = _words.findall(text)
    n = len(words)
    numbers: dict[str, int] = {}
    codes = [numbers.setdefault(w, len(numbers)) for w in words]
    distinct = len(numbers)
    codes = np.array(codes, np.int64)
    stutters = int((codes[1:] == codes[:-1]).sum()) if n > 1 and distinct < n else 0
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if _words.search(line):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    shout = sum(1 for w in words if _shout.fullmatch(w)) if not text.islower() else 0
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dups, repeated_window_words(codes, distinct), lines, shout, stutters, distinct, *window_distinct(codes))
