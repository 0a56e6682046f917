"""Word shingles of whole texts as sets of 64-bit hashes, vectorized over batches."""

from __future__ import annotations

import numpy as np

from entitygraph.llm.common import mix64

WORDS = 5
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_place = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_step = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text.

    A-Z are lower-cased; words are maximal runs without ASCII white space.  With
    fewer than ``words`` words the whole sequence is one shingle; without words the
    set is empty.
    """
    coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join([b"", *coded, b""]), np.uint8)
    inside = ~_white[raw]
    edge = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    offsets = np.cumsum([1, *(len(c) + 1 for c in coded)])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    lengths = ends - starts
    powers = np.empty(int(lengths.max()), np.uint64)
    powers[0] = 1
    powers[1:] = _step
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = mix64(np.add.reduceat(_byte[raw[inside]] * powers[place], np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    count = len(hashes)
    window = np.zeros(max(0, count - words + 1), np.uint64)
    for k in range(words):
        window += hashes[k : k + len(window)] * _place[k]
    window = mix64(window)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(window[a : b - words + 1]))
        elif b > a:
            out.append(mix64((hashes[a:b] * _place[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
