"""Byte-level BPE vocabulary, priority-queue encoding and decoding by concatenation.

A vocabulary file (JSON with ``model.vocab`` and ``model.merges``) is loaded
once per process.  Symbols of a word form a doubly linked list; a heap holds the
applicable merges by (rank, place).  An entry is stale when one of its two
symbols has changed since it was pushed; stale entries are skipped when popped.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from entitygraph.llm.common import slices, small_batches, texts_of

#: How byte-level vocabularies split text before merging (a fixed pattern of the public vocabulary).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a process remembers; the memory is emptied when full.
WORD_MEMORY = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(spare)}


class Vocabulary:
    """Token byte strings, merge table and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = self.ids[letter]
        #: (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: merged -> (rank, left, right)
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, m = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges[a, b] = (rank, m)
            self.parts.setdefault(m, (rank, a, b))
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token: merges by rank, leftmost first among equals."""
        symbols = [self.byte_id[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            m = merges.get((symbols[i], symbols[i + 1]))
            if m:
                queue.append((m[0], i, m[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: a symbol has gone or changed
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = merges.get((merged, symbols[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, m[1], merged, symbols[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((symbols[h], merged))
                if m:
                    heapq.heappush(queue, (m[0], h, m[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """The text cut at special strings: (ordinary text, -1) or ("", id of a special string)."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield text, -1
            return
        at = 0
        for m in self.special_split.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], -1
            yield "", self.special[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], -1

    def decode(self, ids) -> str:
        """Concatenated vocabulary strings; bytes that are not UTF-8 become U+FFFD."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, made when first asked for."""

    def __init__(self, vocabulary: Vocabulary, most: int = WORD_MEMORY):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = pack(self.vocabulary.encode_word(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            self[word] = made
        return made


def pack(ids) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("32-bit integers are needed")
    import sys

    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(ids: bytes) -> array:
    import sys

    out = array("I")
    out.frombytes(ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(vocabulary(path))


_split = regex.compile(SPLIT_PATTERN)


def encode(text: str, path: str) -> bytes:
    """The packed ids of a text."""
    vocab, known = vocabulary(path), word_ids(path)
    out = []
    for part, special in vocab.segments(text):
        if special >= 0:
            out.append(pack([special]))
        else:
            out.extend(map(known.__getitem__, _split.findall(part)))
    return b"".join(out)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the columns ``keep`` with ``n_tokens`` (long), ``ids`` (binary,
    little-endian unsigned 32-bit integers) and, if asked for, ``decoded``
    (string).  A null or empty text gives no tokens, empty ids and an empty
    decoded text.  Rows are independent: repeated rows and ties give repeated
    results, an empty table an empty result; other columns are not read.
    Memory: one Arrow batch, a bounded word memory and the longest text.
    """
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", n_tokens bigint, ids binary" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch, text)
            for a, b in slices(texts):
                ids = [encode(t, path) for t in texts[a:b]]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = [*keep, "n_tokens", "ids"]
                if decoded:
                    more.append(pa.array([vocab.decode(unpack(x)) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([*kept, *more], names=names)

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode packed ids: the columns ``keep`` with ``decoded``; null ids decode to an empty text."""
    path = path or default_vocabulary()
    small_batches(encoded.sparkSession)
    source = encoded.select(*keep, ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(unpack(x or b"")) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)
