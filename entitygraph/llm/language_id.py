"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (lengths 1 to 3) that are
present in both, divided by the root of the product of how many each has.  N-grams of code
points are hashed into a fixed space, so that no script is cut short.  Nystroem landmarks,
drawn evenly from the languages, give finite features; one-versus-rest kernel ridge
regression gives the weights; texts are scored by batched matrix products.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitygraph.llm.common import crc_class, slices, small_batches, texts_of
from entitygraph.llm.sampling import per_class

#: Learning rows of each language that the fit uses at most (about), landmarks of each, and of all.
SAMPLE_PER_LANGUAGE = 300
#: Learning rows of all languages together.
MOST_SAMPLE = 3000
LANDMARKS_PER_LANGUAGE = 24
MOST_LANDMARKS = 256
RIDGE = 1e-3
#: N-grams are hashed to so many bits.  A text's presence in this space is at most 16 kB.
BITS = 17
SPACE = 1 << BITS
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # n-gram code -> column, the last column gathers the rest
    landmarks: np.ndarray  # presence (columns, landmarks)
    sizes: np.ndarray  # n-grams of the landmarks
    weights: np.ndarray  # kernel values -> scores of the languages

    def kernel(self, presence: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their distinct codes, and the landmarks."""
        width = len(self.landmarks)
        present = np.zeros((len(presence), width + 1), np.float32)
        for row, codes in zip(present, presence, strict=True):
            row[self.columns[codes]] = 1
        shared = present[:, :width] @ self.landmarks.astype(np.float32)
        sizes = np.array([max(1, len(c)) for c in presence], np.float32)
        return shared / np.sqrt(sizes[:, None] * self.sizes[None, :].astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score in [0, 1]; ``und`` and 0 for texts without letters."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        for a in range(0, len(rows), 128):
            own = rows[a : a + 128]
            raw = self.kernel([codes_of(texts[i]) for i in own]) @ self.weights
            likely = np.exp(4 * (raw - raw.max(1, keepdims=True)))
            likely /= likely.sum(1, keepdims=True)
            best = raw.argmax(1)  # the first of equals: languages stand in code point order
            for i, k, p in zip(own, best, likely[np.arange(len(own)), best], strict=True):
                names[i], scores[i] = self.languages[k], p
        return names, scores


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes_of(text: str) -> np.ndarray:
    """The distinct codes of the 1-, 2- and 3-grams of a text's lower-cased letters; all else is one symbol."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(letter_table()[points], points, 0).astype(np.uint64) + np.uint64(1)
    seen = np.zeros(SPACE, bool)
    hashed = np.zeros(len(s), np.uint64)
    for k in range(min(3, len(s))):
        hashed = (hashed[: len(s) - k] + s[k:]) * MULTIPLIER
        seen[hashed >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


def fit(rows: list[tuple[str, np.ndarray]], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """A model from (language, distinct codes) pairs; none without rows."""
    languages = sorted({k for k, _ in rows})
    if not languages:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0)))
    per_language = max(1, min(per_language, MOST_LANDMARKS // len(languages)))
    chosen = [c for k in languages for c in [c for j, c in rows if j == k][:per_language]]
    seen = np.zeros(SPACE, bool)
    for codes in chosen:
        seen[codes] = True
    width = int(seen.sum())
    columns = np.full(SPACE, width, np.int32)
    columns[seen] = np.arange(width)
    marks = np.zeros((width, len(chosen)), np.uint8)
    for k, codes in enumerate(chosen):
        marks[columns[codes], k] = 1
    model = Model(languages, columns, marks, np.array([max(1, len(c)) for c in chosen], float), np.zeros((1, 1)))
    # Nystroem: features are kernel values times the inverse root of the landmarks' own kernel matrix.
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    k = np.concatenate([model.kernel([c for _, c in rows[a : a + 128]]) for a in range(0, len(rows), 128)]).astype(float)
    phi = k @ root
    y = np.array([[1.0 if j == lang else -1.0 for lang in languages] for j, _ in rows])
    count = np.array([sum(j == lang for j, _ in rows) for lang in languages])
    weight = np.sqrt(np.array([1.0 / count[languages.index(j)] for j, _ in rows]))[:, None]
    phi_w, y_w = phi * weight, y * weight
    solved = np.linalg.solve(phi_w.T @ phi_w + ridge * np.eye(phi.shape[1]), phi_w.T @ y_w)
    model.weights = (root @ solved).astype(np.float32)
    return model


def train(docs: DataFrame, learn: Column | None = None, key: str = "doc_id", label: str = "lang", text: str = "text", bound: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of at most about ``bound`` rows a language, and ``MOST_SAMPLE`` together.

    Sampled texts are read whole by the executors; the driver gets the presence of their n-grams,
    at most 16 kB a row.  Null labels, texts and keys teach nothing.  Repeated rows are sampled
    alike.  A label column with more than 1,000 values is refused.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    small_batches(docs.sparkSession)
    sample, _ = per_class(rows.select(key, label, text), key, label, bound, MOST_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for t in texts_of(batch, "t"):
                seen = np.zeros(SPACE, bool)
                seen[codes_of(t)] = True
                packed.append(zlib.compress(np.packbits(seen).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["label", "key", "presence"])

    found = sample.select(F.col(label).cast("string").alias("label"), F.col(key).cast("string").alias("key"), F.col(text).alias("t")).mapInArrow(run, "label string, key string, presence binary").collect()
    unpacked = lambda b: np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bytes(b)), np.uint8)))
    return fit([(r.label, unpacked(r.presence)) for r in sorted(found, key=lambda r: (r.label, r.key, bytes(r.presence)))])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was
    learned.  Ties go to the language first in code point order.  Rows are
    independent; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", lang_pred string, score double"
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by landmarks and the space of codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in batches:
            texts = texts_of(batch, text)
            parts = [own.predict(texts[a:b]) for a, b in slices(texts)]
            names = [n for p, _ in parts for n in p]
            scores = np.concatenate([s for _, s in parts]) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


HELD_OUT_PARTS, HELD_OUT = 3, 1


def held_out(key: str = "doc_id") -> Column:
    return crc_class(key, HELD_OUT_PARTS) == HELD_OUT
