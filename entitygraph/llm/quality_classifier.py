"""Quality classifier: regularised quadratic discriminant over document statistics.

Class covariances over transformed statistics are shrunk towards their mean
variance; scores are differences of Mahalanobis log densities, computed with
Cholesky factors that are inverted once and cached in the model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitygraph.llm.common import crc_class, small_batches, texts_of
from entitygraph.llm.doc_stats import MEASURES, measure
from entitygraph.llm.sampling import per_class

#: Labelled rows of each class that the fit uses at most (about).
SAMPLE_PER_CLASS = 3000
SHRINKAGE = 0.15
CUT = 0.3
FEATURES = 12


def features(text: str) -> np.ndarray:
    """Transformed statistics: smoothed shares on a square-root scale, so that short texts lie near the middle."""
    m = dict(zip(MEASURES, measure(text), strict=True))
    n, chars = m["n_words"], len(text)

    def share(count: float, total: float, usual: float, weight: float = 10.0) -> float:
        return ((count + weight * usual) / (total + weight)) ** 0.5

    spaces = text.count(" ") + text.count("\n")
    marks = sum(map(text.count, ".,;:?"))
    digits = sum(map(text.count, "0123456789"))
    return np.array(
        [
            min(np.log1p(n), np.log1p(200.0)),
            share(min(m["n_symbols"], n), n, 0.0),
            share(min(m["n_symbols"], 4 * n), 4 * n, 0.0),
            share(m["n_shout_words"], n, 0.0),
            share(min(text.count("!"), n), n, 0.0),
            share(m["n_stutters"], n, 0.0),
            share(m["n_repeat_words"], n, 0.0, 40.0),
            share(m["n_dup_lines"], m["n_lines"], 0.0, 4.0),
            share(m["n_window_distinct"], m["n_window_words"], 0.9),
            np.log((m["word_chars"] + 10 * 5.0) / (n + 10)),
            share(min(marks, n), n, 0.15),
            share(chars - spaces - digits, chars, 0.83, 40.0),
        ]
    )


@dataclass
class Model:
    """Means, inverted Cholesky factors and log constants of the two classes."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    fitted: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; 0.5 where nothing could be learned."""
        if not self.fitted:
            return np.full(len(x), 0.5)
        density = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            density.append(self.constants[k] - 0.5 * (z * z).sum(0))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, prior: tuple[float, float] | None = None, shrinkage: float = SHRINKAGE) -> Model:
    """A discriminant from features and 0/1 labels; a class without rows leaves the model unfitted."""
    means, inverses, constants = [], [], []
    if min((y == 0).sum(), (y == 1).sum()) == 0:
        return Model(np.zeros((2, x.shape[1])), np.zeros((2, 1, 1)), np.zeros(2), fitted=False)
    prior = prior or ((y == 0).mean(), (y == 1).mean())
    scale = x.var(0) + 1e-6
    for k in (0, 1):
        rows = x[y == k]
        mean = rows.mean(0)
        spread = (rows - mean).T @ (rows - mean) / max(1, len(rows) - 1)
        # Towards the variances of all rows: directions in which a class hardly varies stay finite.
        lam = max(shrinkage, x.shape[1] / (x.shape[1] + len(rows)))
        cov = (1 - lam) * spread + lam * np.diag(0.1 * scale + 0.9 * np.minimum(np.diag(spread), scale)) + 1e-4 * np.diag(scale)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverses.append(np.linalg.inv(factor))
        constants.append(np.log(prior[k]) - np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(inverses), np.array(constants))


def featurize(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return source.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", label: str = "quality", text: str = "text", bound: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a sample of at most about ``bound`` labelled rows a class.

    ``learn`` restricts the labelled keys.  Keys with several labels count by their
    largest; null keys and labels other than 0 and 1 are left out.
    """
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("_y")).where(F.col(key).isNotNull() & F.col("_y").isin(0, 1))
    if learn is not None:
        rows = rows.where(learn)
    rows = rows.groupBy(key).agg(F.max("_y").alias("_y"))
    sample, sizes = per_class(rows, key, "_y", bound)
    # The sample's size is bounded by 2 * bound keys or so, hence the broadcast.
    found = featurize(docs.select(key, text).join(F.broadcast(sample), key).select(key, "_y", text), (key, "_y"), text).select("_y", "features").collect()
    total = sum(sizes.values())
    if not found or total == 0:
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    order = sorted((r[0], tuple(r[1])) for r in found)
    x, y = np.array([f for _, f in order]), np.array([k for k, _ in order])
    return fit(x, y, (max(1, sizes.get(0, 0)) / total, max(1, sizes.get(1, 0)) / total))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` (1 if score >= cut), or other ``names``.

    A null or empty text is scored as a text without words.  Rows are independent:
    ties and repeated rows give repeated results, an empty table an empty one; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, *([] if text in keep else [text]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + f", {names[0]} double, {names[1]} int"
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in batches:
            texts = texts_of(batch, text)
            x = np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)
            s = own.scores(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=[*keep, *names])

    return source.mapInArrow(run, schema)


#: Rows whose key falls in class 0 of 5 are held out from learning.
HELD_OUT_PARTS = 5


def held_out(key: str = "doc_id") -> Column:
    return crc_class(key, HELD_OUT_PARTS) == 0
