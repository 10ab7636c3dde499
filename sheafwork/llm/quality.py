"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each text is reduced to a dozen statistics, transformed to be roughly normal.  A class is described
by its mean and its covariance, shrunk towards the pooled covariance and then towards a scaled unit
matrix.  The score is the class posterior from the difference of two log densities: half squared
Mahalanobis distances, by the classes' Cholesky factors, and half log determinants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import Slices, text_chunks

FEATURES = (
    "length", "word_length", "upper", "digits", "stops", "signs", "bars", "shouts", "other",
    "signed_words", "upper_words", "repeats", "variety", "line_length",
)
#: Weight of the pooled covariance in a class's, then of the unit matrix in both.
POOLED, UNIT = 0.1, 0.02
#: Differences of log densities count this much: statistics of one text are not independent.
TEMPER = 0.25
THRESHOLD = 0.7

_KIND = np.full(256, 8, np.uint8)  # other
_KIND[97:123] = _KIND[128:] = 0  # letters
_KIND[65:91] = 1  # capitals
_KIND[48:58] = 2  # digits
_KIND[[46, 44, 59, 58, 39, 40, 41, 45, 34]] = 3  # stops
_KIND[[35, 36, 37, 38, 42, 64, 94, 126, 60, 62, 61, 43, 95, 123, 125, 92, 91, 93]] = 4  # signs
_KIND[124] = 5  # bars
_KIND[[33, 63]] = 6  # shouts
_KIND[[32, 9, 10, 11, 12, 13]] = 7  # space


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text, one row per text."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    kind = _KIND[data]
    row = np.repeat(np.arange(texts), sizes)
    per_kind = np.bincount(row * 9 + kind, minlength=texts * 9).reshape(texts, 9).astype(float)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = kind == 7
    begin = ~space[1:-1]
    first = offsets[:-1][sizes > 0]
    fresh = np.zeros(len(data), bool)
    fresh[first] = True
    starts = np.flatnonzero(begin & (space[:-2] | fresh))
    last = np.zeros(len(data), bool)
    last[offsets[1:][sizes > 0] - 1] = True
    ends = np.flatnonzero(begin & (space[2:] | last)) + 1
    owner = row[starts] if len(starts) else np.empty(0, np.int64)
    n_words = np.bincount(owner, minlength=texts).astype(float)
    marked = np.concatenate(([0], np.cumsum((kind >= 4) & (kind <= 6))))
    capital = np.concatenate(([0], np.cumsum(kind == 1)))
    n_marked = np.bincount(owner, weights=marked[ends] > marked[starts], minlength=texts)
    all_caps = (capital[ends] - capital[starts]) * 2 > ends - starts
    n_caps = np.bincount(owner, weights=all_caps & (ends - starts > 1), minlength=texts)
    word = Slices(data).hash(starts, ends)
    again = np.zeros(len(word), bool)
    if len(word):
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    n_again = np.bincount(owner, weights=again, minlength=texts)
    order = np.lexsort((word, owner))
    new = np.ones(len(word), bool)
    if len(word):
        w, o = word[order], owner[order]
        new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        n_new = np.bincount(o, weights=new, minlength=texts)
    else:
        n_new = np.zeros(texts)
    lines = np.bincount(row, weights=data == 10, minlength=texts) + 1

    def share(part, whole, prior, weight):
        return np.sqrt((part + prior * weight) / (whole + weight))

    letters = per_kind[:, 0] + per_kind[:, 1]
    return np.stack(
        [
            np.log1p(sizes),
            np.log((letters + 30) / (n_words + 5)),
            share(per_kind[:, 1], letters, 0.03, 60),
            share(per_kind[:, 2], sizes, 0.001, 200),
            share(per_kind[:, 3], sizes, 0.03, 60),
            share(per_kind[:, 4], sizes, 0.002, 60),
            share(per_kind[:, 5], sizes, 0.001, 60),
            share(per_kind[:, 6], sizes, 0.001, 60),
            share(per_kind[:, 8], sizes, 0.001, 60),
            share(n_marked, n_words, 0.01, 10),
            share(n_caps, n_words, 0.01, 10),
            share(n_again, n_words, 0.01, 10),
            np.log((n_new + 10) / (n_words + 10)) / np.log(n_words + 20),
            np.log((n_words + 10) / (lines + 0.5)),
        ],
        1,
    )


def document_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of ``docs`` (text last), with ``x``, its statistics, in place of the text."""
    *kept, text = columns

    def measure(batches):
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(len(kept))):
                values = statistics(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])
                own = [batch.column(k).slice(low, high - low) for k in range(len(kept))]
                yield pa.record_batch(
                    [*own, lists.cast(pa.list_(pa.float64()))], names=[*kept, "x"]
                )

    source = docs.select(*kept, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(measure, f"{fields}, x array<double>")


@dataclass
class Discriminant:
    """Two normal densities, by their means and the inverse Cholesky factors of their covariances."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    temper: float = TEMPER

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * (z * z).sum(1))
        margin = np.clip((logs[1] - logs[0]) * self.temper, -500, 500)
        return 1 / (1 + np.exp(-margin))


def fit_discriminant(labelled: DataFrame, pooled: float = POOLED, unit: float = UNIT) -> Discriminant | None:
    """Fit on all rows of (x, label 0 or 1); None if a class has fewer than two rows.

    Spark adds up counts, sums and products per class; the driver gets these few numbers only.
    """
    size = len(FEATURES)

    def add_up(batches):
        sums = {}
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(0).flatten()).reshape(-1, size)
            for k in (0, 1):
                own = np.column_stack([np.ones((label == k).sum()), x[label == k]])
                sums[k] = sums.get(k, 0) + own.T @ own
        rows = [(k, v.ravel().tolist()) for k, v in sums.items()]
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            names=["label", "products"],
        )

    parts = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    products = parts.mapInArrow(add_up, "label int, products array<double>")
    summed = (
        products.select("label", F.posexplode("products").alias("i", "v"))
        .groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    )
    moments = np.zeros((2, (size + 1) ** 2))
    for r in summed:
        moments[r.label, r.i] = r.v
    moments = moments.reshape(2, size + 1, size + 1)
    count = moments[:, 0, 0]
    if count.min() < 2:
        return None
    means = moments[:, 0, 1:] / count[:, None]
    scatter = moments[:, 1:, 1:] - count[:, None, None] * means[:, :, None] * means[:, None, :]
    together = scatter.sum(0) / count.sum()
    factors, constants = [], []
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / count[k] + pooled * together
        scale = np.diag(together).clip(1e-9)
        own = (1 - unit) * own + unit * np.diag(scale)
        cholesky = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(cholesky))
        constants.append(np.log(count[k] / count.sum()) / TEMPER - np.log(np.diag(cholesky)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def score_quality(measured: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` and ``predicted`` in place of ``x``.  Without a model every score is 0.5."""
    spread = measured.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in measured.columns if c != "x"]

    def score(batches):
        known = spread.value
        for batch in batches:
            x = np.array(batch.column(len(kept)).flatten()).reshape(-1, len(FEATURES))
            found = known.scores(x) if known else np.full(len(x), 0.5)
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in range(len(kept))),
                    pa.array(found),
                    pa.array((found >= threshold).astype(np.int32)),
                ],
                names=[*kept, "score", "predicted"],
            )

    source = measured.select(*kept, "x")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(score, f"{fields}, score double, predicted int")
