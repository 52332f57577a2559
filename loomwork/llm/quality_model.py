"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics are standardised and mapped to random Fourier features of a
Gaussian kernel. Partitions add up their normal equations, the driver solves
them (their size depends on the number of features only), and out-of-fold
scores are calibrated by pooling adjacent violators over a fixed histogram.

Statistics are computed from whole texts in one pass and written to the shared
folder; labels meet only that slim table. Training takes at most ``most_rows``
labelled rows, chosen by a hash of the id; everything else covers all rows.

Defined results: a null text counts as empty and is scored like any other; rows
with a null id are scored but never learnt from; labels that are null or not 0
or 1 are left out, repeated labels of an id are averaged; without any label
every score is 0.5; an empty table gives no rows; input columns stay, and one
named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import text
from loomwork.llm.tokens import slices
from loomwork.session import sized, stored

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.arange(256)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
_POINT = (_BYTES > 32) & (_BYTES < 127) & ~_LOWER & ~_UPPER & ~_DIGIT
N_STATISTICS = 18


def statistics(body: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    raw = (body or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(N_STATISTICS)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first, last, length = data[begin], data[end - 1], end - begin
    letters = max(1, counts[_LOWER].sum() + counts[_UPPER].sum())
    chars = counts[~_SPACE].sum()
    hashed = np.fromiter(map(hash, words), np.int64, n)
    _, times = np.unique(hashed, return_counts=True)
    grams = hashed[:-2] * 31 + hashed[1:-1] * 1009 + hashed[2:] * 100003 if n > 2 else hashed[:0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array(
        [
            np.log1p(n),
            length.mean(),
            length.std(),
            counts[_UPPER].sum() / letters,
            counts[_MARK].sum() / chars,
            counts[33] / n,
            counts[46] / n,
            counts[44] / n,
            counts[_DIGIT].sum() / chars,
            counts[_POINT].sum() / chars,
            np.log1p(len(lines)) / np.log1p(n),
            np.log1p(len(times)) / np.log1p(n),
            times.max() / n,
            1 - len(set(lines)) / len(lines),
            1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0,
            _MARK[last].mean(),
            (_POINT[first] & (length < 2)).mean(),
            _UPPER[first].mean(),
        ]
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, content hash and statistics of every row, in the shared folder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (x for b in batches for x in slices(b, 1024)):
            flat = [statistics(x) for x in batch.column(2).to_pylist()]
            values = np.concatenate(flat) if flat else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, N_STATISTICS, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "content", "x"])

    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(body).alias("content"), body.alias("body"))
    return stored(rows.mapInArrow(run, "doc_id long, content long, x array<double>"), "quality-statistics")


@dataclass
class Model:
    """Mean and scale of the statistics, the random directions, weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means closest to positives / totals, each drawn half a row towards 1/2."""
    values: list[list[float]] = []
    for p, t in zip(positives, totals, strict=True):
        values.append([p, t, 1])
        while len(values) > 1 and values[-2][0] * values[-1][1] >= values[-1][0] * values[-2][1]:
            p1, t1, k1 = values.pop()
            values[-1] = [values[-1][0] + p1, values[-1][1] + t1, values[-1][2] + k1]
    return np.maximum.accumulate(np.concatenate([np.full(k, (p + 0.5) / (t + 1)) for p, t, k in values])) if values else np.zeros(0)


def _columns(batch):
    x = batch.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS) if batch.num_rows else np.zeros((0, N_STATISTICS))
    return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, add, size: int, tasks: int = 8) -> np.ndarray:
    """Sum over all batches of ``add(x, y, fold)``, an array of ``size`` numbers; at most ``tasks`` arrays reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(*_columns(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = rows.select("x", "y", "fold").coalesce(tasks).mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r.sums) for r in found), np.zeros(size))


def fit(
    labelled: DataFrame, *, features: int = 160, width: float = 3.0, ridge: float = 1e-3, folds: int = 5, bins: int = 2000, seed: int = 11
) -> Model | None:
    """Fit on rows with statistics x, label y and fold; None without rows."""
    d, k = N_STATISTICS, features + 1
    moments = _summed(labelled, lambda x, y, f: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(k), np.zeros(1), np.zeros(1))

    def equations(x, y, fold):
        z = model.features(x)
        return np.stack([np.hstack([z[fold == i].T @ z[fold == i], (z[fold == i].T @ y[fold == i])[:, None]]) for i in range(folds)])

    by_fold = _summed(labelled, equations, folds * k * (k + 1)).reshape(folds, k, k + 1)

    def solved(sums):
        return np.linalg.solve(sums[:, :k] + ridge * max(1.0, sums[0, 0]) / k * np.eye(k), sums[:, k])

    total = by_fold.sum(0)
    model.weights = solved(total)
    others = np.stack([solved(total - x) for x in by_fold])
    low, high = -0.5, 1.5

    def histogram(x, y, fold):
        raw = (model.features(x) * others[fold.astype(int)]).sum(1)
        at = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(int)
        return np.stack([np.bincount(at, y, bins), np.bincount(at, minlength=bins)])

    positives, totals = _summed(labelled, histogram, 2 * bins).reshape(2, bins)
    used = totals > 0
    model.knots = (low + (np.arange(bins) + 0.5) * (high - low) / bins)[used]
    model.levels = isotonic(positives[used], totals[used])
    return model


def usable(labels: DataFrame, *, label: str = "quality", fold: tuple[int, int] = (5, 0), most_rows: int = 200_000) -> DataFrame:
    """(doc_id, y) of at most about ``most_rows`` labelled documents whose crc32 remainder by ``fold[0]`` isn't ``fold[1]``."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    rows = rows.filter(F.col("y").isin(0.0, 1.0) & (text.remainder(F.col("doc_id"), fold[0]) != fold[1]))
    rows = stored(rows.groupBy("doc_id").agg(F.avg("y").alias("y")), "quality-labels")
    n = rows.count()
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(most_rows / n * (1 << 20))) if n > most_rows else rows


def train(statistics_: DataFrame, chosen: DataFrame) -> Model | None:
    """Fit on the rows that `usable` labels name."""
    rows = statistics_.join(chosen, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("fold"))
    return fit(stored(rows, "quality-labelled"))


def scored(statistics_: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, content and score of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).values.to_numpy(zero_copy_only=False).reshape(n, N_STATISTICS) if n else np.zeros((0, N_STATISTICS))
            score = model.score(x) if model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "content", "score"])

    return statistics_.mapInArrow(run, "doc_id long, content long, score double")


def classify(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """doc_id, content and score of every input row."""
    table = measured(docs)
    return scored(table, train(table, usable(labels, **training)))


def with_scores(docs: DataFrame, labels: DataFrame, *, score: str = "score", **training) -> DataFrame:
    """The input rows with their score in a column ``score``; texts stay where they lie.

    For training only labelled texts are measured; their ids, bounded by
    ``most_rows``, are broadcast.
    """
    chosen = usable(labels, **training)
    ids = chosen.select(F.col("doc_id").alias("__id"))
    model = train(measured(docs.join(sized(ids), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")), chosen)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (x for b in batches for x in slices(b, 1024)):
            bodies = batch.column("text").to_pylist()
            x = np.stack([statistics(b) for b in bodies]) if bodies else np.zeros((0, N_STATISTICS))
            yield batch.append_column(score, pa.array(model.score(x) if model else np.full(len(bodies), 0.5)))

    plain = docs.drop(score).withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields]).add(score, "double"))
