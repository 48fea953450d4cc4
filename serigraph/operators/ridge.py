"""A ridge classifier over features of series: one class against the rest, with the penalty chosen by leaving one out.

Two passes over the series: sums of products, added up over a tree of tasks, and the errors of leaving each series out, in closed
form. The driver and each task hold matrices of width * width numbers, whatever the number of series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Features up to which the matrices (8 * width * width bytes) are made; numbers of a dense step.
MOST_FEATURES, STEP = 8_192, 2_000_000


def _dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows as dense matrices, with the row that each starts at."""
    indices, values = batch.column("indices"), batch.column("values")
    bounds, at, x = indices.offsets.to_numpy(), indices.values.to_numpy(), values.values.to_numpy()
    step = max(1, STEP // max(width, 1))
    for first in range(0, batch.num_rows, step):
        last = min(batch.num_rows, first + step)
        own = slice(bounds[first], bounds[last])
        out = np.zeros((last - first, width))
        out[np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1])), at[own]] = x[own]
        yield first, out


@dataclass
class RidgeModel:
    """classes, a row of coefficients for each, intercepts, the penalty chosen and the mean squared error of leaving one out for each penalty."""

    classes: list
    coefficients: np.ndarray
    intercepts: np.ndarray
    penalty: float
    errors: dict[float, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """(ts_id, prediction) of rows (ts_id, indices, values): the class of the greatest score, the first on ties."""
        shared = rows.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = shared.value
            for batch in batches:
                best = [np.argmax(x @ w.T + b, axis=1) for _, x in _dense(batch, w.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column("ts_id"), pa.array(np.concatenate(best) if best else np.zeros(0, np.int64), pa.int32())], names=["ts_id", "k"])

        found = _arrays(rows).select("ts_id", "indices", "values").mapInArrow(run, "ts_id long, k int")
        names = F.lit(self.classes) if self.classes else F.array()
        return found.select("ts_id", F.get(names, F.col("k")).alias("prediction"))


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"indices": F.col("indices").cast("array<long>"), "values": F.col("values").cast("array<double>")})


def fit(rows: DataFrame, width: int, penalties: Sequence[float] = (0.1, 1.0, 10.0)) -> RidgeModel:
    """A model of rows (ts_id, indices, values, label): sparse features, of which there are width, and the class of each series.

    Targets are 1 for the class and -1 for others; features and targets are centred, so that there is an intercept. Rows
    with a null label are left out. As few classes as labels; both the classes and the width are bounded by what the driver holds.
    """
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features: at most {MOST_FEATURES}, as each task holds a square of them")
    rows = _arrays(rows.where("label is not null"))
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    if not classes:
        raise ValueError("no labelled rows")
    coded = rows.select("indices", "values", (F.array_position(F.lit(classes), F.col("label")) - 1).cast("int").alias("k"))
    c = len(classes)

    def extended(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k = batch.column("k").to_numpy()
        for first, x in _dense(batch, width):
            yield x, np.where(k[first : first + len(x), None] == np.arange(c), 1.0, -1.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: the products of all columns (features, targets and a one) with each other."""
        total = np.zeros((width + c + 1,) * 2)
        for batch in batches:
            for x, y in extended(batch):
                z = np.hstack([x, y, np.ones((len(x), 1))])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = coded.mapInArrow(products, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).copy()).treeReduce(np.add).reshape((width + c + 1,) * 2)
    n, mean = sums[-1, -1], sums[-1, :-1] / sums[-1, -1]
    centred = sums[:-1, :-1] - n * np.outer(mean, mean)
    values, basis = np.linalg.eigh(centred[:width, :width])
    values = np.maximum(values, 0.0)
    turned = basis.T @ centred[:width, width:]
    weights = {a: basis @ (turned / (values + a)[:, None]) for a in penalties}
    shared = rows.sparkSession.sparkContext.broadcast((basis, values, mean, weights))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: the squares of what each row's target is missed by if the row is left out, summed for each penalty."""
        basis, values, mean, weights = shared.value
        total = np.zeros(len(weights))
        for batch in batches:
            for x, y in extended(batch):
                x, y = x - mean[:width], y - mean[width:]
                along = (x @ basis) ** 2
                for i, (a, w) in enumerate(weights.items()):
                    share = 1 / n + (along / (values + a)).sum(1)
                    total[i] += (((y - x @ w) / np.maximum(1 - share, 1e-12)[:, None]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    missed = coded.mapInArrow(left_out, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).copy()).treeReduce(np.add)
    errors = {a: float(e / (n * c)) for a, e in zip(penalties, missed, strict=True)}
    best = min(penalties, key=lambda a: errors[a])
    w = weights[best].T
    return RidgeModel(classes, w, mean[width:] - w @ mean[:width], best, errors)
