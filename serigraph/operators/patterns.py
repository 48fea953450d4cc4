"""Summaries of a feature's occurrences. points: (feature_idx, ts_id, signal_id, win_idx, k, pos, value), k the place in the window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serigraph.operators.ranks import numbered_within
from serigraph.sources.panel import KEYS
from serigraph.sources.storage import checkpoint

OCCURRENCE = ["feature_idx", *KEYS, "win_idx"]
#: Occurrences of a feature that one row holds at most; those that a task gathers before it deals them out; numbers of a numpy step.
BLOCK, GATHERED, STEP = 4_096, 100_000, 1_000_000
#: Occurrences of a feature that the first round of medoids() asks about.
PIVOTS = 16
#: Columns of a row of occurrences: their series, signals, windows and points.
HELD = ["ts", "signal", "win", "others"]


def standardised(panel: DataFrame) -> DataFrame:
    """The panel with z, the value's normal score in its signal; 0 in a constant one."""
    stats = panel.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.max("value") == F.min("value")).alias("constant"))
    z = F.when(F.col("constant"), F.lit(0.0)).otherwise(F.try_divide(F.col("value") - F.col("mean"), "std"))
    return panel.join(stats, KEYS).select(*panel.columns, z.alias("z"))


def normalised(points: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """points with z = (value - mean) / (std + epsilon) within the occurrence."""
    own = Window.partitionBy(*OCCURRENCE)  # as many rows as the window has points
    return points.withColumn("z", (F.col("value") - F.avg("value").over(own)) / (F.stddev_pop("value").over(own) + epsilon))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each of shares): exact percentiles of value by keys (whole numbers), between two values in proportion.

    Values are numbered within their keys over sorted ranges of keys and value, and only those of the wanted numbers are kept: no task
    holds the values of a key, however many these are. Null values don't count.
    """
    x = rows.select(*keys, F.col(value).alias("_x")).where("_x is not null").withColumn("_order", F.col("_x"))
    placed = numbered_within(x, keys, ["_order"], F.lit(True), "_n", "_seen").drop("_seen")
    sizes = placed.groupBy(*keys).agg(F.max("_n").alias("_last"))
    at = {name: F.col("_last") * q for name, q in shares.items()}
    wanted = [p for c in at.values() for p in (F.floor(c), F.ceil(c))]
    kept = placed.join(sizes, keys).where(F.col("_n").isin(*wanted))
    pick = lambda p: F.max(F.when(F.col("_n") == p, F.col("_x")))
    out = kept.groupBy(*keys, "_last").agg(*[f(c).alias(f"{side}_{n}") for n, c in at.items() for side, f in (("low", lambda c: pick(F.floor(c))), ("high", lambda c: pick(F.ceil(c))))])
    return out.select(*keys, *[(F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * (c - F.floor(c))).alias(n) for n, c in at.items()])


def place_summary(points: DataFrame) -> DataFrame:
    """For each feature: the median start (floor), the least and the greatest position covered."""
    spans = points.groupBy(*OCCURRENCE).agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    ends = spans.groupBy("feature_idx").agg(F.min("start").alias("least_pos"), F.max("stop").alias("greatest_pos"))
    middle = percentiles(spans, ["feature_idx"], "start", {"median": 0.5}).select("feature_idx", F.floor("median").alias("median_start"))
    return middle.join(ends, "feature_idx").select("feature_idx", "median_start", "least_pos", "greatest_pos")


def shape_summary(points: DataFrame, value: str = "value") -> DataFrame:
    """For each feature and k: the mean, median and quartiles of the values."""
    means = points.groupBy("feature_idx", "k").agg(F.avg(value).alias("mean"))
    return means.join(percentiles(points, ["feature_idx", "k"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), ["feature_idx", "k"]).select("feature_idx", "k", "mean", "q25", "median", "q75")


def _held(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, signal, win, others): runs of at most BLOCK occurrences of a feature (keys, ts_id, signal_id, win_idx, x), others their x one after the other.

    Each task makes runs of what it has, so nothing is shuffled.
    """
    ids = [*KEYS, "win_idx"]

    def dealt(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        table = table.take(pa.array(np.lexsort([table.column(k).to_numpy() for k in reversed(keys)])))
        column = {c: pa.concat_arrays(table.column(c).chunks) for c in table.column_names}
        n = table.num_rows
        of = np.stack([column[k].to_numpy() for k in keys])
        new = np.concatenate([[True], (of[:, 1:] != of[:, :-1]).any(0)])
        starts = np.flatnonzero((np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]) % BLOCK == 0)
        ends = np.append(starts, n)
        at = np.concatenate([[0], np.cumsum(column["x"].value_lengths().to_numpy())])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column[c]) for c in ids]
        lists.append(pa.ListArray.from_arrays(pa.array(at[ends], pa.int32()), column["x"].flatten()))
        return pa.RecordBatch.from_arrays([*(column[k].take(pa.array(starts)) for k in keys), *lists], names=[*keys, *HELD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                n += batch.num_rows
            if n >= GATHERED:
                yield dealt(some)
                some, n = [], 0
        if n:
            yield dealt(some)

    lists = ", ".join(f"{n} array<{rows.schema[c].dataType.simpleString()}>" for n, c in zip(HELD, [*ids, "x"], strict=True) if c != "x")
    return rows.select(*dict.fromkeys([*keys, *ids, "x"])).mapInArrow(run, f"{_kinds(rows, keys)}, {lists}, others array<double>")


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _each(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Each row of held occurrences, their points (a row for each), and its other columns of doubles."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = row.column("ts").value_lengths()[0].as_py()
            yield row, row.column("others").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), [row.column(c).flatten().to_numpy(zero_copy_only=False) for c in columns]


def _added(held: DataFrame, keys: list[str], given: Sequence[str], made: Sequence[str], of: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(keys, made): arrays of doubles that of() makes of the points of each run and the columns given, added up by keys in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, pa.RecordBatch] = {}
        sums: dict[tuple, list[np.ndarray]] = {}
        for row, x, more in _each(batches, given):
            key = tuple(row.column(k)[0].as_py() for k in keys)
            rows.setdefault(key, row)
            parts = of(x, *more)
            sums[key] = [a + b for a, b in zip(sums[key], parts, strict=True)] if key in sums else parts
        if sums:
            task = pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32())
            lists = [pa.array([v[i].tolist() for v in sums.values()], pa.list_(pa.float64())) for i in range(len(made))]
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([r.column(k) for r in rows.values()]) for k in keys), task, *lists], names=[*keys, "task", *made])

    parts = held.select(*keys, *HELD, *given).mapInArrow(run, f"{_kinds(held, keys)}, task int, " + ", ".join(f"{c} array<double>" for c in made))
    every = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("task", *made))).alias("every"))
    add = lambda c: F.aggregate("every", F.array().cast("array<double>"), lambda a, p: F.when(F.size(a) == 0, p[c]).otherwise(F.zip_with(a, p[c], lambda x, y: x + y)))
    return every.select(*keys, *[add(c).alias(c) for c in made])


def _asked(width: int, asked: np.ndarray, mean: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Points at which the sum of distances and its gradient are taken: occurrences, and the same drawn to the mean as near as the best known one is."""
    c = asked.reshape(-1, width)
    if not len(best):
        return c
    off = np.sqrt(((c - mean) ** 2).sum(1))
    near = np.minimum(1.0, np.sqrt(((best - mean) ** 2).sum()) / np.where(off > 0, off, 1.0))
    return np.concatenate([c, mean + (c - mean) * near[:, None]])


def _sums(x: np.ndarray, asked: np.ndarray, mean: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
    """The sums of distances from x to each point asked, and their gradients there."""
    c = _asked(x.shape[1], asked, mean, best)
    total, gradient = np.zeros(len(c)), np.zeros(c.shape)
    step = max(1, STEP // max(1, c.size))
    for at in range(0, len(x), step):
        d = c - x[at : at + step, None]
        r = np.sqrt((d * d).sum(2))
        total += r.sum(0)
        gradient += (d / np.where(r > 0, r, 1.0)[:, :, None]).sum(0)
    return [total, gradient.ravel()]


def _scored(held: DataFrame, keys: list[str], given: Sequence[str], of: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """held with score, of the occurrences that of() keeps; it returns a mask and scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, more in _each(batches, given):
            kept, score = of(x, *more)
            at = pa.array(np.flatnonzero(kept))
            if len(at):
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                lists = [one(row.column(c).flatten().take(at)) for c in HELD[:-1]]
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in keys), *lists, one(pa.array(x[kept].ravel())), one(pa.array(score[kept]))], names=[*keys, *HELD, "score"])

    return held.select(*keys, *HELD, *given).mapInArrow(run, f"{_kinds(held, [*keys, *HELD])}, score array<double>")


def _chosen(held: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, asked): the x of k different occurrences, one after the other: those of the lowest scores, and others from anywhere, told by digits of their sums."""
    half = k // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, pa.RecordBatch] = {}
        found: dict[tuple, dict[bytes, tuple]] = {}
        for row, x, (score,) in _each(batches, ["score"]):
            anywhere = np.modf(np.abs(x @ np.sqrt(np.arange(2, x.shape[1] + 2))) * 1e4)[0]
            for lowest, value in ((True, score), (False, anywhere)):
                key = (*(row.column(c)[0].as_py() for c in keys), lowest)
                rows.setdefault(key, row)
                own: dict[bytes, tuple] = {}
                for i in np.argsort(value, kind="stable").tolist():
                    own.setdefault(x[i].tobytes(), (float(value[i]), x[i]))
                    if len(own) == half:
                        break
                both = found.get(key, {}) | own
                found[key] = dict(sorted(both.items(), key=lambda v: (v[1][0], v[0]))[:half])
        if found:
            lists = [(rows[key], key[-1], s, v.tolist()) for key, own in found.items() for s, v in own.values()]
            columns = [pa.concat_arrays([r[0].column(c) for r in lists]) for c in keys]
            columns += [pa.array(c, t) for c, t in zip(list(zip(*lists, strict=True))[1:], (pa.bool_(), pa.float64(), pa.list_(pa.float64())), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "lowest", "value", "x"])

    some = held.select(*keys, *HELD, "score").mapInArrow(run, f"{_kinds(held, keys)}, lowest boolean, value double, x array<double>")
    some = some.groupBy(*keys, "lowest", "x").agg(F.min("value").alias("value"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("value", "x"))), 1, half)
    some = some.groupBy(*keys, "lowest").agg(F.transform(best, lambda p: p["x"]).alias("xs"))
    return some.groupBy(*keys).agg(F.flatten(F.array_distinct(F.flatten(F.collect_list("xs")))).alias("asked"))


def _left(width: int, asked: np.ndarray, mean: np.ndarray, best: np.ndarray, total: np.ndarray, gradient: np.ndarray, limit: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x may have a sum up to the limit, and what their sums are at least."""
    c = _asked(width, asked, mean, best)
    gradient = gradient.reshape(c.shape)
    with np.errstate(invalid="ignore"):
        planes = total - (gradient * c).sum(1) + x @ gradient.T
        rounding = 1e-9 * (total + (np.abs(gradient) * np.abs(c)).sum(1) + np.abs(x) @ np.abs(gradient).T)
        return ~((planes - rounding).max(1) > limit[0] * (1 + 1e-9)), planes.max(1)


def _begun(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Held occurrences, and (keys, mean) of each feature."""
    held = checkpoint(_held(rows, keys))
    sums = _added(held, keys, [], ["n", "total"], lambda x: [np.array([float(len(x))]), x.sum(0)])
    return held, checkpoint(sums.select(*keys, F.transform("total", lambda t: t / F.get("n", F.lit(0))).alias("mean")))


def _from_mean(held: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    near = lambda x, mean: (np.ones(len(x), bool), ((x - mean) ** 2).sum(1))
    return _scored(held.join(F.broadcast(means.select(*keys, "mean")), keys), keys, ["mean"], near)


def _sums_of(held: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked with total and gradient over all held occurrences of the feature."""
    given = ["asked", "mean", "best"]
    sums = _added(held.join(F.broadcast(asked.select(*keys, *given)), keys), keys, given, ["total", "gradient"], _sums)
    return asked.join(sums, keys)


def _best(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sum, x): the occurrences asked about and the sums of their distances."""
    width = F.size("mean")
    numbers = F.sequence(F.lit(0), (F.size("asked") / width).cast("int") - 1)
    each = sums.select(*keys, F.explode(F.transform(numbers, lambda i: F.struct(F.get("total", i).alias("sum"), F.slice("asked", i * width + 1, width).alias("x")))).alias("p"))
    return each.select(*keys, "p.sum", "p.x")


def _rounds(held: DataFrame, means: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, sum, x) of the least sums known, and the held occurrences that may still have a lesser one, after at most so many rounds of medoids_of()."""
    none = F.array().cast("array<double>")
    alive, known, turn = _from_mean(held, means, keys), None, 0
    given = ["asked", "mean", "best", "total", "gradient", "limit"]

    def still(x: np.ndarray, score: np.ndarray, asked: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, bound = _left(x.shape[1], asked, *more, x)
        for c in asked.reshape(-1, x.shape[1]):
            kept &= ~(x == c).all(1)
        return kept, np.maximum(score, bound) if turn else bound

    while turn != most:
        asked = checkpoint(_chosen(alive, keys, PIVOTS << min(turn, 4)))
        if asked.isEmpty():
            break
        asked = asked.join(means, keys)
        if known is not None:
            asked = asked.join(known.groupBy(*keys).agg(F.min("x").alias("best")), keys)
        sums = checkpoint(_sums_of(held, asked if known is not None else asked.withColumn("best", none), keys))
        found = _best(sums, keys)
        every = found if known is None else known.unionByName(found)
        least = every.groupBy(*keys).agg(F.min("sum").alias("least"))
        known = checkpoint(every.join(least, keys).where("sum <=> least").drop("least"))  # of sums that tie each stays
        limits = known.groupBy(*keys).agg(F.array(F.min("sum")).alias("limit"))
        alive = checkpoint(_scored(alive.join(F.broadcast(sums.join(limits, keys)), keys), keys, ["score", *given], still))
        turn += 1
    return known, alive


def _same(held: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, signal, win) of the held occurrences whose x is one of known's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, (tied,) in _each(batches, ["tied"]):
            at = pa.array(np.flatnonzero((x[:, None] == tied.reshape(-1, x.shape[1])).all(2).any(1)))
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([row.column(k)] * len(at)) for k in keys), *(row.column(c).flatten().take(at) for c in HELD[:-1])], names=[*keys, *HELD[:-1]])

    tied = known.groupBy(*keys).agg(F.flatten(F.collect_list("x")).alias("tied"))
    ids = ", ".join(f"{c} {held.schema[c].dataType.elementType.simpleString()}" for c in HELD[:-1])
    return held.join(F.broadcast(tied), keys).select(*keys, *HELD, "tied").mapInArrow(run, f"{_kinds(held, keys)}, {ids}")


def candidates(rows: DataFrame) -> DataFrame:
    """Of rows (feature_idx, ts_id, signal_id, win_idx, x) those whose sum of distances may be the least of their feature, after two rounds of medoids_of()."""
    keys = ["feature_idx"]
    held, means = _begun(rows, keys)
    known, alive = _rounds(held, means, keys, 2)
    each = alive.select(*keys, F.explode(F.arrays_zip(*HELD[:-1])).alias("p")).select(*keys, "p.*").unionByName(_same(held, known, keys))
    return rows.join(each.toDF(*OCCURRENCE), OCCURRENCE, "left_semi")


def medoids(points: DataFrame, value: str = "value") -> DataFrame:
    """For each feature the occurrence with the least sum of Euclidean distances to the others, and that sum; as medoids_of()."""
    rows = points.groupBy(*OCCURRENCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(value).alias("v")))), lambda p: p["v"]).alias("x"))
    return medoids_of(rows, ["feature_idx"]).select(*OCCURRENCE, "distance")


def medoids_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts_id, signal_id, win_idx, distance): of each feature, told by keys (whole numbers), the occurrence with the least sum of distances, and that sum.

    rows: (keys, ts_id, signal_id, win_idx, x). The sum is convex in x, so that at every x it is at least what the plane through
    the sum at another point, along the gradient there, has at x. In rounds the occurrences with the lowest such bounds, and
    some from anywhere, are asked about: their sums over all occurrences are taken, and those whose bound is above the least sum known are left out,
    until all have been asked about or left out. Rounds ask about PIVOTS occurrences of a feature, then twice as many each
    time. Occurrences stay where they are: what is asked, and the planes, go to them (by broadcast, at most 16 * PIVOTS times four
    points for each feature that is not settled). The first by series, signal and window wins ties.
    """
    held, means = _begun(rows, keys)
    known, _ = _rounds(held, means, keys)
    if known is None:
        known = means.select(*keys, F.lit(0.0).alias("sum"), F.col("mean").alias("x"))
    first = _same(held, known, keys).groupBy(*keys).agg(F.min(F.struct(*HELD[:-1])).alias("m"))
    ids = {"ts_id": "ts", "signal_id": "signal", "win_idx": "win"}
    sums = known.groupBy(*keys).agg(F.min("sum").alias("distance"))
    return first.join(sums, keys).select(*keys, *[F.col(f"m.{n}").alias(c) for c, n in ids.items() if c not in keys], "distance")


def word_curve(fields: DataFrame) -> DataFrame:
    """Receptive fields with curve: the word's symbols as normal scores, each repeated over its segment."""
    size = F.size("symbols")
    mean = F.aggregate("symbols", F.lit(0.0), lambda a, s: a + s) / size
    std = F.sqrt(F.aggregate("symbols", F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean)) / size)
    repeat = (F.col("window_size") / F.col("word_length")).cast("int")
    score = lambda s: F.coalesce(F.try_divide(s - mean, std), F.lit(0.0))
    return fields.withColumn("curve", F.flatten(F.transform("symbols", lambda s: F.array_repeat(score(s), repeat))))


def by_label(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """(feature_idx, y_pred, n_series, cnt): how often each pattern occurs in series of each predicted label."""
    return features.join(predictions.select("ts_id", "y_pred"), "ts_id").groupBy("feature_idx", "y_pred").agg(F.count("*").alias("n_series"), F.sum("cnt").alias("cnt"))


