"""Moving statistics of signals: window frames over (ts_id, signal_id) in order of pos. A dilated panel has residues."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import DoubleType

from serigraph.operators import sliding
from serigraph.sources.panel import KEYS


def signal_window(panel: DataFrame) -> WindowSpec:
    keys = [*KEYS, "residue"] if "residue" in panel.columns else KEYS
    return Window.partitionBy(*keys).orderBy("pos")


def trailing(window: WindowSpec, size: int) -> WindowSpec:
    return window.rowsBetween(-(size - 1), 0)


def move_diff(value: Column, window: WindowSpec, size: int) -> Column:
    """Difference to the first value of the frame; null before a frame is complete."""
    return value - F.lag(value, size - 1).over(window)


def move_mean(value: Column, window: WindowSpec, size: int) -> Column:
    """Mean of the last size values, of fewer at the start."""
    return F.avg(value).over(trailing(window, size))


def move_sum(value: Column, window: WindowSpec, size: int, complete: bool = False) -> Column:
    total = F.sum(value).over(trailing(window, size))
    return F.when(F.row_number().over(window) >= size, total) if complete else total


def move_var(value: Column, window: WindowSpec, size: int, ddof: int = 0) -> Column:
    """Variance of complete frames, null before; 0 where no degree of freedom is left or all values are equal."""
    frame = trailing(window, size)
    flat = F.max(value).over(frame) == F.min(value).over(frame)
    scale = size / (size - ddof) if ddof < size else 0.0
    var = F.when(flat, F.lit(0.0)).otherwise(F.var_pop(value).over(frame) * scale)
    return F.when(F.row_number().over(window) >= size, var)


def move_std(value: Column, window: WindowSpec, size: int, ddof: int = 0) -> Column:
    return F.sqrt(move_var(value, window, size, ddof))


#: Bits of a limb, and the limb of the lowest that a double has; sums of limbs stay whole for 2**39 rows.
LIMB, LOWEST = 24, -46


@F.pandas_udf(DoubleType())
def _sum_of_limbs(limbs: pd.Series) -> pd.Series:
    """The double nearest to a sum of limbs (k, s), each s * 2 ** (LIMB * k)."""

    def one(parts: Sequence[dict]) -> float:
        total = sum(int(p["s"]) << LIMB * (int(p["k"]) - LOWEST) for p in parts)
        try:
            return total / (1 << -LIMB * LOWEST)  # whole numbers: rounded once
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    return limbs.map(one)


def exact_sums(rows: DataFrame, keys: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """(keys, name): the double nearest to the exact sum of value by keys, in whatever order rows come and however far apart they are.

    A value is cut into whole limbs on a fixed grid of powers of two, without loss; limbs of one place are added as whole
    numbers, in each task first, and the sum is rounded once at the end. Nulls don't count; a sum of nothing is null. NaN, and
    infinities of both signs, make NaN; a sum beyond the range of double is infinite.
    """
    x = F.col("_x")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_x")).where(x.isNotNull())
    finite = F.abs(x) < float("inf")
    powers = F.lit([2.0 ** (LIMB * k) for k in range(LOWEST, 43)])
    power = lambda k: F.get(powers, (k - LOWEST).cast("int"))
    # the place of the lowest limb: two bits to spare, as a logarithm may be off by one
    low = F.greatest(F.floor((F.floor(F.log2(F.abs(x))) - 54) / LIMB), F.lit(LOWEST))
    # in two steps, since one power may be beyond a double
    half = F.floor(F.col("_low") / 2)
    scaled = x / power(half) / power(F.col("_low") - half)
    plain = finite & (x != 0)
    placed = rows.withColumn("_low", F.when(plain, low)).withColumn("_y", F.when(plain, scaled))
    y, limbs = F.col("_y"), []
    for k in (3, 2, 1, 0):
        part = (F.signum(y) * F.floor(F.abs(y) / 2.0 ** (LIMB * k))).cast("long")
        limbs.append(F.struct((F.col("_low") + k).cast("int").alias("k"), part.alias("s")))
        y = y - part.cast("double") * 2.0 ** (LIMB * k)
    nothing = F.struct(F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("s"))
    cut = placed.select(*keys, F.explode(F.when(plain, F.array(*limbs)).otherwise(F.array(nothing))).alias("_limb"), F.when(~plain, x).alias("_odd"))
    summed = cut.groupBy(*keys, F.col("_limb.k").alias("_k")).agg(F.sum("_limb.s").alias("_s"), F.sum("_odd").alias("_odd"))
    held = F.filter(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_s").alias("s"))), lambda p: p["k"].isNotNull())  # as many as a double has places
    whole = summed.groupBy(*keys).agg(held.alias("_limbs"), F.sum("_odd").alias("_odd"))
    # zeros alone are neither odd nor have limbs
    return whole.select(*keys, F.when(F.isnan("_odd") | (F.abs("_odd") == float("inf")), F.col("_odd")).otherwise(_sum_of_limbs("_limbs")).alias(name))


def move_cov(x: Column, y: Column, window: WindowSpec, size: int) -> Column:
    """Population covariance of complete frames, null before."""
    frame = trailing(window, size)
    return F.when(F.row_number().over(window) >= size, F.covar_pop(x, y).over(frame))


def move_slope(x: Column, y: Column, window: WindowSpec, size: int) -> Column:
    """Slope of y on x in complete frames; null where x is constant."""
    return F.try_divide(move_cov(x, y, window, size), move_var(x, window, size))


#: Positions that one row of blocks holds, at least.
BLOCK = 4_096


def moving_statistics(panel: DataFrame, size: int, ddof: int = 0) -> DataFrame:
    """The panel with diff, mean, sum, var, std and the slope over pos of each trailing frame.

    Points are dealt into blocks with the size - 1 points before them, so that a signal of any length is many tasks, and all
    frames of a block share their sums (sliding.py): a long frame costs no more than a short one. mean and sum are of fewer points at
    the start of a signal, the others null there; var is 0 where all points are equal or no degree of freedom is left.
    """
    keys = [*KEYS, "residue"] if "residue" in panel.columns else KEYS
    block = max(BLOCK, size)
    own = F.floor(F.col("pos") / block)
    homes = F.when(F.col("pos") % block > block - size, F.array(own, own + 1)).otherwise(F.array(own))
    rest = [c for c in panel.columns if c not in keys]
    runs = panel.withColumn("_block", F.explode(homes)).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*rest)).alias("_points"))
    # a block that has only points of the one before has no frames
    runs = runs.where(F.exists("_points", lambda p: p["pos"] >= F.col("_block") * block)).select(*keys, (F.col("_block") * block).alias("_first"), "_points")
    scale = size / (size - ddof) if ddof < size else 0.0
    names, kept = ("diff", "mean", "sum", "var", "std", "slope"), panel.columns

    def statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column("_points")
        lengths = points.value_lengths().to_numpy()
        flat, row = points.flatten(), np.repeat(np.arange(len(lengths)), lengths)
        pos = flat.field("pos").to_numpy()
        order = np.lexsort((pos, row))
        pos, value = pos[order], flat.field("value").to_numpy()[order]
        first = np.cumsum(lengths) - lengths
        center = np.repeat(np.add.reduceat(value, first) / lengths, lengths)
        # a frame that starts before its signal, or before another block's points, starts among zeros
        gap = np.repeat((np.arange(len(lengths)) + 1) * (size - 1), lengths)
        at = np.arange(len(pos)) + gap
        wide, raw = np.zeros(len(pos) + (size - 1) * len(lengths)), np.zeros(len(pos) + (size - 1) * len(lengths))
        wide[at], raw[at] = value - center, value
        start = at - (size - 1)
        sums = sliding.spans(wide, {size})[size][start]
        squares = sliding.spans(wide * wide, {size})[size][start]
        most, least = (sliding.spans(raw, {size}, f)[size][start] for f in (np.maximum, np.minimum))
        n = np.minimum(np.arange(len(pos)) - np.repeat(first, lengths) + 1, size)
        full = n == size
        mean = sums / n
        var = np.maximum(squares / size - mean * mean, 0.0)
        # where the difference of squares leaves too little, from the points
        near = np.flatnonzero(full & (most > least) & (squares / size > 1e4 * var))
        for k in range(0, len(near), max(1, 1_000_000 // size)):
            some = near[k : k + max(1, 1_000_000 // size)]
            x = raw[start[some, None] + np.arange(size)]
            var[some] = ((x - x.mean(1, keepdims=True)) ** 2).mean(1)
        var = np.where(most == least, 0.0, var) * scale
        spread = (size * size - 1) / 12
        slope = (sliding.placed_sums(wide, size)[start] / size - (size - 1) / 2 * mean) / spread if spread else np.full(len(pos), np.nan)
        out = (value - raw[start], mean + center, sums + n * center, var, np.sqrt(var), slope)
        wanted = np.flatnonzero(pos >= batch.column("_first").to_numpy()[row])
        take, of = pa.array(order[wanted]), pa.array(row[wanted])
        columns = [batch.column(c).take(of) if c in keys else flat.field(c).take(take) for c in kept]
        for name, x in zip(names, out, strict=True):
            columns.append(pa.array(x[wanted], mask=np.zeros(len(wanted), bool) if name in ("mean", "sum") else ~full[wanted] | (np.isnan(x[wanted]) if name == "slope" else False)))
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliding.bounded(batch, "_points"):
                yield statistics(part)

    kinds = ", ".join(f"`{c}` {panel.schema[c].dataType.simpleString()}" for c in panel.columns)
    return runs.mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}")
