"""Panels: one row per point (ts_id, signal_id, raw_pos, pos, value).

raw_pos counts all points of a signal from 0 in the order given; pos counts only those that are not missing, without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from serigraph.operators.ranks import numbered_within

KEYS = ["ts_id", "signal_id"]


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def placed_panel(rows: DataFrame, ts_id: Column, value: Column, order: Sequence[Column | str], signal_id: Column | None = None) -> DataFrame:
    """The panel of a table with its missing points: pos counts all points of a signal, and a missing one is null.

    Otherwise as long_panel(), which drops them.
    """
    numbered = _numbered(rows, ts_id, value, order, signal_id)
    return numbered.select(*KEYS, "raw_pos", F.col("raw_pos").alias("pos"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _numbered(rows: DataFrame, ts_id: Column, value: Column, order: Sequence[Column | str], signal_id: Column | None) -> DataFrame:
    signal = F.lit(0) if signal_id is None else signal_id
    named = [f"_o{i}" for i in range(len(order))]
    points = rows.select(ts_id.cast("long").alias("ts_id"), signal.cast("int").alias("signal_id"), value.cast("double").alias("value"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(named, order, strict=True)])
    return numbered_within(points, KEYS, named, F.coalesce(_present(F.col("value")), F.lit(False)), "raw_pos", "pos")


def long_panel(rows: DataFrame, ts_id: Column, value: Column, order: Sequence[Column | str], signal_id: Column | None = None) -> DataFrame:
    """The panel of a table: points of a signal in the given order, missing ones (null or NaN) dropped and the rest renumbered.

    The order must be total for stable results. Points are dealt in ranges of signal and order, so that a signal of any
    length is many tasks. Integer values become doubles. Rows with a null key form a signal of their own.
    """
    numbered = _numbered(rows, ts_id, value, order, signal_id)
    return numbered.where(_present(F.col("value"))).select(*KEYS, "raw_pos", "pos", "value")


def panel_of_arrays(rows: DataFrame, ts_id: Column, values: Column, signal_id: Column | None = None) -> DataFrame:
    """The panel of a table that holds a whole signal as an array; needs no shuffle. Null and NaN elements are dropped."""
    signal = F.lit(0) if signal_id is None else signal_id
    doubles = F.transform(values, lambda x, i: F.struct(i.cast("long").alias("raw_pos"), x.cast("double").alias("value")))
    kept = F.filter(doubles, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))
    points = rows.select(ts_id.cast("long").alias("ts_id"), signal.cast("int").alias("signal_id"), F.posexplode(kept).alias("pos", "point"))
    return points.select(*KEYS, "point.raw_pos", F.col("pos").cast("long").alias("pos"), "point.value")


def array_panel(panel: DataFrame) -> DataFrame:
    """(ts_id, signal_id, values): a row for each signal, its values in order of pos."""
    points = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return panel.groupBy(*KEYS).agg(F.transform(points, lambda p: p["value"]).alias("values"))


def length_profile(panel: DataFrame) -> DataFrame:
    """One row: n_signals, min_length, max_length and the number of signals of a series."""
    lengths = panel.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return lengths.agg(
        F.count("*").alias("n_signals"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), (F.max("signal_id") + 1).cast("int").alias("signals_per_series")
    )


def dilated(panel: DataFrame, dilation: int) -> DataFrame:
    """Every residue sub-signal of a dilation: residue = pos % dilation, and pos counts within it."""
    return panel.withColumn("residue", (F.col("pos") % dilation).cast("int")).withColumn("pos", F.expr(f"pos div {int(dilation)}"))
