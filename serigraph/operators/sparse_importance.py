"""Importance as a base value for each feature and the cells that differ: sums and ranks without a row for each series and feature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serigraph.operators.ranks import running_sums
from serigraph.plans.planner import Config, config_table


@dataclass
class SparseImportance:
    """base (feature_idx, base), a row for each feature; cells (ts_id, feature_idx, f), those that are stored; series (ts_id), all of them.

    The importance of a feature in a series is that of its cell, or else its base.
    """

    base: DataFrame
    cells: DataFrame
    series: DataFrame

    def _counted(self) -> DataFrame:
        """One row: n_series."""
        return self.series.agg(F.count("*").alias("n_series"))

    def _held(self) -> DataFrame:
        return self.cells.join(self.base, "feature_idx")

    def totals(self) -> DataFrame:
        """(ts_id, total): the importance of all features of a series, from its cells alone."""
        return _with_one_row(self.series, self.base.agg(F.coalesce(F.sum("base"), F.lit(0.0)).alias("whole"))).join(
            self._held().groupBy("ts_id").agg(F.sum(F.col("f") - F.col("base")).alias("moved")), "ts_id", "left"
        ).select("ts_id", (F.col("whole") + F.coalesce("moved", F.lit(0.0))).alias("total"))

    def absent_scales(self, vocabulary: DataFrame, configs: list[Config]) -> DataFrame:
        """(ts_id, absent, weighted, scale): of the features without a cell sum(base), sum(base * window size), and what their bases are multiplied by, the one over the other; null where that is 0."""
        sizes = vocabulary.join(F.broadcast(config_table(vocabulary.sparkSession, configs)), "conf_idx").select("feature_idx", "window_size")
        sized = self.base.join(sizes, "feature_idx")
        whole = sized.agg(F.sum("base").alias("b"), F.sum(F.col("base") * F.col("window_size")).alias("bw"))
        own = self.cells.select("ts_id", "feature_idx").join(sized, "feature_idx").groupBy("ts_id").agg(F.sum("base").alias("own_b"), F.sum(F.col("base") * F.col("window_size")).alias("own_bw"))
        less = lambda all_, part: F.col(all_) - F.coalesce(F.col(part), F.lit(0.0))
        return _with_one_row(self.series, whole).join(own, "ts_id", "left").select("ts_id", less("b", "own_b").alias("absent"), less("bw", "own_bw").alias("weighted")).withColumn("scale", F.try_divide("absent", "weighted"))

    def rank_sums(self) -> DataFrame:
        """(feature_idx, n_cells, rank_sum, size_sum): over all series the sums of a feature's average-tie rank by falling size, and of its size abs(f).

        The rank of a size v in a series is what it is among all bases, less what the series' features count there by their
        bases, plus what they count by their cells. The first and the sums over all series come from running sums over the different
        sizes; the rest from the cells of each series alone.
        """
        held = self._held().select("ts_id", "feature_idx", F.abs("f").alias("f"), F.abs("base").alias("b"))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        # of each different size: bases, cells' sizes and cells' bases that have it
        sizes = (
            self.base.select(F.abs("base").alias("v"), one.alias("bases"), zero.alias("cells"), zero.alias("gone"))
            .unionByName(held.select(F.col("f").alias("v"), zero.alias("bases"), one.alias("cells"), zero.alias("gone")))
            .unionByName(held.select(F.col("b").alias("v"), zero.alias("bases"), zero.alias("cells"), one.alias("gone")))
            .groupBy("v").agg(*[F.sum(c).alias(c) for c in ("bases", "cells", "gone")])
        )
        above = running_sums(sizes.withColumn("order", -F.col("v")), ["order"], ["bases", "cells", "gone"])
        # of a size: what is greater counts 1, what equals it a half
        beyond = lambda c: F.col(f"{c}_before") + F.col(c) / 2
        placed = above.select("v", beyond("bases").alias("among"), (beyond("cells") - beyond("gone")).alias("moved"))
        local = held.groupBy("ts_id").agg(F.collect_list(F.struct("feature_idx", "f", "b")).alias("cells")).select("cells").mapInArrow(_moved, "feature_idx long, f double, at_f double, at_b double")
        stored = local.join(placed.select(F.col("v").alias("f"), "among"), "f").groupBy("feature_idx").agg(
            F.count("*").alias("n_cells"), F.sum(F.col("among") + F.col("at_f") + 0.5).alias("own"), F.sum("at_b").alias("off"), F.sum("f").alias("sizes")
        )
        every = _with_one_row(self.base.withColumn("v", F.abs("base")), self._counted()).join(placed, "v").join(stored, "feature_idx", "left")
        n = F.coalesce("n_cells", F.lit(0))
        rest = F.col("n_series") - n
        ranks = rest * (F.col("among") + 0.5) + F.col("moved") - F.coalesce("off", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))
        return every.select("feature_idx", n.alias("n_cells"), ranks.alias("rank_sum"), (rest * F.col("v") + F.coalesce("sizes", F.lit(0.0))).alias("size_sum"), "n_series")

    def global_importance(self) -> DataFrame:
        """(feature_idx, f_sum, mean_rank) over all series, as explain.global_importance() has it for dense rows."""
        return self.rank_sums().select("feature_idx", F.col("size_sum").alias("f_sum"), F.try_divide("rank_sum", "n_series").alias("mean_rank"))

    def dense(self) -> DataFrame:
        """(ts_id, feature_idx, f): a row for each series and feature. The one sink that has them all; features are dealt to each series as a list."""
        listed = self.base.agg(F.collect_list(F.struct("feature_idx", "base")).alias("all"))
        rows = _with_one_row(self.series, listed).select("ts_id", F.explode("all").alias("x")).select("ts_id", "x.feature_idx", "x.base")
        return rows.join(self.cells, ["ts_id", "feature_idx"], "left").select("ts_id", "feature_idx", F.coalesce("f", "base").alias("f"))


def _with_one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row, which is broadcast."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the cells of a series: what its cells count beyond their sizes, and beyond their bases, more than its features' bases do."""
    for batch in batches:
        cells = batch.column("cells")
        bounds, flat = cells.offsets.to_numpy(), cells.values
        index, f, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("feature_idx", "f", "b"))
        out = [np.zeros(len(f)), np.zeros(len(f))]
        for i in range(batch.num_rows):
            own = slice(bounds[i], bounds[i + 1])
            sizes, bases = np.sort(f[own]), np.sort(b[own])
            for at, v in zip(out, (f[own], b[own]), strict=True):
                beyond = lambda x: len(x) - (np.searchsorted(x, v, side="left") + np.searchsorted(x, v, side="right")) / 2  # noqa: B023, E731
                at[own] = beyond(sizes) - beyond(bases)
        used = slice(bounds[0], bounds[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (index, f, *out)], names=["feature_idx", "f", "at_f", "at_b"])


def linear(features: DataFrame, coefficients: DataFrame, series: DataFrame) -> SparseImportance:
    """coefficient * (count - mean count) for features with a coefficient (feature_idx, coefficient): a cell where a series (ts_id) has the
    feature (ts_id, feature_idx, cnt), the base where it hasn't. Rows in proportion to the counts."""
    series = series.select("ts_id").distinct()
    held = features.groupBy("feature_idx").agg(F.sum("cnt").alias("total"))
    scales = _with_one_row(coefficients.join(held, "feature_idx", "left"), series.agg(F.count("*").alias("n")))
    scales = scales.select("feature_idx", "coefficient", F.try_divide(F.coalesce("total", F.lit(0)), "n").alias("mean"))
    f = lambda cnt: F.col("coefficient") * (cnt - F.col("mean"))
    cells = features.join(scales, "feature_idx").join(series, "ts_id", "left_semi").select("ts_id", "feature_idx", f(F.col("cnt")).alias("f"))
    return SparseImportance(scales.select("feature_idx", f(F.lit(0)).alias("base")), cells, series)

