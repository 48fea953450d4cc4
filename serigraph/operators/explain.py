"""Importance of features: by series, by position, by rank.

importance: (ts_id, feature_idx, f), dense: a row for each series and feature, f toward the predicted class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from serigraph.functions import encoding
from serigraph.operators import sparse_importance
from serigraph.plans.planner import Config, config_table
from serigraph.sources.panel import KEYS


def toward_prediction(importance: DataFrame, predictions: DataFrame, binary: bool = False) -> DataFrame:
    """importance of the class predicted: of (class_id, ts_id, feature_idx, f) the rows of y_pred in predictions (ts_id, y_pred).

    binary: importance has no classes and speaks for class 1; its sign is turned where 0 is predicted.
    """
    if binary:
        f = F.when(F.col("y_pred") == 0, -F.col("f")).otherwise(F.col("f"))
        return importance.join(predictions.select("ts_id", "y_pred"), "ts_id").select("ts_id", "feature_idx", f.alias("f"))
    chosen = predictions.select("ts_id", F.col("y_pred").alias("class_id"))
    return importance.join(chosen, ["ts_id", "class_id"]).select("ts_id", "feature_idx", "f")


def linear_attribution(features: DataFrame, coefficients: DataFrame, series: DataFrame) -> DataFrame:
    """(ts_id, feature_idx, f): coefficient * (count - mean count), for every feature with a coefficient (feature_idx, coefficient) and
    every one of series (ts_id), those that lack it included. As many rows as that makes; sparse_importance.linear() has only those of counts."""
    return sparse_importance.linear(features, coefficients, series).dense()


def records(points: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Covered points with their values, with the count of the feature in the series and the labels (ts_id, y_true, y_pred)."""
    return points.join(features, ["ts_id", "feature_idx"]).join(predictions, "ts_id")


def receptive_fields(vocabulary: DataFrame, configs: list[Config]) -> DataFrame:
    """The vocabulary with its configuration, symbols and plot positions."""
    table = F.broadcast(config_table(vocabulary.sparkSession, configs))
    joined = vocabulary.join(table, "conf_idx")
    symbols = encoding.symbols_of(F.col("word"), F.col("alphabet_size"), F.col("word_length"))
    positions = F.sequence(F.lit(0), F.col("window_size") * F.col("dilation") - 1, F.col("dilation"))
    return joined.select("feature_idx", "conf_idx", "signal_id", "word", "window_size", "dilation", "word_length", "stride", "alphabet_size", symbols.alias("symbols"), positions.alias("plot_pos"))


#: Positions of a block of signal.
BLOCK = 4_096


def _summed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For blocks of spans (dilation, start, stop, f, n): the sums of f and n of the spans over each position that has any.

    A span adds at its start and takes away at its stop; running sums along each residue of the dilation spread that.
    """
    for batch in batches:
        spans = batch.column("spans")
        bounds = spans.offsets.to_numpy()
        flat = spans.values
        d, start, stop, f, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("d", "start", "stop", "f", "n"))
        first, size = batch.column("first").to_numpy(), batch.column("size").to_numpy()
        of, pos, sums = [], [], []
        for i in range(batch.num_rows):
            own = slice(bounds[i], bounds[i + 1])
            low = start[own] - first[i]
            high, far = np.minimum(stop[own] - first[i], size[i] + d[own]), d[own]
            low = np.where(low < 0, low % far, low)  # it began in the block before: from its first position in this one
            length = int(min(size[i], high.max()))
            total, count = np.zeros(length), np.zeros(length, np.int64)
            for each in np.unique(far):
                some = far == each
                room = -(-(length + each) // each) * each
                at, to = low[some], np.minimum(high[some], room - 1)
                ends = high[some] < length
                for out, weight in ((total, f[own][some]), (count, n[own][some])):
                    steps = np.bincount(at, weight, room) - np.bincount(to[ends], weight[ends], room)
                    spread = steps.reshape(-1, each).cumsum(0).ravel()[:length]
                    out += spread if out is total else np.rint(spread).astype(np.int64)
            held = np.flatnonzero(count)
            of.append(np.full(len(held), i))
            pos.append(held + first[i])
            sums.append(total[held])
        if of:
            take = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([batch.column("ts_id").take(take), batch.column("signal_id").take(take), pa.array(np.concatenate(pos)), pa.array(np.concatenate(sums))], names=[*KEYS, "pos", "s"])


def covering_sums(occurrences: DataFrame, importance: DataFrame, configs: list[Config], count_overlapping: bool = True) -> DataFrame:
    """(ts_id, signal_id, pos, s): for each position under a window the importance of the words whose windows cover it.

    A word counts once for each window over the position, or once at all. Work and rows are in proportion to the windows, not to their
    points: windows are spans, each put into the one or two blocks of the signal that it reaches.
    """
    table = F.broadcast(config_table(occurrences.sparkSession, configs))  # as many rows as configurations
    placed = occurrences.join(importance, ["ts_id", "feature_idx"]).join(table, "conf_idx")
    start = (F.col("win_idx") * F.col("stride")).cast("long")
    spans = placed.select(*KEYS, "feature_idx", F.col("dilation").cast("long").alias("d"), start.alias("start"), (start + F.col("window_size") * F.col("dilation")).alias("stop"), "f")
    if not count_overlapping:  # the union of a word's windows: each ends where the next one of its residue starts
        following = F.lead("start").over(Window.partitionBy(*KEYS, "feature_idx", "d", F.col("start") % F.col("d")).orderBy("start"))
        spans = spans.withColumn("stop", F.least("stop", F.coalesce(following, F.col("stop"))))
    spans = spans.groupBy(*KEYS, "d", "start", "stop").agg(F.sum("f").alias("f"), F.count("*").alias("n"))
    size = max(BLOCK, max((c.span for c in configs), default=0))
    block = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - F.col("d")) / size)))
    held = spans.withColumn("block", block).groupBy(*KEYS, "block").agg(F.collect_list(F.struct("d", "start", "stop", "f", "n")).alias("spans"))
    rows = held.select(*KEYS, (F.col("block") * size).alias("first"), F.lit(size).cast("long").alias("size"), "spans")
    return rows.mapInArrow(_summed_spans, "ts_id long, signal_id int, pos long, s double")


def saliency(panel: DataFrame, occurrences: DataFrame, importance: DataFrame, configs: list[Config], count_overlapping: bool = True, normalise: bool = True) -> DataFrame:
    """(ts_id, signal_id, pos, s) for every point of the panel: the importance of the words whose windows cover it.

    A word counts once for each window over the point, or once at all. normalise: a series' saliency adds up to the
    importance of the words that it has; null where the sum is 0. A series whose importance over all features is 0 has
    zeros, as have points under no window.
    """
    totals = importance.groupBy("ts_id").agg(F.sum("f").alias("total")).where("total <> 0")
    raw = covering_sums(occurrences, importance, configs, count_overlapping).join(totals.select("ts_id"), "ts_id", "left_semi")
    if normalise:
        held = occurrences.select("ts_id", "feature_idx").distinct().join(importance, ["ts_id", "feature_idx"]).groupBy("ts_id").agg(F.sum("f").alias("held"))
        sums = raw.groupBy("ts_id").agg(F.sum("s").alias("sum"))  # aggregated, so that no task holds a series
        raw = raw.join(sums.join(held, "ts_id"), "ts_id").select(*KEYS, "pos", F.try_divide(F.col("s") * F.col("held"), "sum").alias("s"), F.lit(True).alias("hit"))
    else:
        raw = raw.withColumn("hit", F.lit(True))
    out = panel.select(*KEYS, "pos").join(raw, [*KEYS, "pos"], "left")
    return out.select(*KEYS, "pos", F.when(F.col("hit"), F.col("s")).otherwise(F.lit(0.0)).alias("s"))


def not_contained(importance: DataFrame, features: DataFrame, vocabulary: DataFrame, configs: list[Config]) -> DataFrame:
    """(ts_id, feature_idx, f, fn) of the features that a series lacks: fn = f * sum(f) / sum(f * window size) over them."""
    sizes = vocabulary.join(F.broadcast(config_table(vocabulary.sparkSession, configs)), "conf_idx").select("feature_idx", "window_size")
    lacking = importance.join(features.select("ts_id", "feature_idx"), ["ts_id", "feature_idx"], "left_anti").join(sizes, "feature_idx")
    sums = lacking.groupBy("ts_id").agg(F.sum("f").alias("sum"), F.sum(F.col("f") * F.col("window_size")).alias("weighted"))
    return lacking.join(sums, "ts_id").select("ts_id", "feature_idx", "f", F.try_divide(F.col("f") * F.col("sum"), "weighted").alias("fn"))


def ranked(importance: DataFrame) -> DataFrame:
    """importance with place, by falling abs(f) and feature, and avg_rank, in which ties share their mean rank."""
    size = F.abs("f")
    by = Window.partitionBy("ts_id").orderBy(size.desc())
    ties = F.count("*").over(Window.partitionBy("ts_id", size))
    place = F.row_number().over(Window.partitionBy("ts_id").orderBy(size.desc(), "feature_idx"))
    return importance.select("ts_id", "feature_idx", "f", place.alias("place"), (F.rank().over(by) + (ties - 1) / 2).alias("avg_rank"))


def global_importance(importance: DataFrame) -> DataFrame:
    """(feature_idx, f_sum, mean_rank): the sum of abs(f) and the mean of avg_rank over all series."""
    return ranked(importance).groupBy("feature_idx").agg(F.sum(F.abs("f")).alias("f_sum"), F.avg("avg_rank").alias("mean_rank"))


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n features of the best mean rank."""
    return global_importance(importance).orderBy("mean_rank", "feature_idx").limit(n)


def mapping_importance(vocabulary: DataFrame, importance: DataFrame, ts_ids: list[int] | None = None) -> DataFrame:
    """The vocabulary with the sum of abs(f) over all series, or those given."""
    chosen = importance if ts_ids is None else importance.where(F.col("ts_id").isin(ts_ids))
    sums = chosen.groupBy("feature_idx").agg(F.sum(F.abs("f")).alias("feature_importance"))
    return vocabulary.join(sums, "feature_idx", "left").withColumn("feature_importance", F.coalesce("feature_importance", F.lit(0.0)))


def by_signal(scored: DataFrame, vocabulary: DataFrame, score: Column) -> DataFrame:
    """(ts_id, signal_id, place, feature_idx): features of each signal by falling abs(score), nulls last."""
    place = F.row_number().over(Window.partitionBy("ts_id", "signal_id").orderBy(F.abs(score).desc_nulls_last(), "feature_idx"))
    return scored.join(vocabulary.select("feature_idx", "signal_id"), "feature_idx").select("ts_id", "signal_id", place.alias("place"), "feature_idx")
