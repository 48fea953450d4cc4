"""Where words occur: from windows back to positions of the signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from serigraph.plans.planner import Config, config_table
from serigraph.sources.panel import KEYS


def segment_starts(win_idx: Column, word_length: int, segment: int, dilation: int = 1) -> Column:
    """First position of each segment of a window of stride 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(word_length - 1)), lambda j: win_idx + j * segment * dilation)


def segment_positions(win_idx: Column, j: Column | int, config: Config) -> Column:
    """Positions of segment j of a window."""
    start = win_idx * config.stride + j * (config.segment * config.dilation)
    return F.transform(F.sequence(F.lit(0), F.lit(config.segment - 1)), lambda k: start + k * config.dilation)


def window_positions(win_idx: Column, config: Config) -> Column:
    """Positions of a window, an array for each segment."""
    return F.transform(F.sequence(F.lit(0), F.lit(config.word_length - 1)), lambda j: segment_positions(win_idx, j, config))


#: Windows whose numbers one row of an index can hold.
SPAN = 4_096


def inverted_index(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """(ts_id, signal_id, conf_idx, word, block, n, offsets): the windows of each word, in blocks of span window numbers.

    offsets are the numbers less block * span, in order and small: a word that a long signal repeats has many rows, none of more than
    span numbers.
    """
    block = F.call_function("div", F.col("win_idx"), F.lit(span))
    placed = windows.select(*KEYS, "conf_idx", "word", block.alias("block"), (F.col("win_idx") - block * span).cast("int").alias("offset"))
    rows = placed.groupBy(*KEYS, "conf_idx", "word", "block").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    return rows.select(*KEYS, "conf_idx", "word", "block", F.size("offsets").alias("n"), "offsets")


def indexed_windows(index: DataFrame, span: int = SPAN) -> DataFrame:
    """(ts_id, signal_id, conf_idx, word, win_idx): the windows that an index holds."""
    rows = index.select(*KEYS, "conf_idx", "word", "block", F.explode("offsets").alias("offset"))
    return rows.select(*KEYS, "conf_idx", "word", (F.col("block") * span + F.col("offset")).cast("long").alias("win_idx"))


def lookup(windows: DataFrame, queries: DataFrame) -> DataFrame:
    """Windows of the words asked for: queries (query_idx, conf_idx, signal_id, word); a query without any keeps a row of nulls."""
    return queries.join(windows, ["conf_idx", "signal_id", "word"], "left").select("query_idx", "conf_idx", "signal_id", "word", "ts_id", "win_idx")


def occurrences(windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(feature_idx, ts_id, signal_id, conf_idx, win_idx): the windows of every word in the vocabulary."""
    return windows.join(vocabulary, ["conf_idx", "signal_id", "word"]).select("feature_idx", *KEYS, "conf_idx", "win_idx")


def covered(occurrences: DataFrame, configs: list[Config]) -> DataFrame:
    """Occurrences with k and pos: a row for each of the window's points."""
    table = F.broadcast(config_table(occurrences.sparkSession, configs))  # as many rows as configurations
    k = F.explode(F.sequence(F.lit(0), F.col("window_size") - 1))
    at = F.col("win_idx") * F.col("stride") + F.col("k") * F.col("dilation")
    return occurrences.join(table, "conf_idx").withColumn("k", k).withColumn("pos", at.cast("long")).drop("window_size", "dilation", "word_length", "stride", "alphabet_size")


def with_values(covered: DataFrame, panel: DataFrame) -> DataFrame:
    """Covered points with their value and raw position."""
    return covered.join(panel.select(*KEYS, "pos", "raw_pos", "value"), [*KEYS, "pos"])
