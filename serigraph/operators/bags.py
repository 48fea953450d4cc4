"""Bags of words: sparse counts, one row per (ts_id, signal_id, conf_idx, word) with a count above 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from serigraph.functions import encoding, symbols
from serigraph.operators.ranks import numbered
from serigraph.operators.words import grid_words
from serigraph.plans.planner import Config, config_table
from serigraph.sources.panel import KEYS

BAG = [*KEYS, "conf_idx", "word"]
FEATURE = ["conf_idx", "signal_id", "word"]


def bag(panel: DataFrame, configs: list[Config], least_ratio: float = 0.0, constant_is_middle: bool = False) -> DataFrame:
    """Counts of all words of all configurations; counted in each block before the shuffle."""
    return grid_words(panel, configs, least_ratio, counted=True, constant_is_middle=constant_is_middle).groupBy(*BAG).agg(F.sum("cnt").alias("cnt"))


def counted(words: DataFrame, *keys: str) -> DataFrame:
    """Counts of the words in a table of windows."""
    return words.groupBy(*(keys or [c for c in words.columns if c != "win_idx"])).agg(F.count("*").alias("cnt"))


def frequencies(bag: DataFrame, panel: DataFrame, configs: list[Config]) -> DataFrame:
    """The bag with freq, the count's share of the signal's windows."""
    lengths = panel.groupBy(*KEYS).agg(F.count("*").alias("length"))
    table = F.broadcast(config_table(bag.sparkSession, configs))  # as many rows as configurations
    windows = symbols.n_windows(F.col("length"), F.col("window_size"), F.col("dilation"), F.col("stride"))
    return bag.join(lengths, KEYS).join(table, "conf_idx").select(*BAG, "cnt", (F.col("cnt") / windows).alias("freq"))


def summed_over(bag: DataFrame, axis: str) -> DataFrame:
    """The bag summed over an axis: ts_id, signal_id or word."""
    return bag.groupBy(*[k for k in BAG if k != axis]).agg(F.sum("cnt").alias("cnt"))


def signal_groups(bag: DataFrame, groups: list[list[int]]) -> DataFrame:
    """The bag summed over groups of signals, which may overlap: signal_id becomes the number of the group."""
    members = F.transform(F.lit(list(range(len(groups)))), lambda g: g)
    inside = F.filter(members, lambda g: F.array_contains(F.get(F.lit([[*map(int, g)] for g in groups]), g), F.col("signal_id")))
    return bag.withColumn("signal_id", F.explode(inside)).groupBy(*BAG).agg(F.sum("cnt").alias("cnt"))


def described(bag: DataFrame, configs: list[Config], short: bool = False) -> DataFrame:
    """The bag keyed by the fields of its configuration, or short by the logarithms of window size and dilation."""
    table = F.broadcast(config_table(bag.sparkSession, configs))
    joined = bag.join(table, "conf_idx")
    if short:
        log = lambda c: F.floor(F.log2(c)).cast("int")
        keys = [*KEYS, log("window_size").alias("log_window"), log("dilation").alias("log_dilation"), "word"]
    else:
        keys = [*KEYS, "window_size", "word_length", "alphabet_size", "dilation", "stride", "word"]
    return joined.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def from_maps(rows: DataFrame, counts: Column, *keys: str) -> DataFrame:
    """Rows of counts from a column of maps word -> count."""
    return rows.select(*keys, F.explode(counts).alias("word", "cnt"))


def merged(bags: list[DataFrame]) -> DataFrame:
    """One bag of several: counts of equal keys add up."""
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out.groupBy(*BAG).agg(F.sum("cnt").alias("cnt"))


def weighted(bag: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The bag with weight, the count times the weight of its configuration (1 unless given)."""
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (int(k), float(v))]) if weights else None
    weight = F.lit(1.0) if table is None else F.coalesce(F.try_element_at(table, F.col("conf_idx")), F.lit(1.0))
    return bag.withColumn("weight", F.col("cnt") * weight)


def flattened(bag: DataFrame, configs: list[Config]) -> DataFrame:
    """(ts_id, conf_idx, flat_idx, cnt): signal and word in one index, signal_id * n_words + word."""
    table = F.broadcast(config_table(bag.sparkSession, configs))
    width = F.pow("alphabet_size", "word_length").cast("long")
    return bag.join(table, "conf_idx").select("ts_id", "conf_idx", encoding.flat_index(F.col("signal_id"), F.col("word"), width).alias("flat_idx"), "cnt")


def vocabulary(bag: DataFrame) -> DataFrame:
    """(feature_idx, conf_idx, signal_id, word): every word seen, numbered from 0 in that order, over sorted ranges of words."""
    return numbered(bag.select(*FEATURE).distinct(), FEATURE, "feature_idx").select("feature_idx", *FEATURE)


def features(bag: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(ts_id, feature_idx, cnt) of the words in the vocabulary; others are dropped."""
    return bag.join(vocabulary, FEATURE).select("ts_id", "feature_idx", "cnt")


def sparse_rows(features: DataFrame, width: int, series: DataFrame | None = None) -> DataFrame:
    """(ts_id, size, indices, values): the features of a series in order of index; of each of series (ts_id), if given, even without any."""
    cells = F.array_sort(F.collect_list(F.struct("feature_idx", "cnt")))
    rows = _of_every(features.groupBy("ts_id").agg(cells.alias("cells")), series, "cells")
    return rows.select("ts_id", F.lit(int(width)).alias("size"), F.transform("cells", lambda c: c["feature_idx"]).alias("indices"), F.transform("cells", lambda c: c["cnt"].cast("double")).alias("values"))


def _of_every(rows: DataFrame, series: DataFrame | None, column: str) -> DataFrame:
    """rows, and for the other series an empty array or map."""
    if series is None:
        return rows
    kind = rows.schema[column].dataType
    nothing = (F.create_map() if kind.typeName() == "map" else F.array()).cast(kind)
    return series.select("ts_id").distinct().join(rows, "ts_id", "left").withColumn(column, F.coalesce(column, nothing))


#: ts_id and a vector of pyspark.ml, which travels as the struct (type, size, indices, values).
VECTORS = StructType([StructField("ts_id", LongType()), StructField("features", VectorUDT())])
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def sparse_vectors(rows: DataFrame) -> DataFrame:
    """(ts_id, features) of sparse rows as sparse ML vectors: Arrow batches typed as the vector's struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.array([0] * batch.num_rows, pa.int8()), *(batch.column(c) for c in ("size", "indices", "values"))]
            vectors = pa.StructArray.from_arrays([p.cast(f.type) for p, f in zip(parts, _VECTOR, strict=True)], fields=list(_VECTOR))
            yield pa.RecordBatch.from_arrays([batch.column("ts_id"), vectors], names=["ts_id", "features"])

    return rows.select("ts_id", "size", "indices", "values").mapInArrow(run, VECTORS)


def from_vectors(vectors: DataFrame) -> DataFrame:
    """(ts_id, feature_idx, value) of the non-zero cells of ML vectors (ts_id, features), sparse or dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, value = [], [], []
            columns = [batch.column("features").field(c) for c in ("type", "indices", "values")]
            for ts, (kind, at, x) in zip(batch.column("ts_id").to_pylist(), zip(*columns, strict=True), strict=True):
                x = np.array(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0)
                at = at.values.to_numpy(zero_copy_only=False) if kind.as_py() == 0 else np.arange(len(x))
                held = np.flatnonzero(x)
                ids.append(np.full(len(held), ts, np.int64))
                index.append(at[held].astype(np.int64))
                value.append(x[held])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, index, value)], names=["ts_id", "feature_idx", "value"])

    return vectors.select(F.col("ts_id").cast("long").alias("ts_id"), "features").where("ts_id is not null and features is not null").mapInArrow(run, "ts_id long, feature_idx long, value double")


def from_sparse(rows: DataFrame) -> DataFrame:
    """(ts_id, feature_idx, cnt) of sparse rows."""
    return rows.select("ts_id", F.explode(F.arrays_zip("indices", "values")).alias("cell")).select("ts_id", F.col("cell.indices").alias("feature_idx"), F.col("cell.values").cast("long").alias("cnt"))


def dense_rows(features: DataFrame, width: int, series: DataFrame | None = None) -> DataFrame:
    """(ts_id, values): an array of width counts, 0 where a series lacks the feature; of each of series, if given."""
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("feature_idx").cast("long"), F.col("cnt").cast("double"))))
    every = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")) if width else F.array().cast("array<long>")
    rows = _of_every(features.groupBy("ts_id").agg(counts.alias("counts")), series, "counts")
    return rows.select("ts_id", F.transform(every, lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0.0))).alias("values"))
