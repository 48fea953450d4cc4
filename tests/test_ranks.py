"""Numbers by prefix scans of sorted partitions, and words from shared sums, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from serigraph.operators import ranks, sliding, words
from serigraph.plans.planner import Config, plan
from serigraph.sources import panel as panels

SHAPES = {
    "one signal": [(1, 0)] * 400, "signals over several partitions": [(k, 0) for k in (1, 2, 3) for _ in range(150)], "many short ones": [(k, k % 3) for k in range(300)],
    "short, long, short": [(0, 0), (None, 0), *[(5, 1)] * 500, (6, 0), (7, None)], "nothing": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_points_are_numbered_as_in_a_loop(spark, shape):
    rng = random.Random(5)
    rows = [(k, s, i * 7 % 1009, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(i)) for i, (k, s) in enumerate(SHAPES[shape])]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "ts_id long, signal_id int, t int, x double")
    found = panels.long_panel(df, F.col("ts_id"), F.col("x"), ["t"], F.col("signal_id"))
    wanted, raw, pos = [], {}, {}
    for k, s, t, x in sorted(rows, key=lambda r: r[2]):
        key = (k, s)
        if x is not None and x == x:
            wanted.append((k, s, raw.get(key, 0), pos.get(key, 0), x))
            pos[key] = pos.get(key, 0) + 1
        raw[key] = raw.get(key, 0) + 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_a_single_signal_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("ts_id"), F.rand(1).alias("t"), F.col("id").cast("double").alias("x"))
    sizes = [r["count"] for r in panels.long_panel(df, F.col("ts_id"), F.col("x"), ["t"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000


def test_words_are_numbered_over_sorted_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("a"), F.lit(3).alias("b"))
    found = ranks.numbered(df, ["b", "a"], "n").collect()
    assert [r["n"] for r in sorted(found, key=lambda r: r["a"])] == list(range(5_000))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 12, 100, 300])
def test_spans_equal_loops(size):
    v = np.random.default_rng(size).normal(size=300)
    for f, plain in ((np.add, np.sum), (np.maximum, np.max), (np.minimum, np.min)):
        assert np.allclose(sliding.spans(v, {size, 3}, f)[size][: 301 - size], [plain(v[i : i + size]) for i in range(301 - size)])
    assert np.allclose(sliding.placed_sums(v, size)[: 301 - size], [np.dot(np.arange(size), v[i : i + size]) for i in range(301 - size)])


SIGNALS = {
    "normal": lambda rng, n: rng.normal(size=n), "few values, with ties": lambda rng, n: rng.integers(0, 4, n).astype(float), "nearly flat": lambda rng, n: np.where(rng.random(n) < 0.9, 0.1, 0.1 + rng.normal(size=n) * 1e-12),
    "far from 0": lambda rng, n: 1e9 + rng.normal(size=n), "steps": lambda rng, n: np.repeat(rng.normal(size=n // 10 + 1), 10)[:n], "of all sizes": lambda rng, n: np.exp(rng.normal(size=n) * 8),
    "tiny": lambda rng, n: rng.normal(size=n) * 1e-300, "huge": lambda rng, n: rng.normal(size=n) * 1e150,
}


@pytest.mark.parametrize("kind", SIGNALS)
def test_words_from_shared_sums_are_those_of_points(kind):
    rng = np.random.default_rng(2)
    signals = [SIGNALS[kind](rng, int(rng.integers(1, 200))) for _ in range(30)]
    lengths = [len(s) for s in signals]
    row, each = np.repeat(np.arange(30), lengths), lambda f: np.repeat([f(s) for s in signals], lengths)
    points = words.Points(np.concatenate([np.arange(n) for n in lengths]), np.concatenate(signals), row, np.cumsum(lengths)[row], np.full(len(row), 10**9), each(np.std), each(lambda s: s.max() == s.min()))
    configs = [*plan(100, 100, alphabets=range(2, 6)), Config(12, 3, 3, 1, 4), Config(10, 2, 5, 2, 9)]
    kernel = words.Kernel(points, configs)
    for config in configs:
        starts = points.starts(config)
        for ratio in (0.0, 0.3):
            plain = words.window_words(points.value, starts, config, points.std[starts], points.constant[starts], ratio)
            assert (kernel.words(starts, config, ratio) == plain).all()


def test_classic_words_of_even_segments_and_of_uneven_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=60)]) for i in range(20)]
    panel = panels.panel_of_arrays(spark.createDataFrame(rows, "id long, x array<double>"), F.col("id"), F.col("x"))
    even = Config(8, 2, 4, 2)
    assert words.classic_words(panel, even).exceptAll(words.words(panel, even)).count() == 0
    found = {(r["ts_id"], r["win_idx"]): r["word"] for r in words.classic_words(panel, Config(10, 1, 4)).collect()}
    assert len(found) == 20 * 51
    cuts = [-0.4307273521948292, 0.4307273521948291]
    for (i, k), word in found.items():
        x = np.array(rows[i][1][k : k + 10])
        z = [(x[a:b].mean() - x.mean()) / x.std() for a, b in ((0, 2), (2, 5), (5, 7), (7, 10))]
        assert word == int("".join(str(sum(c <= v for c in cuts)) for v in z), 3)
