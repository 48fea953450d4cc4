"""Explanations against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serigraph.operators import explain, moving, patterns
from serigraph.plans.planner import Config
from serigraph.sources import panel as panels


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize("overlapping", [True, False])
def test_covering_sums_equal_loops(spark, monkeypatch, block, overlapping):
    monkeypatch.setattr(explain, "BLOCK", block)
    rng = np.random.default_rng(7)
    configs = [Config(4, 1, 2), Config(3, 3, 3, 2), Config(5, 2, 5)]
    rows, f = set(), {(t, k): float(rng.integers(-9, 10)) for t in (1, 2) for k in range(6)}
    for _ in range(150):
        k = int(rng.integers(0, 6))
        rows.add((k, int(rng.integers(1, 3)), int(rng.integers(0, 2)), k // 2, int(rng.integers(0, 40))))
    occurrences = spark.createDataFrame(sorted(rows), "feature_idx long, ts_id long, signal_id int, conf_idx int, win_idx long")
    importance = spark.createDataFrame([(t, k, v) for (t, k), v in f.items()], "ts_id long, feature_idx long, f double")
    wanted, seen = {}, set()
    for k, t, s, c, w in sorted(rows):
        config = configs[c]
        for i in range(config.window_size):
            pos = w * config.stride + i * config.dilation
            if overlapping or (k, t, s, pos) not in seen:
                wanted[t, s, pos] = wanted.get((t, s, pos), 0.0) + f[t, k]
            seen.add((k, t, s, pos))
    found = explain.covering_sums(occurrences, importance, configs, overlapping)
    assert {(r["ts_id"], r["signal_id"], r["pos"]): r["s"] for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "window_size" in plan and plan.count("Generate") == 1  # blocks alone are generated


def test_no_occurrences(spark):
    none = spark.createDataFrame([], "feature_idx long, ts_id long, signal_id int, conf_idx int, win_idx long")
    importance = spark.createDataFrame([(1, 0, 2.0)], "ts_id long, feature_idx long, f double")
    panel = spark.range(3).select(F.lit(1).cast("long").alias("ts_id"), F.lit(0).alias("signal_id"), F.col("id").alias("pos"))
    assert [r["s"] for r in explain.saliency(panel, none, importance, [Config(4, 1, 2)]).collect()] == [0.0] * 3


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {(1, 0): rng.normal(size=700), (1, 1): rng.integers(0, 3, 50).astype(float), (2, 0): np.array([4.0]), (3, 5): np.array([1.0, 2.0])}
    rows = [(f, k, float(v)) for (f, k), x in groups.items() for v in x] + [(9, 9, None)]
    df = spark.createDataFrame(rows, "feature_idx long, k int, value double").repartition(5)
    found = patterns.percentiles(df, ["feature_idx", "k"], "value", {"a": 0.25, "b": 0.5, "c": 0.9})
    for r in found.collect():
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.quantile(groups[r["feature_idx"], r["k"]], [0.25, 0.5, 0.9]).tolist())
    assert found.count() == 4


@pytest.mark.parametrize("block", [1, 9, 4096])
@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_moving_statistics_equal_loops(spark, monkeypatch, block, size):
    monkeypatch.setattr(moving, "BLOCK", block)
    rng = np.random.default_rng(size)
    signals = {0: rng.normal(size=40), 1: np.array([2.0] * 20), 2: 1e6 + rng.normal(size=30), 3: rng.normal(size=3), 4: np.repeat(rng.normal(size=6), 5)}
    panel = panels.panel_of_arrays(spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "id long, x array<double>"), F.col("id"), F.col("x"))
    found = {(r["ts_id"], r["pos"]): r for r in moving.moving_statistics(panel, size, ddof=1).collect()}
    assert len(found) == sum(map(len, signals.values()))
    for (k, i), r in found.items():
        x = signals[k][max(0, i - size + 1) : i + 1]
        assert r["mean"] == pytest.approx(x.mean()) and r["sum"] == pytest.approx(x.sum()) and r["raw_pos"] == i
        if len(x) < size:
            assert r["diff"] is r["var"] is r["std"] is r["slope"] is None
            continue
        assert r["diff"] == x[-1] - x[0] and r["var"] == pytest.approx(x.var(ddof=1) if size > 1 else 0.0, rel=1e-6, abs=1e-12) and r["std"] == pytest.approx(r["var"] ** 0.5)
        assert r["slope"] == (pytest.approx(np.polyfit(range(size), x - x.mean(), 1)[0], abs=1e-6) if size > 1 else None)


def test_medoids_are_found_among_few_candidates(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 8)) * 20
    x = {(f, i): centres[int(rng.integers(0, 10))] + rng.normal(size=8) for f in (1, 2) for i in range(600)}
    rows = spark.createDataFrame([(f, i, 0, 0, [float(c) for c in v]) for (f, i), v in x.items()], "feature_idx long, ts_id long, signal_id int, win_idx long, x array<double>")
    left = {f: {r["ts_id"] for r in patterns.candidates(rows).where(F.col("feature_idx") == f).collect()} for f in (1, 2)}
    for f in (1, 2):
        own = np.array([x[f, i] for i in range(600)])
        sums = np.linalg.norm(own[:, None] - own[None], axis=2).sum(1)
        assert int(sums.argmin()) in left[f]
        # distances taken: of the pivots, of the row with the least bound, and of the candidates, against half of all pairs
        assert 600 * (patterns.PIVOTS + 1 + len(left[f])) < 600 * 600 / 2


def test_medoids_of_a_round_cluster_and_of_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 8))
    rows = spark.createDataFrame([(1, 5000 - i, 0, copy, [float(c) for c in v]) for i, v in enumerate(x) for copy in (4, 3)], "feature_idx long, ts_id long, signal_id int, win_idx long, x array<double>").persist()
    sums = 2 * np.linalg.norm(x[:, None] - x[None], axis=2).sum(1)
    # the planes of two rounds leave few of a round cluster
    assert patterns.candidates(rows).count() < 2400 / 4
    (found,) = patterns.medoids_of(rows, ["feature_idx"]).collect()
    assert (found["ts_id"], found["signal_id"], found["win_idx"]) == (5000 - int(sums.argmin()), 0, 3) and np.isclose(found["distance"], sums.min())
    assert patterns.medoids_of(rows.where("false"), ["feature_idx"]).count() == 0
