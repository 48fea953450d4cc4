"""Importance by base and cells against dense rows."""

import numpy as np
import pytest

from serigraph.operators import explain, ranks, sparse_importance
from serigraph.plans.planner import Config


@pytest.mark.parametrize("seed", [1, 2])
def test_base_and_cells_equal_dense_rows(spark, seed):
    rng = np.random.default_rng(seed)
    base = {g: float(rng.integers(-3, 4)) for g in range(12)}  # many ties
    cells = {(s, g): float(rng.integers(-3, 4)) for s in range(9) for g in range(12) if rng.random() < 0.3 and s != 4}
    frame = spark.createDataFrame
    importance = sparse_importance.SparseImportance(
        frame(list(base.items()), "feature_idx long, base double"), frame([(*k, v) for k, v in cells.items()], "ts_id long, feature_idx long, f double").repartition(3), frame([(s,) for s in range(9)], "ts_id long")
    )
    dense = {(s, g): cells.get((s, g), base[g]) for s in range(9) for g in range(12)}
    assert {(r["ts_id"], r["feature_idx"]): r["f"] for r in importance.dense().collect()} == dense
    assert {r["ts_id"]: r["total"] for r in importance.totals().collect()} == {s: sum(dense[s, g] for g in range(12)) for s in range(9)}
    wanted = {r["feature_idx"]: (r["f_sum"], round(r["mean_rank"], 9)) for r in explain.global_importance(importance.dense()).collect()}
    assert {r["feature_idx"]: (r["f_sum"], round(r["mean_rank"], 9)) for r in importance.global_importance().collect()} == wanted
    configs = [Config(4, 1, 2), Config(8, 1, 2)]
    vocabulary = frame([(g, g % 2, 0, g) for g in range(12)], "feature_idx long, conf_idx int, signal_id int, word long")
    for r in importance.absent_scales(vocabulary, configs).collect():
        lacking = [(base[g], configs[g % 2].window_size) for g in range(12) if (r["ts_id"], g) not in cells]
        below = sum(b * w for b, w in lacking)
        assert r["scale"] == (pytest.approx(sum(b for b, _ in lacking) / below) if below else None)


def test_linear_attribution_has_rows_of_counts_alone(spark):
    features = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 1, 3)], "ts_id long, feature_idx long, cnt long")
    coefficients = spark.createDataFrame([(0, 2.0), (1, -1.0), (5, 3.0)], "feature_idx long, coefficient double")
    series = spark.createDataFrame([(1,), (2,), (3,), (3,)], "ts_id long")
    found = sparse_importance.linear(features, coefficients, series)
    assert found.cells.count() == 3 and found.base.count() == 3
    assert {(r["ts_id"], r["feature_idx"]): round(r["f"], 9) for r in found.dense().collect()} == {
        (1, 0): round(2 * (2 - 2 / 3), 9), (2, 0): round(-4 / 3, 9), (3, 0): round(-4 / 3, 9), (1, 1): round(4 / 3 - 1, 9), (2, 1): round(4 / 3 - 3, 9), (3, 1): round(4 / 3, 9), (1, 5): 0.0, (2, 5): 0.0, (3, 5): 0.0,
    }
    assert "Cartesian" not in found.global_importance()._jdf.queryExecution().executedPlan().toString()


def test_running_sums(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1009 as k", "id % 5 as x", "id % 2 as y")
    found = sorted(map(tuple, ranks.running_sums(rows, ["k"], ["x", "y"]).collect()))
    x = y = 0
    for k, a, b, before_x, before_y in found:
        assert (before_x, before_y) == (x, y)
        x, y = x + a, y + b
