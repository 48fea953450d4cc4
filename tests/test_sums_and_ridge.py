"""Exact sums against rational numbers, and the ridge classifier against numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from serigraph.operators import bags, moving, ridge

INF, NAN = math.inf, math.nan


def test_sums_are_those_of_rational_numbers(spark):
    rng = random.Random(3)
    groups = {
        "small": [1e-12] * 1000, "far apart": [1e30, 1e-12, -1e30, 1.0, 5e-324, -1.0], "all sizes": [rng.choice((-1, 1)) * math.ldexp(rng.random(), rng.randrange(-1070, 1020)) for _ in range(300)],
        "cancel": [0.1, 0.2, -0.3, 1e16, -1e16], "powers of two": [s * 2.0**k for k in range(-1074, 1023) for s in (1, -1, 1)], "least": [5e-324] * 7, "ties": [1.0, 2.0**-53, 2.0**-106], "zeros": [0.0, -0.0], "most": [1.7e308, 1.7e308, -1.7e308],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("infinite", INF), ("infinite", 1.0), ("both", INF), ("both", -INF), ("nan", NAN), ("nan", 2.0), (None, 4.0), (None, None), ("beyond", 1.7e308), ("beyond", 1.7e308)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, x double").repartition(5)
    found = {r["k"]: r["total"] for r in moving.exact_sums(df, ["k"], "x").collect()}
    for k, vs in groups.items():
        assert found[k] == float(sum(map(Fraction, vs))), k
    assert found["infinite"] == INF and math.isnan(found["both"]) and math.isnan(found["nan"]) and found[None] == 4.0 and found["beyond"] == INF and "none" not in found
    assert moving.exact_sums(df.where("k = 'small'"), [], "x").first()["total"] == float(1000 * Fraction(1e-12))


def table(spark, x, y):
    rows = [(i, [int(j) for j in np.flatnonzero(v)], [float(v[j]) for j in np.flatnonzero(v)], None if k is None else str(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "ts_id long, indices array<long>, values array<double>, label string").repartition(4)


def test_ridge_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(ridge, "STEP", 50)
    rng = np.random.default_rng(8)
    x = rng.poisson(0.7, (60, 7)).astype(float)
    y = [str(k) for k in (x[:, 0] + 2 * x[:, 3] + rng.normal(size=60) > 2).astype(int) + (x[:, 5] > 1)]
    classes = sorted(set(y))
    target = np.where(np.array(y)[:, None] == classes, 1.0, -1.0)

    def solved(x, t, a):
        mean, level = x.mean(0), t.mean(0)
        w = np.linalg.solve((x - mean).T @ (x - mean) + a * np.eye(x.shape[1]), (x - mean).T @ (t - level))
        return w, level - mean @ w

    errors = {}
    for a in (0.1, 1.0, 10.0):
        missed = []
        for i in range(60):
            rest = np.arange(60) != i
            w, b = solved(x[rest], target[rest], a)
            missed.append((target[i] - x[i] @ w - b) ** 2)
        errors[a] = np.mean(missed)
    model = ridge.fit(table(spark, [*x, x[0]], [*y, None]), 7)
    assert model.classes == classes and all(np.isclose(model.errors[a], e) for a, e in errors.items()) and model.penalty == min(errors, key=errors.get)
    w, b = solved(x, target, model.penalty)
    assert np.allclose(model.coefficients, w.T) and np.allclose(model.intercepts, b)
    found = {r["ts_id"]: r["prediction"] for r in model.transform(table(spark, x, y)).collect()}
    assert [found[i] for i in range(60)] == [classes[k] for k in (x @ w + b).argmax(1)]


def test_ridge_of_odd_tables(spark):
    one = ridge.fit(table(spark, [[1.0, 0.0], [0.0, 0.0]], ["a", "a"]), 2)
    assert [r["prediction"] for r in one.transform(table(spark, [[5.0, 5.0]], [None])).collect()] == ["a"]
    assert one.transform(table(spark, [[0.0, 0.0]], [None]).where("false")).count() == 0
    with pytest.raises(ValueError):
        ridge.fit(table(spark, [[1.0, 0.0]], [None]), 2)
    with pytest.raises(ValueError):
        ridge.fit(table(spark, [[1.0, 0.0]], ["a"]), 10**6)


def test_vectors_and_back_without_text(spark):
    rows = spark.createDataFrame([(1, 5, [0, 3], [2.0, 1.5]), (2, 5, [], [])], "ts_id long, size int, indices array<long>, values array<double>")
    vectors = bags.sparse_vectors(rows)
    assert {r["ts_id"]: r["features"] for r in vectors.collect()} == {1: Vectors.sparse(5, {0: 2.0, 3: 1.5}), 2: Vectors.sparse(5, {})}
    assert "to_json" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    dense = spark.createDataFrame([(3, Vectors.dense([0.0, 4.0])), (None, Vectors.dense([1.0])), (4, None)], bags.VECTORS)
    cells = sorted(map(tuple, bags.from_vectors(vectors.union(dense)).collect()))
    assert cells == [(1, 0, 2.0), (1, 3, 1.5), (3, 1, 4.0)]
    assert vectors.where(F.col("features").isNull()).count() == 0
