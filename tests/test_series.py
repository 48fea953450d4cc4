"""Words, planning, encodings and the builder on small signals with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from serigraph.functions import encoding, symbols
from serigraph.operators import bags, explain, moving, patterns, words
from serigraph.plans.builder import BagBuilder
from serigraph.plans.planner import Config, logarithmic_stride, plan, window_sizes
from serigraph.sources import panel as panels

NAN = float("nan")
SIGNALS = [
    [5.0] * 10, [1.0] * 6 + [9.0] + [1.0] * 7, [1.0, 2.0, 3.0], [float(i) for i in range(10)], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0],
    [NAN, 2.0, 7.0, NAN, 1.0, 8.0, 2.0, 8.0, NAN, 1.0], [0.1] * 9 + [100.0, -100.0, 50.0], [NAN] * 5,
]
GOLDEN = {
    (4, 2, 1, 1, 3, 0.0): {0: {0: 7}, 1: {2: 2, 4: 7, 6: 2}, 3: {2: 7}, 4: {2: 2, 4: 5, 6: 2}, 5: {4: 4}, 6: {2: 1, 4: 7, 6: 1}},
    (4, 2, 2, 1, 3, 0.0): {0: {0: 4}, 1: {2: 2, 4: 4, 6: 2}, 3: {2: 4}, 4: {2: 2, 4: 3, 6: 1}, 5: {4: 1}, 6: {2: 2, 4: 3, 6: 1}},
    (4, 2, 1, 1, 3, 0.5): {0: {0: 7}, 1: {2: 2, 4: 7, 6: 2}, 3: {4: 7}, 4: {2: 2, 4: 6, 6: 1}, 5: {4: 4}, 6: {2: 1, 4: 7, 6: 1}},
    (4, 4, 1, 2, 4, 0.0): {0: {0: 4}, 1: {93: 1, 170: 4, 213: 1}, 3: {27: 4}, 4: {57: 1, 71: 1, 75: 1, 114: 1, 140: 1}, 5: {51: 2}, 6: {87: 1, 114: 1, 170: 3}},
    (4, 2, 1, 1, 2, 0.0): {0: {0: 7}, 1: {1: 2, 2: 2, 3: 7}, 3: {1: 7}, 4: {1: 5, 2: 2, 3: 2}, 5: {1: 2, 2: 1, 3: 1}, 6: {1: 1, 2: 2, 3: 6}},
    (3, 3, 3, 1, 3, 0.0): {0: {0: 4}, 1: {2: 1, 6: 1, 13: 5, 18: 1}, 3: {5: 4}, 4: {5: 1, 6: 2, 8: 1, 19: 2}, 5: {6: 1}, 6: {2: 2, 13: 3, 24: 1}},
}


@pytest.fixture(scope="module")
def panel(spark):
    rows = spark.createDataFrame(list(enumerate(SIGNALS)), "id long, x array<double>")
    return panels.panel_of_arrays(rows, F.col("id"), F.col("x")).persist()


def as_bags(rows):
    out = {}
    for r in rows:
        out.setdefault(r["ts_id"], {})[r["word"]] = r["cnt"]
    return out


@pytest.mark.parametrize("key", GOLDEN)
def test_golden_bags_by_frames_and_by_blocks(panel, key, monkeypatch):
    w, n, d, s, a, ratio = key
    config = Config(w, d, n, s, a)
    assert as_bags(bags.counted(words.words(panel, config, ratio)).collect()) == GOLDEN[key]
    assert as_bags(bags.bag(panel, [config], ratio).collect()) == GOLDEN[key]
    monkeypatch.setattr(words, "BLOCK", 3)  # signals over many blocks
    assert as_bags(bags.bag(panel, [config], ratio).collect()) == GOLDEN[key]


def test_constant_signal_can_have_the_middle_symbol(panel):
    found = words.words(panel.where("ts_id = 0"), Config(4, 1, 2), constant_is_middle=True)
    assert {r["word"] for r in found.collect()} == {4}


def test_long_panel_drops_missing_and_takes_integers(spark):
    rows = spark.createDataFrame([(1, 3, None), (1, 1, 7), (1, 2, 8), (1, 4, 9), (None, 1, 5)], "id long, t int, x int")
    found = panels.long_panel(rows, F.col("id"), F.col("x"), ["t"]).orderBy("ts_id", "pos").collect()
    assert [tuple(r) for r in found] == [(None, 0, 0, 0, 5.0), (1, 0, 0, 0, 7.0), (1, 0, 1, 1, 8.0), (1, 0, 3, 2, 9.0)]


def test_empty_panel(spark, panel):
    none = panel.where("false")
    assert bags.bag(none, [Config(4, 1, 2)]).count() == 0
    assert words.words(none, Config(4, 1, 2)).count() == 0
    assert BagBuilder().fit(none).width == 0


@pytest.mark.parametrize(("length", "n"), [(16, 15), (20, 15), (32, 24), (50, 24), (64, 33), (100, 33), (128, 42), (256, 62), (512, 74), (1000, 74)])
def test_planned_counts(length, n):
    assert len(plan(length, length)) == n


def test_plan_order_and_strides():
    first = [(c.window_size, c.stride, c.dilation, c.word_length, c.alphabet_size) for c in plan(100, 100)[:8]]
    assert first == [(4, 1, 1, 2, 3), (4, 1, 1, 4, 3), (4, 1, 2, 2, 3), (4, 1, 2, 4, 3), (4, 1, 4, 2, 3), (4, 1, 4, 4, 3), (8, 1, 1, 2, 3), (8, 1, 1, 4, 3)]
    assert all(c.stride == c.word_length for c in plan(100, 100, complexity="linear"))
    assert all(c.stride >= 1 for c in plan(100, 100, complexity="linear_logarithmic"))
    assert logarithmic_stride(100, 90, 50) is None and logarithmic_stride(100, 1, 1) == 1
    assert window_sizes(5, 64, least=8) == [4, 8, 16, 32, 64] and window_sizes(50, 64, least=8) == [8, 16, 32, 64]
    with pytest.raises(ValueError):
        plan(10, 10, complexity="cubic")


@pytest.mark.parametrize("bad", [Config(4, 1, 3), Config(2, 1, 4), Config(4, 1, 2, 1, 10), Config(4, 0, 2)])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        bad.checked()


def test_encodings_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(b, [int(x) for x in rng.integers(0, b, 8)]) for b in range(2, 10) for _ in range(20)]
    df = spark.createDataFrame(rows, "b int, s array<int>")
    word = encoding.word_of(F.col("s"), F.col("b"))
    checked = df.select("b", "s", word.alias("w"), encoding.symbols_of(word, F.col("b"), 8).alias("back"), encoding.decimal_of(F.col("s")).alias("dec"), encoding.greatest_word(F.col("b"), F.lit(8)).alias("most"))
    for r in checked.collect():
        assert r["back"] == r["s"] and r["w"] == int("".join(map(str, r["s"])), r["b"]) and r["w"] <= r["most"]
    three = checked.where("b = 3").select("w", encoding.rebased(F.col("dec"), 3).alias("again"), encoding.digits_rebased(F.col("dec"), 10, 3).alias("third")).collect()
    assert all(r["w"] == r["again"] == r["third"] for r in three)


def test_small_encodings(spark):
    one = spark.createDataFrame([([1, 2, 3, 5], [0, 0, 1, 0], 37)], "s array<int>, t array<int>, n long")
    c = F.col
    row = one.select(
        encoding.halved_word(c("s")).alias("hw"), encoding.halved_symbols(c("s")).alias("hs"), encoding.pair_symbol(F.lit(1), F.lit(2)).alias("pair"), encoding.pairs_decimal(c("s"), c("t")).alias("pairs"),
        encoding.prepended(c("n"), F.lit(4), F.lit(3)).alias("pre"), F.array(*encoding.unflattened(c("n"), 4, 5)).alias("at"), encoding.letters_of(F.lit([97, 98])).alias("text"), encoding.digit_count(c("n")).alias("digits"),
    ).first()
    assert (row["hw"], row["hs"], row["pair"], row["pre"], row["at"], row["text"], row["digits"]) == ([1, 4], [0, 1, 1, 2], 7, 4037, [1, 3, 2], "ab", 2)
    assert row["pairs"] == 1275  # pairs (1, 0) (2, 0) (3, 1) (5, 0)


def test_scores_and_symbols(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (3.0, 1.0, 2.0), (NAN, 1.0, 2.0)], "x double, m double, sd double")
    z = symbols.zscore(F.col("x"), F.col("m"), F.col("sd"))
    rows = df.select(z.alias("z"), symbols.symbol(z, 3).alias("s"), symbols.n_windows(F.lit(12), 4, 2, 3).alias("n"), symbols.negligible(F.col("sd"), F.lit(4.0), 0.6).alias("small")).collect()
    assert [r["z"] for r in rows[:2]] == [0.0, 1.0] and [r["s"] for r in rows] == [1, 2, -1]
    assert rows[0]["n"] == 2 and [r["small"] for r in rows] == [True, True, True]


def test_moving_window_edges(panel):
    rows = moving.moving_statistics(panel.where("ts_id in (0, 3)"), 3, ddof=1).orderBy("ts_id", "pos").collect()
    flat, ramp = rows[:10], rows[10:]
    assert flat[0]["std"] is None and flat[5]["std"] == 0.0 and flat[1]["mean"] == 5.0
    assert ramp[4]["diff"] == 2.0 and math.isclose(ramp[4]["std"], 1.0) and math.isclose(ramp[4]["slope"], 1.0) and ramp[1]["sum"] == 1.0


def test_builder_drops_unknown_words_and_makes_vectors(panel):
    known, new = panel.where("ts_id = 4"), panel.where("ts_id in (1, 4)")
    model = BagBuilder(configs=[Config(4, 1, 2), Config(4, 2, 2)], weights={1: 0.5}, steps=(lambda b: bags.summed_over(b, "none"),)).fit(known)
    assert model.width == model.vocabulary.count() == 6
    found = model.transform(new)
    assert found.where("feature_idx >= 3 and weight <> cnt / 2").count() == 0
    vectors = {r["ts_id"]: r["features"] for r in model.vectors(new).collect()}
    assert set(vectors) == {1, 4} and len(vectors[1]) == 6
    rows = bags.sparse_rows(found.select("ts_id", "feature_idx", "cnt"), model.width)
    assert bags.from_sparse(rows).exceptAll(found.select("ts_id", "feature_idx", "cnt")).count() == 0


def test_importance_of_the_predicted_class(spark):
    f = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], "ts_id long, feature_idx long, f double")
    said = spark.createDataFrame([(1, 0), (2, 1)], "ts_id long, y_pred int")
    assert {r["ts_id"]: r["f"] for r in explain.toward_prediction(f, said, binary=True).collect()} == {1: -2.0, 2: 3.0}
    each = f.withColumn("class_id", F.lit(1))
    assert [r["ts_id"] for r in explain.toward_prediction(each, said).collect()] == [2]


def test_standardised_and_word_curve(panel, spark):
    z = patterns.standardised(panel.where("ts_id in (0, 3)")).groupBy("ts_id").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()
    assert {r["ts_id"]: (round(r["m"], 9), round(r["s"], 9)) for r in z} == {0: (0.0, 0.0), 3: (0.0, 1.0)}
    fields = explain.receptive_fields(spark.createDataFrame([(0, 0, 0, 2)], "feature_idx long, conf_idx int, signal_id int, word long"), [Config(4, 1, 2)])
    assert patterns.word_curve(fields).first()["curve"] == [-1.0, -1.0, 1.0, 1.0]


def test_medoids_by_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 7, raising=False)
    rng = np.random.default_rng(1)
    x = {(f, i): rng.integers(0, 9, 4).astype(float) for f, n in ((13, 60), (14, 1), (15, 2)) for i in range(n)}
    rows = [(f, i, 0, 0, k, k, float(v)) for (f, i), values in x.items() for k, v in enumerate(values)]
    points = spark.createDataFrame(rows, "feature_idx long, ts_id long, signal_id int, win_idx long, k int, pos long, value double")
    sums = {key: sum(float(np.linalg.norm(v - w)) for (f, _), w in x.items() if f == key[0]) for key, v in x.items()}
    best = {f: min((round(d, 9), i) for (g, i), d in sums.items() if g == f) for f in (13, 14, 15)}
    found = patterns.medoids(points)
    assert {r["feature_idx"]: (round(r["distance"], 9), r["ts_id"]) for r in found.collect()} == best
    # no row for each pair: the occurrences of a feature meet arrays
    assert "others" in found._jdf.queryExecution().optimizedPlan().toString()


def test_normal_quantiles():
    known = {0.005: -2.575829, 0.025: -1.959964, 0.1: -1.281552, 0.25: -0.67449, 0.5: 0.0, 0.75: 0.67449, 0.9: 1.281552, 0.975: 1.959964}
    for p, z in known.items():
        assert round(symbols.normal_quantile(p), 6) == z and math.isclose(symbols.normal_quantile(p, 3.0, 3.5), 3 + 3.5 * symbols.normal_quantile(p))
    assert symbols.normal_quantile(0.0) == -math.inf and symbols.normal_quantile(1.0) == math.inf


#: A segment's mean ties with the window's in exact arithmetic: the order of sums decides the symbol.
TIES = [
    [8.47, 29.28, 34.29, 13.08, 21.96, 27.63, 30.94, 23.83], [5.34, 55.12, 23.58, 24.86, 27.66, 21.27, 16.5, 19.43], [38.39, 20.82, 17.4, 66.36, 14.49, 106.75, 61.09, 9.74],
    [35.53, 24.15, 91.68, 102.87, 83.0, 12.82, 29.63, 3.6],
]
PAIRED = Config(8, 1, 4, 2, 4)


def plain_word(x):
    """The word of a window of PAIRED, with sums from the first point to the last and Welford's variance."""
    mean = squares = total = 0.0
    for k, v in enumerate(x):
        total, moved = total + v, v - mean
        mean += moved / (k + 1)
        squares += (v - mean) * moved
    scores = [((x[j] + x[j + 1]) / 2 - total / 8) / math.sqrt(squares / 8) for j in range(0, 8, 2)]
    word = 0
    for z in scores:
        word = word * 4 + sum(b <= z for b in symbols.BREAKPOINTS[4])
    return word


@pytest.fixture(scope="module")
def ties(spark):
    rows = spark.createDataFrame([*enumerate(TIES), (9, [7.0] * 8)], "id long, x array<double>")
    return panels.panel_of_arrays(rows, F.col("id"), F.col("x")).persist()


def test_ties_with_a_breakpoint_are_those_of_sums_in_order(ties):
    found = bags.described(bags.bag(ties, [PAIRED]), [PAIRED], short=True).collect()
    assert {r["ts_id"]: r["word"] for r in found} == {i: plain_word(x) for i, x in enumerate(TIES)} | {9: 0}


def test_ties_beside_a_middle_constant(ties):
    found = bags.bag(ties, [PAIRED], constant_is_middle=True).collect()
    assert {r["ts_id"]: r["word"] for r in found} == {i: plain_word(x) for i, x in enumerate(TIES)} | {9: 0b10101010}


def test_ties_in_a_builder_with_a_least_ratio(ties):
    model = BagBuilder([PAIRED], least_ratio=0.3, constant_is_middle=True).fit(ties)
    words_ = {i: plain_word(x) for i, x in enumerate(TIES)} | {9: 0b10101010}
    number = {w: k for k, w in enumerate(sorted(set(words_.values())))}
    assert {r["ts_id"]: r["feature_idx"] for r in model.transform(ties).collect()} == {i: number[w] for i, w in words_.items()}
