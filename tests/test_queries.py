"""Every core query gives the rows of its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from serigraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, list):
        return tuple(map(plain, value))
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in wanted.fetchall()), key=key)
    assert a == b


def test_a_linear_model_on_the_bag(spark):
    row = QUERIES["classifier_accuracy"](spark, SF).first()
    assert row["held_out"] > 90 and row["accuracy"] >= 0.9


@pytest.mark.parametrize("most", [200_000, 5_999_999, 2**62])
def test_long_words_of_large_numbers(spark, tmp_path, most):
    spark.createDataFrame([(i,) for i in (0, 1, most - 1, most)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    for r in QUERIES["long_words"](spark, str(tmp_path)).collect():
        word = r["event_id"] * 46116860184274 % 2**62
        assert (r["word"], r["row"], r["col"]) == (word, word // 1000003, word % 1000003)
        assert r["symbols"] == [word >> 2 * (30 - i) & 3 for i in range(31)]


def test_uneven_means_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    windows = {1: [57.76, 80.04, 3.55, 18.31, 14.88, 8.93, 51.9, 20.49, 45.56, 2.73], 2: [10.86, 23.59, 26.85, 11.68, 117.56, 54.16, 30.46, 84.14, 124.5, 36.5]}
    rows = [(100 * u + i, i, u, "view", x[i // 2]) for u, x in windows.items() for i in range(19)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    wanted = sorted(con.execute(ORACLES["paa_uneven"]).fetchall())
    found = sorted((r["ts_id"], r["win_idx"], r["means"]) for r in QUERIES["paa_uneven"](spark, str(tmp_path)).collect())
    assert str(found) == str(wanted) and "-0.0," in str(wanted)  # 0.0 == -0.0
