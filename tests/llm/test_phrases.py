"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from serigraph.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=10, longest=3, best=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            inner = any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p))
            if not inner:
                score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def made(seed, n=400, words=12):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "A", "é", "ab", "日本", "x-y", "U.S", *[f"w{i}" for i in range(words)]]
    weights = [2.0 ** -(i / 3) for i in range(len(vocabulary))]
    return [("".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None, "", "und"])) for _ in range(n)]


@pytest.mark.parametrize("case", ["plain", "split pivots", "one slot", "longer phrases"])
def test_collocations_equal_plain_counting(spark, monkeypatch, case):
    if case == "split pivots":
        monkeypatch.setattr(phrases, "PIVOT_ROWS", 7)
    if case == "one slot":
        monkeypatch.setattr(phrases, "SLOTS", 1)  # every word has the same bound: the order is by hash alone
    rows = made(len(case))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    longest = 4 if case == "longer phrases" else 3
    wanted = plain(rows, longest=longest)
    assert found(phrases.collocations(docs, longest=longest)) == wanted and len(wanted) > 100


def test_one_very_common_pair_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIVOT_ROWS", 50)
    rows = [(f"hot pair {i % 90} a b", "en") for i in range(400)] + [("same same same same", "en")] * 5 + [(None, "en"), ("", None), ("... ,;", "fr"), ("k " * 30_000, "xx"), ("One two. One two", "de")] + [("p q, r s", "tt")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("word", "h", "n", "phrase", "dealt", "rank")})
    assert found(phrases.collocations(docs)) == plain(rows)
    assert found(phrases.collocations(docs, best=1)) == plain(rows, best=1)


def test_products_beyond_64_bits_are_exact(spark):
    a = 4_000_000_007
    df = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long")
    assert df.select(phrases.score_of(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()["s"] == 10**6 * a * a // ((a + 1) * (a + 2))


def test_fragments_are_counted_where_their_pivot_is(spark):
    docs = spark.createDataFrame(made(1), "text string, lang string")
    plan = phrases.collocations(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.parametrize(("longest", "pivot_rows", "mined"), [(2, 7, 1), (3, 7, 40), (3, 10_000, 1), (5, 50, 10)])
def test_groups_are_whole_whatever_is_mined_together(spark, monkeypatch, longest, pivot_rows, mined):
    for name, value in (("PIVOT_ROWS", pivot_rows), ("MINED", mined), ("PACKED", 4)):
        monkeypatch.setattr(phrases, name, value)
    rows = made(9)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    wanted = plain(rows, longest=longest)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found(phrases.collocations(docs, longest=longest)) == wanted and len(wanted) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_run_of_texts_gives_a_row_for_each_pivot(spark):
    docs = spark.createDataFrame([(f"w{i % 50} w{i % 7} hot w{i % 11} w{i % 13}", "en") for i in range(3000)], "text string, lang string").coalesce(1)
    table = spark.sparkContext.broadcast(phrases.frequency_table(phrases.word_counts(docs)))
    assert 10 < phrases.fragments(docs, table, 3).count() <= 51


def test_tuples_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "mixed", lambda h: h % np.uint64(2))
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 5, 300).astype(np.uint64) for _ in range(3)]
    order, first = phrases._sorted_runs(columns)
    counts = np.diff(first, append=len(order))
    tuples = list(zip(*(c.tolist() for c in columns), strict=True))
    assert {tuples[order[i]]: n for i, n in zip(first, counts, strict=True)} == Counter(tuples) and len(first) == len(set(tuples))


def test_hashes_of_words_are_those_of_their_letters(spark):
    t = phrases.Tokens([b"One two", "\tone é, TWO.one".encode(), b"", b"one"], ["en", "en", "fr", "fr"])
    one = {w: {int(t.hash[i]) for i in range(4) if t.words(np.array([i])) == [w]} for w in ("one", "two")}
    words = t.words(np.arange(len(t)))
    assert words == ["one", "two", "one", "é", "two", "one", "one"] and len(set(t.hash.tolist())) == 4
    assert one["one"] == {int(t.hash[5])} and one["two"] == {int(t.hash[4])} and t.hash[6] not in one["one"]


def test_words_that_share_a_hash_are_an_error(spark, monkeypatch):
    counted = phrases.word_counts
    monkeypatch.setattr(phrases, "word_counts", lambda docs: counted(docs).withColumn("h", F.lit(1).cast("long")))
    with pytest.raises(RuntimeError, match="hash"):
        phrases.collocations(spark.createDataFrame(made(2), "text string, lang string"))
