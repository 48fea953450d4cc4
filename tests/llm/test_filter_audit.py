"""The audit of filters against a plain one, row by row."""

import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from serigraph.llm import filter_audit
from serigraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_fails(rows):
    """The set of filters that each row (doc_id, text, lang) fails, by the definitions."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def plain_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for (doc, _, lang), fails in zip(rows, plain_fails(rows), strict=True):
        parts[lang or ""].append((doc, fails))
    out = []
    for part, docs in parts.items():
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, name in enumerate(order, 1):
                gone = [d for d, fails in left if name in fails]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                unique = sum(fails == {name} for _, fails in docs)
                steps.append((name, "".join(order), step, len(left), len(gone), sum(name in f for _, f in docs) - len(gone), unique, sum(d in good for d in gone), sum(d in toxic for d in gone)))
        out += [(part, *row, shapley[name]) for name, *row in steps]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query_equals_plain_audit(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(QUERIES["op12_filter_audit"](spark, SF)) == plain_audit(rows, labels)


@pytest.fixture(params=["cold", "hot", "small"])
def limits(request, monkeypatch):
    """Also with every repeated text routed twice, and with tasks that compare next to nothing before."""
    if request.param != "cold":
        monkeypatch.setattr(filter_audit, "LEAST_HOT", 1)
        monkeypatch.setattr(filter_audit, "HOT_PARTS", 10**9)
    if request.param == "small":
        monkeypatch.setattr(filter_audit, "LOCAL_BYTES", 10)


def test_odd_rows(spark, limits):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(i, "copied text of a large group", "en") for i in range(60, 0, -1)]
    rows += [(7, "copied text of a large group", "en"), (1, "copied text of a large group", "de"), (100, None, None), (101, "", "en"), (None, "", "en"), (None, words, "fr"), (102, words, ""), (103, words.upper(), "fr")]
    rows += [(104, "x " * 200_000, "fr"), (105, "x " * 200_000, "fr"), (105, "x " * 200_000, "fr"), (106, "$ é" * 60, "fr"), (-5, words, None)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (104, 0, 1), (105, None, 1), (9999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).withColumns({c: F.lit("clash") for c in ("part", "mask", "h", "good", "kept")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    assert found(filter_audit.audit(docs, known)) == plain_audit(rows, [(d, q, t) for d, q, t in labels if d is not None])
    wanted = sorted(d for (d, _, _), fails in zip(rows, plain_fails(rows), strict=True) if "E" in fails)
    assert sorted(r["doc_id"] for r in filter_audit.duplicates(docs).collect()) == wanted


def test_texts_that_share_a_fingerprint_are_told_apart():
    rows = [((5, 0, d), (d, "", 0, t)) for d, t in [(1, "a"), (2, "b"), (2, "b"), (3, "a"), (4, "b")]]
    assert [again for *_, again in filter_audit._chains(rows)] == [False, False, False, True, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], none.schema)
    assert found(filter_audit.audit(one, labels)) == plain_audit([(1, "a", "en")], [])
