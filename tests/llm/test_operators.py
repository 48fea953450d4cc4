"""Each operator against SQL, a brute-force version, an exact round trip or held-out labels, on the smallest tables."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from serigraph.llm import html_text, langid, mixing, near_vectors, ngram_join, packing, pii, quality, span_dedup, topk
from serigraph.llm._words import words_of
from serigraph.llm.queries import ORACLES, QUERIES, TOKENIZER

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the smallest has too few labels to learn from
DOC = "doc_id long, text string, source string, extra string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, text, lang, source from documents").fetchall()


def test_letters_beyond_the_basic_plane_are_told_apart():
    one, other = (langid.normalised(chr(c).encode()) for c in (0x20000, 0x20000 + 0x1900))
    assert len(one) == 4 and one.tolist() != other.tolist() and len(langid.normalised("a😀b".encode())) == 5
    assert len({tuple(langid.normalised(chr(c).encode()).tolist()) for c in range(0x20000, 0x20000 + 7000)}) == 7000


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the results."""
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(1, None, "a", "x"), (None, "some words here that have no id at all", None, None), (2, "", "a", None), (3, " \t\n", None, "y"), (4, long, "b", "z"), (5, long, "b", "z"), (5, long, "b", "z"), (6, "one two", "c", None)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("clash") for c in ("size", "copies", "score", "predicted", "lang_pred", "piece", "component_id", "spans", "n_removed", "rank", "x")})


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(wanted.fetchall())


def test_no_links_are_lost_among_many_near_copies(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(80)]
    texts = []
    for i in range(150):
        words = list(base) if i % 3 else [f"other{i % 7}_{k}" for k in range(60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [None, "", "short text", "Short TEXT"]
    worded = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in worded]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    wanted = {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == wanted
    size, ngram_join.TREE_SHINGLES = ngram_join.TREE_SHINGLES, 500  # components over many blocks
    try:
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == wanted
    finally:
        ngram_join.TREE_SHINGLES = size
    assert {r["doc_id"] for r in ngram_join.keep_one(docs).collect()} == {find(i) for i in range(len(texts))}


def test_hot_texts_and_shingles_are_dealt_evenly(spark, monkeypatch):
    """Half of the texts empty, a third copies, and shingles that every other text has."""
    rng = random.Random(8)
    common = " ".join(f"common{i}" for i in range(30))
    texts = [""] * 3000 + ["a text that is the same in very many rows of the table"] * 2000
    texts += [f"{common} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((2, 40)))) for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    worded = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in worded]
    near = [i for i in range(5000, 6000) if len(sets[i]) == 28]
    assert all(100 * len(sets[near[0]] & sets[i]) >= 80 * len(sets[near[0]] | sets[i]) for i in near)
    assert wanted == {(i, len(sets[i]), near[0] if i in set(near) else min(i, 3000) if 3000 <= i < 5000 else i) for i in range(6000)}
    for name, value in (("HOT_ONE_IN", 1), ("PART_SHINGLES", 2000), ("FLUSH", 5000)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("words"))
    size, count, hot = ngram_join._looked_over(rows, 5)
    assert count == 6000 and size == sum(map(len, texts)) and len(hot) == 26
    parts = int(max(size / 6, count) // 2000) + 1
    dealt = ngram_join._dealt(rows.repartition(4), 5, parts, spark.sparkContext.broadcast(hot))
    sizes = [r[0] for r in dealt.groupBy("part").agg(F.sum(F.coalesce(F.octet_length("tokens") / 8, F.lit(0)) + F.when(F.col("keys").isNull(), 1).otherwise(0))).select("sum((coalesce((octet_length(tokens) / 8), 0) + CASE WHEN (keys IS NULL) THEN 1 ELSE 0 END))").collect()]
    assert len(sizes) == parts and max(sizes) <= 2 * np.median(sizes)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == wanted


def test_keep_one_of_odd_rows(spark):
    """Rows that share an id but not a text are documents of their own; of repeated rows one stays; every column stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a, "p"), (1, a, "q"), (1, b, "p"), (2, a + " more", "p"), (3, b, "p"), (4, None, "p"), (4, None, "p"), (None, a, "p"), (None, a, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").withColumns({c: F.lit("clash") for c in ("words", "times", "kept_id", "kept_words", "row", "place")})
    first, again = (sorted((tuple(r) for r in ngram_join.keep_one(docs.repartition(k)).collect()), key=str) for k in (1, 5))
    assert first == again and ngram_join.keep_one(docs).columns == docs.columns
    assert sorted((r[0], (r[1] or "")[:2]) for r in first if r[0]) == [(1, "a0"), (1, "b0"), (4, ""), (4, "")] and len(first) == 6


def test_packing_is_exact_and_tight(spark, documents):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by_doc) == len(documents)
    for doc, text, *_ in documents:
        ids = np.array([*direct.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(p["length"] for p in by_doc[doc].values()) == len(ids)
        for k, p in by_doc[doc].items():
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == 2048 * k and zlib.crc32(part.tobytes()) == p["ids_crc32"]
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_personal_data_equals_the_patterns(spark, documents):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = {r["doc_id"]: r for r in QUERIES["op8_personal_data"](spark, SF).collect()}
    total = 0
    for doc, text, *_ in documents:
        base = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]
        total += len(base)
        assert found[doc]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[doc]["spans"].split(","))
    assert total > 20


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("iban: DE89 3704 0044 0532 0130 00 AND MORE", "account", "DE89 3704 0044 0532 0130 00"), ("my IBAN DE89370400440532013000.", "account", "DE89370400440532013000"), ("Konto Nr. 1234567890", "account", None),
        ("account number: 1234-5678-90", "account", "1234-5678-90"), ("passport no: X1234567", "account", "X1234567"), ("IBAN DE89 3704 0044 0532 0130 01", "account", None), ("IBAN XK051212012345678906", "account", "XK051212012345678906"),
        ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfi", "secret", "wJalrXUtnFEMI/K7MDENG/bPxRfi"), ("Authorization: Bearer abc123.def456==", "secret", "abc123.def456=="), ('{"apiKey": "a1b2c3d4e5"}', "secret", "a1b2c3d4e5"),
        ('token = "04dbebab91ab85687d33"', "secret", "04dbebab91ab85687d33"), ("PASSWORD: hunter22", "secret", "hunter22"), ("the token was lost and the secret kept", "secret", None), ("a bearer brings nothing", "secret", None), ("mytoken = abc1234", "secret", None),
        ("see https://joe:pa55word@host.example/x", "credential", "joe:pa55word"),
    ],
)
def test_added_kinds_of_personal_data(text, kind, value):
    spans = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text, pii._automaton()) if pii.KINDS[k] == kind]
    assert spans == ([(kind, value)] if value else [])
    clean = pii.redacted(text, pii.find_spans(text, pii._automaton()))
    assert (value is None) or (value not in clean and f"[{kind.upper()}]" in clean)


def test_language_on_held_out_rows(spark, documents):
    langs = {d: lang for d, _, lang, _ in documents}
    rows = [r for r in QUERIES["op7_language"](spark, SF).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert len(rows) > 20 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_probabilities_sum_to_one():
    keys, n = np.unique(langid.grams(langid.normalised(b"the cat sat on the mat and the dog sat too")), return_counts=True)
    model = langid.KneserNey.trained({"en": (keys, n)})
    last = np.unique(np.concatenate([keys & np.uint64(0xFFFF), [np.uint64(ord("z")), np.uint64(ord("q"))]]))
    context = keys[3] >> np.uint64(16)
    known = model.probability((context << np.uint64(16)) | last, langid.ORDER)[:, 0].sum()
    assert known <= 1 + 1e-9 + 2 * model.floor[0] and known > 0.9


def kneser_ney_by_force(texts):
    """A function from a text to its bits per 4-gram, by dictionaries alone."""
    from collections import Counter, defaultdict

    def cut(text):
        chars = [int(c) for c in langid.normalised(text.encode())]
        return [tuple(x) for x in zip(*(langid.grams(np.array(chars, np.uint64)) >> np.uint64(16 * k) & np.uint64(0xFFFF) for k in range(3, -1, -1)))] if chars else []

    counts = Counter(tuple(map(int, g)) for t in texts for g in cut(t))
    levels = []
    for order in range(4, 0, -1):
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        total, types = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        levels.append((dict(counts), ones / (ones + 2 * twos) if ones and twos else 0.5, total, types))
        counts = Counter({g for g in counts} and [g[1:] for g in counts])
    size = len(levels[-1][0])

    def p(g, level):
        if level == 4:
            return 1 / (size + 1)
        counts, discount, total, types = levels[level]
        lower = p(g[1:], level + 1)
        n = total.get(g[:-1], 0)
        return (max(counts.get(g, 0) - discount, 0) + discount * types[g[:-1]] * lower) / n if n else lower

    def bits(text):
        own = [tuple(map(int, g)) for g in cut(text)]
        return sum(-np.log2(p(g, 0)) for g in own) / len(own)

    return bits


def test_language_equals_kneser_ney_in_plain_python(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").where("doc_id < 120 and length(text) < 3000")
    rows = [r for r in docs.collect() if r["text"] and len(langid.normalised(r["text"].encode()))]
    learned = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    models = {c: kneser_ney_by_force([r["text"] for r in learned if r["lang"] == c]) for c in sorted({r["lang"] for r in learned})}
    model = langid.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in learned], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert len(models) > 2 and len(rows) > 50
    for r in rows:
        bits = {c: f(r["text"]) for c, f in models.items()}
        best = min(bits, key=bits.get)
        assert got[r["doc_id"]]["bits"] == pytest.approx(bits[best], rel=1e-4)
        assert bits[got[r["doc_id"]]["lang_pred"]] == pytest.approx(bits[best], rel=1e-4)


def test_language_models_hold_every_gram_and_language(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(300 + 100 * (i % 2))) for _ in range(13_000)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {c: np.concatenate([langid.grams(langid.normalised(t.encode())) for _, t, lang in rows if lang == c]) for c in "ab"}
    whole = langid.KneserNey.trained({c: np.unique(g, return_counts=True) for c, g in held.items()})
    assert len(whole.share_keys[-1]) > 400_000
    more = docs.unionByName(spark.createDataFrame([(90, "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(2_000)) + " other text", "a")], docs.schema))
    wanted = {}
    for i, t, _ in more.collect():
        keys, n = np.unique(langid.grams(langid.normalised(t.encode())), return_counts=True)
        wanted[i] = float((n @ -np.log2(whole.probability(keys, langid.ORDER))).min() / n.sum())
    for cells, parts in ((langid.PART_CELLS, 1), (300_000, 4)):
        monkeypatch.setattr(langid, "PART_CELLS", cells)
        model = langid.train(docs)
        assert len(getattr(model, "parts", [0])) >= parts
        got = {r["doc_id"]: r["bits"] for r in langid.identify(more, model).collect()}
        assert got == pytest.approx(wanted, rel=1e-5)
    monkeypatch.undo()
    many = spark.createDataFrame([(i, f"language {chr(0x4E00 + i) * 4}", f"l{i:03}") for i in range(230)], docs.schema)
    assert {r["doc_id"] for r in langid.identify(many, langid.train(many)).where("lang_pred = concat('l', lpad(doc_id, 3, '0'))").collect()} == set(range(230))


def test_quality_on_held_out_labels(spark, duck):
    truth = dict(duck.execute(f"select doc_id, max(quality) from '{MORE}/labels.parquet' group by doc_id").fetchall())
    rows = [r for r in QUERIES["op9_quality"](spark, MORE).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.85


def test_boosted_trees_in_plain_python(spark, duck):
    """Flat arrays score as trees walked node by node; the first split is the best of all; features are what they are called."""
    rng = np.random.default_rng(17)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0.2).astype(float)
    forest = quality.boosted(x, y, trees=5, depth=3)

    def walked(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walked(r) for r in x]) and np.mean((forest.score(x) > 0.5) == (y > 0)) > 0.85
    p = y.mean()
    best = (0, None, None)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= cut
            gains = [(y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 2.0) for m in (left, ~left)]
            if min(left.sum(), (~left).sum()) * p * (1 - p) >= 5.0 and sum(gains) > best[0] + 1e-9:
                best = (sum(gains), j, cut)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best[1:]
    texts = [t for (t,) in duck.execute("select text from documents where text is not null").fetchall()] + ["", " \n", "One"]
    got = quality.statistics([t.encode() for t in texts])
    for t, row in zip(texts, got):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", t.encode()) if w]
        if not words:
            assert not row.any()
            continue
        named = dict(zip(quality.FEATURES, row))
        assert named["log_words"] == pytest.approx(np.log1p(len(words))) and named["mean_word"] == pytest.approx(np.mean(list(map(len, words))))
        assert named["distinct_words"] == pytest.approx(len(set(words)) / len(words)) and named["one_byte_words"] == pytest.approx(np.mean([len(w) == 1 for w in words]))
        assert named["words_with_digit"] == pytest.approx(np.mean([any(48 <= c < 58 for c in w) for w in words]))


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    own = lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(12)) + "."
    passage = ". ".join(" ".join(word() for _ in range(10)) for _ in range(6)) + "."
    texts = [f"{own()} {passage} {own()}" for _ in range(3)] + [own() for _ in range(4)]
    rows = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["text"] == texts[0] and all(rows[i]["text"] == texts[i] for i in range(3, 7))
    for i in (1, 2):
        assert passage[20:-20] not in rows[i]["text"] and rows[i]["n_words_removed"] >= 40
        left, at = b"", 0
        for hole in rows[i]["removed"].split(","):
            a, b = map(int, hole.split(":"))
            left, at = left + texts[i].encode()[at:a], b
        assert (left + texts[i].encode()[at:]).decode() == rows[i]["text"]


def test_every_passage_over_50_words_is_found(spark):
    rng = random.Random(11)
    words = lambda n, stop=0: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + ("." if stop and i % stop == stop - 1 else "") for i in range(n))
    texts = []
    for k in range(600):
        passage = words(51, (0, 18, 11)[k % 3])
        texts += [f"{words(40)} {passage} {words(40)}" for _ in range(2)]
    rows = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[i]["n_removed"] == 0 for i in range(0, 1200, 2))
    assert [i for i in range(1, 1200, 2) if rows[i]["n_words_removed"] < 25] == []


def plain_sentences(text, longest=12):
    """(words, whether it starts a sentence) in plain Python; a sentence over the limit in pieces."""
    out = []
    for line in text.split("\n"):
        words, held = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w], []
        for k, w in enumerate(words):
            held.append(w)
            if re.search(r"[.!?][\"')\]]?$", w) or k == len(words) - 1:
                cuts = {len(held) - 1}
                if len(held) > longest:
                    h = words_of([" ".join(held).encode()]).hash.tolist()
                    for i in range(len(h) - longest + 1):
                        cuts |= {j for j in range(i, i + longest) if h[j] == min(h[i : i + longest])}
                at = 0
                for c in sorted(cuts):
                    out.append((tuple(held[at : c + 1]), at == 0))
                    at = c + 1
                held = []
    return out


def plain_runs(pieces, n=3, words=25):
    """Every run of n sentences; from each piece and to each sentence's end the shortest run of n pieces and so many words."""
    starts = [i for i, (_, first) in enumerate(pieces) if first] + [len(pieces)]
    for i, j in zip(starts, starts[n:]):
        yield i, j, tuple(p for p, _ in pieces[i:j])
    for j in starts[1:]:
        i = next((i for i in range(j - n, -1, -1) if sum(len(p) for p, _ in pieces[i:j]) >= words), None)
        if i is not None:
            yield i, j, tuple(p for p, _ in pieces[i:j])
    for i in range(len(pieces)):
        size = 0
        for j in range(i, len(pieces)):
            size += len(pieces[j][0])
            if j - i + 1 >= n and size >= words:
                yield i, j + 1, tuple(p for p, _ in pieces[i : j + 1])
                break


def test_repeated_spans_equal_brute_force(spark, duck):
    rows = duck.execute(f"select doc_id, text from '{MORE}/documents.parquet' order by doc_id").fetchall()
    rng = random.Random(7)
    passage = " ".join(f"w{rng.randrange(1000)}" for _ in range(60))
    rows += [(10**6 + k, f"Own text {k} here. {passage} and {k} more words" if k < 4 else f"Yes, {k}! {passage}. One. Two. Three. {passage}.") for k in range(8)]
    rows += [(10**6 + 10, f"x {passage}"), (10**6 + 11, f"Another start of {passage}")]  # no sentence but the last piece ends there
    pieces = {d: plain_sentences(t or "") for d, t in rows}
    first = {}
    for d, _ in rows:
        for i, _, key in sorted(plain_runs(pieces[d]), key=lambda r: r[0]):
            first.setdefault(key, (d, i))
    touched = 0
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        own = pieces[d]
        dead = [False] * len(own)
        for i, j, key in plain_runs(own):
            if first[key] != (d, i):
                dead[i:j] = [True] * (j - i)
        starts = [i for i, (_, begins) in enumerate(own) if begins] + [len(own)]
        for i, j in zip(starts, starts[1:]):
            if not all(dead[i:j]) and sum(len(w) for w, _ in own[i:j]) <= 50:
                dead[i:j] = [False] * (j - i)
        left = [w for (words, _), x in zip(own, dead) if not x for w in words]
        assert re.split(r"[\x20\x09-\x0D]+", (got[d]["text"] or "").strip(" \t\n\x0b\x0c\r") or " ")[0 if left else 1 :][: len(left)] == left or not left
        assert (got[d]["n_sentences"], got[d]["n_removed"]) == (len(own), sum(dead))
        touched += any(dead)
    assert touched > 60 and all(got[10**6 + k]["n_removed"] > 0 for k in range(1, 8))


def own_sentences(text):
    """(first byte, past-last byte, words) of each sentence, by one pattern over the text: no hash and no code of the library."""
    raw, at, out = text.encode(), 0, []
    for m in re.finditer(rb"(?<=[.!?])(?:[\"')\]])?[\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|\Z", raw):
        words = raw[at : m.end()].split()
        if words:
            out.append((at, m.end(), tuple(words)))
            at = m.end()
    return out


def removed_spans(row):
    return [tuple(map(int, hole.split(":"))) for hole in row["removed"].split(",") if hole]


def test_repeated_spans_keep_to_sentences(spark, duck):
    """Against sentences split here and compared as words: all repeated runs of three go, nothing that is not said elsewhere does."""
    rows = duck.execute(f"select doc_id, text from '{MORE}/documents.parquet' where text is not null order by doc_id").fetchall()
    got = {r["doc_id"]: removed_spans(r) for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    split = {d: own_sentences(t) for d, t in rows}
    first, n = {}, 0
    for d, _ in rows:
        for i in range(len(split[d]) - 2):
            first.setdefault(tuple(x[2] for x in split[d][i : i + 3]), (d, i))
    everything = b" \n ".join(b" ".join(t.encode().split()) for _, t in rows)
    for d, text in rows:
        gone = np.zeros(len(text.encode()) + 1, bool)
        for a, b in got[d]:
            gone[a:b] = True
        visible = ~np.isin(np.frombuffer(text.encode() + b" ", np.uint8), [32, *range(9, 14)])
        for i in range(len(split[d]) - 2):
            if first[tuple(x[2] for x in split[d][i : i + 3])] != (d, i):
                a, b = split[d][i][0], split[d][i + 2][1]
                assert (gone | ~visible)[a:b].all()
                n += 1
        starts = {a + len(text.encode()[a:]) - len(text.encode()[a:].lstrip()): len(w) for a, _, w in split[d]}
        for a, b in got[d]:
            inside = next(len(w) for x, y, w in split[d] if x <= a < y)
            assert a in starts or inside > 50
        for a, b, words in split[d]:
            if (gone | ~visible)[a:b].all() and len(words) <= 50:  # spans that overlap may cover it together
                own = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
                assert sum(everything.count(x) < 2 for x in own) <= 3
    assert n > 100


def test_short_sentences_and_equal_documents(spark):
    rows = [(i, "One two three. Four five six. Seven eight nine ten.") for i in range(4)] + [(10, "A b. C d. E f."), (11, "X y. A b. C d. E f. Z."), (12, "A b. C d."), (13, "A b. A b. A b. A b."), (20, None), (21, "")]
    got = {r["doc_id"]: r["text"] for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [rows[0][1], "", "", ""]
    assert got[10] == "A b. C d. E f." and got[11] == "X y. Z." and got[12] == "A b. C d." and got[13] == "A b. " and got[20] is None and got[21] == ""


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div><p>Shared offer of the site</p></div><article><h1>{0}</h1><p>Text &amp; more of {0}\n in one <b>block</b>.</p></article><div class='comments'><p>I disagree</p></div><footer>(c)</footer></body></html>"


def test_page_text(spark):
    pages = [(i, f"https://h.example/a/{i}", PAGE.format(f"story{i}"), "u") for i in range(4)] + [(9, None, None, None), (10, "https://h.example/a/1", "", "u")]
    rows = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert rows[2]["text"] == "story2 Text & more of story2 in one block." and rows[2]["n_chars"] == len(rows[2]["text"])
    assert rows[9]["text"] == "" and rows[10]["n_chars"] == 0 and len(rows) == 6


def test_pages_meet_the_nearest_of_the_whole_host(spark, monkeypatch):
    body = "<html><body><p>{0}</p><p>Own story number {1} with words enough to outweigh the notice {1} {1} {1} {1}</p></body></html>"
    urls = [f"https://h.example/s{i // 2:04}/{i % 2}" for i in range(1300)] + [f"https://q.example/index.php?id={i:04}" for i in range(30)] + ["https://z.example/x"] * 20
    notice = lambda i: f"Notice of section {i // 2}" if i < 1300 else "Notice"
    pages = spark.createDataFrame([(i, u, body.format(notice(i), i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    for size in (512, 7):
        monkeypatch.setattr(html_text, "GROUP_PAGES", size)
        rows = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
        assert len(rows) == len(urls) and [i for i in range(1330) if "Notice" in rows[i]] == []
        assert all("Notice" in rows[i] for i in range(1330, 1350))  # copies of one page have no partner


def html_text_address(url):
    bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "", url or "")
    host = bare.split("/")[0]
    return host.lower(), re.sub(r"(\.html?|/)$", "", bare[len(host) :]), (re.findall(r"\?.*$", re.sub("#.*$", "", url or "")) or [""])[0]


def nearest_by_force(pages):
    """For each page the pages that it is compared with, by looking at all pages of its host."""
    keys = [html_text_address(u) for _, u, _ in pages]
    first = {}
    for (i, u, h), key in zip(pages, keys):
        first[key] = min(first.get(key, ((u or "", i), h or "")), ((u or "", i), h or ""))
    out = []
    for key in keys:
        found = []
        for text, others in ((lambda k: k[1] + k[2], [k for k in first if k[0] == key[0] and k != key]), (lambda k: k[1], [k for k in first if k[0] == key[0] and k[1] != key[1]])):
            before = [k for k in others if k < key]
            after = [k for k in others if k > key]
            near = [k for k in (max(before, default=None), min(after, default=None)) if k]
            found.append(max(near, key=lambda k: len(os.path.commonprefix([text(k), text(key)]))) if near else None)
        a, b = found
        if b:  # of a path the address next to it
            path = [k for k in first if k[0] == key[0] and k[1] == b[1]]
            b = max(path) if b < key else min(path)
        out.append([first[k][1] for k in ([a, b] if a and a[1] == key[1] else [b]) if k])
    return out


def around_by_force(pages):
    """For each page those at the two addresses before and after its own on its host."""
    keys = [html_text_address(u) for _, u, _ in pages]
    first = {}
    for (i, u, h), key in zip(pages, keys):
        first[key] = min(first.get(key, ((u or "", i), h or "")), ((u or "", i), h or ""))
    out = []
    for key in keys:
        own = sorted(k for k in first if k[0] == key[0])
        at = own.index(key)
        out.append([first[k][1] for k in own[max(0, at - 2) : at] + own[at + 1 : at + 3]])
    return out


def aligned_by_force(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def ends_by_force(page, kept, near):
    texts, votes = [page[i][1] for i in kept], [0] * len(kept)
    for other in map(html_text.page_lines, near):
        inside = [t for w, t in other if w >= 2] if any(w >= 2 for w, _ in other) else [t for w, t in other if w]
        aligned = aligned_by_force(texts, inside)
        if len(aligned) < len(texts):
            votes = [v + (i in aligned) for i, v in enumerate(votes)]
    own = [i for i, v in enumerate(votes) if v < 2 and page[kept[i]][0] != 3]
    low, high = (own[0], own[-1]) if own else (len(kept), -1)
    left = [k for i, k in enumerate(kept) if votes[i] < 2 or low < i < high]
    return left or kept


def text_by_force(html_, *others, near=()):
    page = html_text.page_lines(html_ or "")
    kept = [i for i, (where, _) in enumerate(page) if where >= (2 if any(w >= 2 for w, _ in page) else 1)]
    for other in (html_text.page_lines(o or "") for o in others):
        a, b = [t for _, t in page], [t for _, t in other]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
        i = j = 0
        gone = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                gone |= {i} if min(page[i][0], other[j][0]) < 2 else set()
                i, j = i + 1, j + 1
            elif table[i + 1, j] >= table[i, j + 1]:
                i += 1
            else:
                j += 1
        own = [i for i in kept if i not in gone]
        if own:
            kept = own
            break
    return " ".join(page[i][1] for i in ends_by_force(page, kept, near))


def test_page_text_equals_brute_force(spark, duck, monkeypatch):
    """Lines of a page are all different here, so that every longest common subsequence is the same in what it deletes."""
    rng = random.Random(21)
    pages = duck.execute("select page_id, url, html from pages").fetchall()
    notices = [f"Notice {k} of the site" for k in range(12)]
    for k in range(300):
        host, section = rng.choice(("a", "a", "b", "C")), rng.randrange(9)
        url = rng.choice((f"https://{host}.example/s{section}/{rng.randrange(40)}", f"http://{host}.example/s{section}/{rng.randrange(40)}.html#x", f"https://{host}.example/i.php?id={rng.randrange(60)}"))
        lines = sorted(rng.sample(range(12), 4))
        body = "".join(f"<p>{notices[i]}</p>" for i in lines[:2]) + f"<p>Story {k if k % 7 else 0}</p>" + "".join(f"<p>{notices[i]}</p>" for i in lines[2:])
        pages.append((10**6 + k, url, f"<html><body>{body if k % 5 else f'<article>{body}</article><p>{notices[0]}</p>'}</body></html>"))
    pages += [(-7, None, "<p>One</p><p>Own</p>"), (-8, None, "<p>One</p>"), (-9, "https://a.example/s1/3", None), (-10, "https://a.example/long", "<p>" + "word " * 300_000 + "</p>" + "<p>Notice 1 of the site</p>" * 2000)]
    wanted = {i: text_by_force(h, *others, near=near) if i != -10 else None for (i, _, h), others, near in zip(pages, nearest_by_force(pages), around_by_force(pages))}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (512, 5):
        monkeypatch.setattr(html_text, "GROUP_PAGES", size)
        got = {r["page_id"]: r["text"] for r in html_text.extract(df.repartition(6)).collect()}
        assert [(i, got[i], wanted[i]) for i in wanted if i != -10 and got[i] != wanted[i]] == [] and got[-10].startswith("word word")
    alone = {i: text_by_force(h) for i, _, h in pages if i != -10}
    assert sum(alone[i] != wanted[i] for i in alone) > 100


def test_notices_inside_articles_go_and_shared_sentences_stay(spark):
    """What the text should be, said by hand: no rule of the library is used."""
    pages, wanted = [], {}
    for k in range(12):
        own = [f"First paragraph of story {k}.", "All rights to this sentence are shared.", f"Second paragraph of story {k}."]
        notices = (["Sign in to read more stories today"], ["Follow us for updates every day", "Write to the desk"]) if k % 4 else ([], ["Follow us for updates every day"])
        last = ["Licensed under terms that two stories give."] if k == 5 else []  # one page alone holds it
        title = f"<h1>Story {k}</h1>" if k % 3 else ""
        body = f"{title}{''.join(f'<p>{x}</p>' for x in notices[0] + own + last + notices[1])}"
        pages.append((k, f"https://n.example/news/{k:02}", f"<html><body><nav>Menu {k}</nav><article>{body}</article></body></html>"))
        wanted[k] = " ".join([f"Story {k}"] * (k % 3 > 0) + own + last)
    pages += [(100 + i, f"https://two.example/{i}", f"<article><p>Only story {i}.</p><p>Said by both.</p></article>") for i in range(2)]
    wanted |= {100 + i: f"Only story {i}. Said by both." for i in range(2)}
    pages += [(200 + i, f"https://same.example/{i}", "<article><p>The very same.</p><p>Story.</p></article>") for i in range(5)]
    wanted |= {200 + i: "The very same. Story." for i in range(5)}
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # every fourth page lacks some of the notices
    assert got == wanted


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        found = html_text.shared_lines(a, b)
        assert all(a[i] == b[j] for i, j in found.items()) and len(found) == table[-1, -1]


def test_vectors_with_hot_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = [*(c + rng.normal(size=16) * s for c in centres for s in (0.01, 0.1, 0.2, 0.3)), *[centres[0] * 2] * 40]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None])]
    unit = np.stack([e / np.linalg.norm(e) for e in x])
    near = unit @ unit.T >= 0.95
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.98 * (near.sum() - len(x)) and all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))


def links_by_force(x, cosine=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= cosine) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("rank", [4, 8, 16, 64])
def test_vectors_of_few_directions(spark, monkeypatch, rank):
    """Pairs at the threshold itself, where vectors vary in few directions, over many small cells and several deals."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 128)
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(2000, rank)) @ rng.normal(size=(rank, 64))
    x[:, :8] *= 3
    base, away = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True), x[1000:]
    away = away - (away * base).sum(1, keepdims=True) * base
    x = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * away / np.linalg.norm(away, axis=1, keepdims=True)])
    wanted = links_by_force(x).sum(1)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert wanted.sum() >= 2000 and sum(got.values()) >= 0.99 * wanted.sum() and all(got[i] <= wanted[i] for i in range(len(x)))


def test_vectors_in_full_cells(spark, monkeypatch):
    """A third of the rows near one vector, in a grid of tasks: every link is counted once."""
    monkeypatch.setattr(near_vectors, "SIDE", 100)
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.1
    wanted = links_by_force(x).sum(1)
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    for cells in (near_vectors.BROADCAST_CELLS, 0):
        monkeypatch.setattr(near_vectors, "BROADCAST_CELLS", cells)
        rows = near_vectors.near_duplicates(df).collect()
        assert sum(r["n_links"] for r in rows) >= 0.99 * wanted.sum() > 80_000 and all(r["n_links"] <= wanted[r["vec_id"]] for r in rows)
        assert {r["component_id"] for r in rows if r["vec_id"] < 300} == {0}


def test_vectors_of_many_lengths_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "FITTED_LENGTHS", 2)
    rng = np.random.default_rng(4)
    rows, wanted = [], {}
    for k, dim in enumerate((6, 7, 8, 9, 10)):
        x = rng.normal(size=(60 - k, dim))
        x[30:] = x[: len(x) - 30] + rng.normal(size=(len(x) - 30, dim)) * 0.05
        rows += [(100 * k + i, [float(v) for v in e], None) for i, e in enumerate(x)]
        wanted |= {100 * k + i: int(n) for i, n in enumerate(links_by_force(x).sum(1))}
    odd = [(None, [1.0, 0.0], 1), (7000, [2.0, 1.0], 2), (7000, [-1.0, 5.0], 3), (7001, [-2.0, 10.0], 4), (7002, [-0.0, 3.0], 5), (7003, [0.0, 1e-300], 6), (7004, [1e300, 1.0], 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int").withColumns({c: F.lit("clash") for c in ("h", "rep", "n", "component_id", "fit")})
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(df).collect())
    assert sum(n for i, n, _ in got if 0 <= i < 7000) >= 0.98 * sum(wanted.values()) and all(n <= wanted[i] for i, n, _ in got if 0 <= i < 7000)
    assert [x for x in got if x[0] >= 7000 or x[0] < 0] == [(-1, 0, None), (7000, 0, 7000), (7000, 3, 7000), (7001, 3, 7000), (7002, 3, 7000), (7003, 3, 7000), (7004, 0, 7004)]


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(50, None), (52, [None, 1.0]), (53, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id in (0, 2, 50)"), 3).collect()))
    best = [i for i in range(40) if i % 3 == 2]
    score = lambda q, c: 256 * 256 * (1 + (q % 3) * (c % 3))
    firsts = {0: [1, 2, 3], 2: [i for i in best if i != 2][:3]}
    assert got == [(q, r + 1, c, score(q, c)) for q in (0, 2) for r, c in enumerate(firsts[q])]


def test_top_k_of_repeats_large_numbers_and_many_rounds(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.integers(-40, 40, size=(400, 7)) / 8.0
    x[100:200] = x[3]
    ids = [*range(300), *range(200, 300)]  # a hundred ids twice, with vectors of their own
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(1000, [1e150, 2.0]), (1001, [-1e300, 3.0]), (1002, [1e30, 1.0, 5.0]), (1003, [2e30]), (1004, [1e308] * 2), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("rank", "score", "query_id", "value", "n")})
    exact = [(i, [math.floor(256 * Fraction(float(c))) for c in v]) for i, v in rows]

    def wanted(k, asked):
        out = []
        for q in asked:
            mine = min(v for i, v in exact if i == q)
            scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in exact if i != q)
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
        return out

    small = df.where("vec_id < 1000")
    asked = [0, 3, 150, 250]
    exact, everything = [r for r in exact if r[0] < 1000], exact
    for numbers, size in ((1 << 18, 64 << 20), (64, 100)):
        monkeypatch.setattr(topk, "CHUNK_NUMBERS", numbers)
        monkeypatch.setattr(topk, "ROUND_BYTES", size)
        assert sorted(map(tuple, topk.top_k(small, small.where(F.col("vec_id").isin(asked)), 6).collect())) == wanted(6, asked)
        assert topk.top_k(small.where("vec_id < 3"), small.where("vec_id = 1"), 6).count() == 2
    monkeypatch.undo()
    exact = everything
    asked = [0, 3, 1000, 1001, 1002, 1003, 1004, 1005]  # told apart by less than a double holds
    assert sorted(map(tuple, topk.top_k(df, df.where(F.col("vec_id").isin(asked)), 3).collect())) == wanted(3, asked)
    few = [(0, []), (1, [1e308, -1e308]), (2, [3.0]), (3, [-3.0, 1e308]), (4, []), (5, None), (6, [float("nan")])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    exact = [(i, [math.floor(256 * Fraction(c)) for c in v]) for i, v in few[:5]]
    assert sorted(map(tuple, topk.top_k(df, df, 5).collect())) == wanted(5, range(5))
    empty = df.where("vec_id in (0, 4)")
    assert sorted(map(tuple, topk.top_k(empty, empty, 5).collect())) == [(0, 1, 4, 0), (4, 1, 0, 0)]


def test_odd_documents_everywhere(spark):
    docs = odd_documents(spark)
    planned = mixing.plan_mix(docs)
    assert planned.count() == 8 and mixing.mix(docs).columns == docs.columns
    found = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).collect() if r["doc_id"]}
    assert found[4]["component_id"] == found[5]["component_id"] == 4 and found[1]["n_shingles"] == found[3]["n_shingles"] == 0
    assert ngram_join.keep_one(docs).count() == 6
    assert packing.pack(docs, public_tokenizers.path(TOKENIZER)).where("piece = 0").count() == 8
    assert pii.find_pii(docs).count() == pii.redact(docs).count() == 8
    forest = quality.train(docs, spark.createDataFrame([(4, 1), (None, 0), (6, None)], "doc_id long, quality int"))
    assert quality.classify(docs, forest).where("score between 0 and 1").count() == 8
    model = langid.train(docs.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(docs, model).where("doc_id <= 3").collect()} == {"und"}
    removed = span_dedup.remove_repeats(docs)
    assert removed.count() == 8 and removed.where("doc_id = 1 and text is null").count() == 1


CLASHES = ("weight", "rate", "size", "copies", "copy_no", "of_source", "source_size", "target", "draw", "salt", "score", "predicted", "row", "words", "root", "spans", "kept_id")


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words {i}" if i % 4 else None, "ab"[i % 2] if i % 5 else None, f"own {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine string").withColumns({c: F.col("mine") for c in CLASHES})
    for limit in (mixing.BROADCAST_ROWS, 0):
        old, mixing.BROADCAST_ROWS = mixing.BROADCAST_ROWS, limit
        try:
            planned = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
            mixed = mixing.mix(docs)
            assert mixed.columns == docs.columns and {k: planned[k]["copies"] for k in planned if planned[k]["copies"]} == {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
            assert all(r[c] == f"own {r['doc_id']}" for r in mixed.collect() for c in CLASHES)
            assert all(planned[k]["weight"] == planned[k]["rate"] == f"own {k}" for k in planned)
            assert {k: r["copies"] for k, r in planned.items()} == {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs, keep_text=False).collect()}
        finally:
            mixing.BROADCAST_ROWS = old


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    forest = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    model = langid.train(docs.withColumn("lang", F.lit("en")))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        mixing.mix(docs), ngram_join.jaccard_components(docs), ngram_join.keep_one(docs), packing.pack(docs, public_tokenizers.path(TOKENIZER)), pii.find_pii(docs), pii.redact(docs),
        quality.classify(docs, forest), langid.identify(docs, model), span_dedup.remove_repeats(docs), near_vectors.near_duplicates(vectors), topk.top_k(vectors, vectors), html_text.extract(pages),
    ):
        assert out.count() == 0


def test_pipeline_stages(spark, duck):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    columns, texts = docs.columns, dict(duck.execute(f"select doc_id, text from '{MORE}/documents.parquet'").fetchall())
    good, one, clean, mixed = (f for _, f in pipeline.STAGES[:4])
    docs = good(spark, docs, MORE).persist()
    assert docs.columns == columns and 0 < docs.count() < len(texts) and all(r["text"] == texts[r["doc_id"]] for r in docs.collect())
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    docs = one(spark, docs, MORE).persist()
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(set(groups.values()))
    n = docs.count()
    docs = clean(spark, docs, MORE).persist()
    assert docs.columns == columns and docs.count() == n and all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
    assert pii.find_pii(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs).collect()}
    docs = mixed(spark, docs, MORE)
    assert docs.columns == columns and {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {d: k for d, k in planned.items() if k}


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of any name: whole, in the order of the stages, and packed as the tokenizer says."""
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    some = spark.read.parquet(f"{MORE}/documents.parquet").where("doc_id < 300")
    odd = odd_documents(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.lit(None).cast(some.schema["n_chars"].dataType).alias("n_chars")).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = some.unionByName(odd).unionByName(some.where("doc_id < 20")).withColumns({c: F.concat(F.lit("own "), F.xxhash64("text").cast("string")) for c in CLASHES})
    written(docs, tmp_path, "documents")
    written(spark.read.parquet(f"{MORE}/labels.parquet"), tmp_path, "labels")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for name, stage in pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        assert docs.schema.names == before.schema.names and 0 < docs.count()
        if name != "mixing sources":
            assert docs.count() <= before.count()
        assert docs.where("text is not null and rate is null").count() == 0
    direct = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    wanted = sorted((r["doc_id"] or -1, len(direct.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    rows = pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for r in rows:
        lengths.setdefault(r["doc_id"] or -1, []).append(r["length"])
    sums = {}
    for d, n in wanted:
        sums[d] = sums.get(d, 0) + n
    assert {d: sum(n) for d, n in lengths.items()} == sums
    slots = {}
    for r in rows:
        slots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in slots.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1]) and sum(n for _, n in own) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        written(spark.read.parquet(f"{SF}/{name}.parquet").where("false"), tmp_path, name)
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_tree_walks_visit_few_nodes_of_frequent_tokens(monkeypatch):
    rng = np.random.default_rng(2)
    sets = []
    for i in range(400):
        if i % 10 == 9:
            s = sets[-1].copy()
            s[int(rng.integers(len(s)))] = 10**6 + i
        else:
            s = rng.zipf(1.15, int(rng.integers(8, 40))) % 1600
        sets.append(np.unique(s.astype(np.uint64)))
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    df = [counts[np.searchsorted(values, s)].astype(np.uint32) for s in sets]
    visits = []
    one = ngram_join.PrefixTree._one_component
    monkeypatch.setattr(ngram_join.PrefixTree, "_one_component", lambda self, *a: visits.append(1) or one(self, *a))
    parent = list(range(400))
    for a, b in ngram_join.tree_links(sets, [len(s) for s in sets], df, 80):
        a, b = ngram_join.find(parent, a), ngram_join.find(parent, b)
        parent[max(a, b)] = min(a, b)
    plain = list(range(400))
    for i in range(400):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = ngram_join.find(plain, i), ngram_join.find(plain, j)
                plain[max(a, b)] = min(a, b)
    found = [ngram_join.find(parent, i) for i in range(400)]
    assert found == [ngram_join.find(plain, i) for i in range(400)] and len(set(found)) < 400
    assert len(visits) < 400 * 40  # a third of all nodes each without prefixes
