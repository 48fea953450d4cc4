"""Token files against the tokenizer and against plain lists of ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serigraph.llm import token_files
from serigraph.llm.queries import BYTE_TOKENIZER, QUERIES

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path(BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.mark.parametrize("n", [0, 1, 2, 40_000, 100_000])
def test_file_answers_as_a_list_does(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    raw = token_files.packed_file([3, None], [n // 2, n - n // 2], ids)
    file = token_files.TokenFile(raw)
    assert len(file) == n and file.tokens().tolist() == ids.tolist()
    assert [(d, at, x.tolist()) for d, at, x in file.documents()] == [(3, 0, ids[: n // 2].tolist()), (None, n // 2, ids[n // 2 :].tolist())]
    for i in rng.integers(0, n, 40 if n else 0).tolist():
        t = int(ids[i])
        where = np.flatnonzero(ids == t)
        k = int(rng.integers(0, len(where)))
        assert file.token(i) == t and file.select(t, k) == where[k] and file.rank(t, i) == (where < i).sum() and file.count(t, i // 2, i) == ((where < i) & (where >= i // 2)).sum()
    for t in (0, 1, 7, 12_345, 50_256):
        assert file.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist() and file.count(t) == (ids == t).sum()
    with pytest.raises(IndexError):
        file.select(99_999, 0)
    if n > 1000:
        assert len(raw) < 2 * n  # under two bytes a token


@pytest.mark.parametrize("kept", [300_000, 50])
def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch, kept):
    monkeypatch.setattr(token_files, "KEPT", kept)
    rng = random.Random(2)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\n", ".", ",", " wörd", "\t", "é", "à", "\xa0", " ", "　", "'s", "1", "!", "<|endoftext|>", "\x1c", "\x85", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(5_000)]
    encode = token_files.Encoder(FILE)
    for some in (texts[:2_000], texts[2_000:2_001], texts[2_001:], texts):
        ids, n = encode([t.encode() for t in some])
        for text, own in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def wanted(tokenizer, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_reads_back_what_the_tokenizer_says(spark, tokenizer):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, SF).collect())) == wanted(tokenizer, rows)


def test_many_files_odd_rows_and_look_ups(spark, tokenizer, tmp_path):
    long = "word " * 5_000
    rows = [(2, "b b"), (1, None), (None, "no id"), (3, ""), (5, "same"), (5, "same"), (4, long), (-7, "first, \n\n  of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("path", "task", "start", "h", "n_tokens")})
    manifest = token_files.write(docs, f"file://{tmp_path}/tokens", FILE, shard_tokens=10)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    expected = wanted(tokenizer, order)
    assert sorted(map(tuple, token_files.documents(manifest).collect()), key=lambda r: r[1]) == expected
    assert manifest.count() > 3 and manifest.agg(F.sum("n_tokens")).first()[0] == sum(r[2] for r in expected)
    assert not list((tmp_path / "tokens").glob(".*"))  # no half-written file stays
    ids = [i for _, text in order for i in [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]]
    word = tokenizer.encode(" word").ids[0]
    assert {r["token"]: r["n"] for r in token_files.token_counts(manifest, [word, 0, 50_000]).collect()} == {word: ids.count(word), 0: ids.count(0)}
    found = sorted(map(tuple, token_files.occurrences(manifest, 0).select("place", "doc_id").collect()))
    assert found == [(r[1] + r[2] - 1, r[0]) for r in expected]
    assert [r["ids"] for r in token_files.documents(manifest, with_ids=True).where("doc_id = 2").collect()] == [[*tokenizer.encode("b b").ids, 0]]


def test_empty_table(spark, tmp_path):
    manifest = token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), FILE)
    assert manifest.count() == 0 and token_files.documents(manifest).count() == 0 and token_files.token_counts(manifest, [1]).count() == 0
