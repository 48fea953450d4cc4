"""Quality classifier: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from serigraph.llm._common import text_chunks
from serigraph.llm._words import words_of

FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "upper", "digit", "punct", "other_ascii", "beyond_ascii", "space", "newlines",
    "words_with_upper_start", "words_all_upper", "words_ending_punct", "words_ending_symbol", "words_with_digit", "one_byte_words",
    "distinct_words", "distinct_3grams", "top_word", "repeated_lines", "mean_line", "symbol_kinds", "most_frequent_symbol",
)


@cache
def byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 sentence punctuation, 4 other printable ASCII, 5 non-ASCII, 6 white space, 7 control."""
    out = np.full(256, 7, np.int64)
    for c in range(33, 127):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in ".,;:!?'\"()-" else 4
    out[128:] = 5
    out[[0x20, *range(0x09, 0x0E)]] = 6
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each whole text; an empty text has zeros."""
    words = words_of(texts)
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    kinds = byte_classes()
    length = words.end - words.start
    first, final = joined[words.start], joined[words.end - 1]
    is_upper = np.concatenate([[0], np.cumsum(kinds[joined] == 1)])
    is_digit = np.concatenate([[0], np.cumsum(kinds[joined] == 2)])
    uppers = is_upper[words.end] - is_upper[words.start]
    per_word = np.stack([
        length, length.astype(float) ** 2, length > 12, kinds[first] == 1, (uppers == length) & (length > 1), kinds[final] == 3, kinds[final] == 4,
        (is_digit[words.end] - is_digit[words.start]) > 0, length == 1,
    ]).astype(float)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            continue
        n = b - a
        mean = per_word[:, a:b].mean(1)
        h = words.hash[a:b]
        _, repeats = np.unique(h, return_counts=True)
        trigrams = len(np.unique(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(7) + h[2:] * np.uint64(11))) / (n - 2) if n > 2 else 1.0
        bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        share = np.bincount(kinds, bytes_, 8) / len(text)
        symbols = bytes_[kinds == 4]
        lines = [x for x in text.split(b"\n") if x]
        out[i] = (
            np.log1p(n), mean[0], np.sqrt(max(0.0, mean[1] - mean[0] ** 2)), mean[2], share[1], share[2], share[3], share[4], share[5], share[6], bytes_[10] / n,
            *mean[3:], len(repeats) / n, trigrams, repeats.max() / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), (symbols > 0).sum(), symbols.max() / n,
        )
    return out


@dataclass
class Forest:
    """Complete trees as flat arrays: node k has children 2k + 1 and 2k + 2; leaves hold log odds."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 5.0) -> Forest:
    """Boosting by logistic loss: quantile bins, histograms of gradients by node and bin, all nodes of a level at once."""
    if not len(y):
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    rows, wide = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(wide)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    total = np.full(rows, base)
    inner = (1 << depth) - 1
    forest = Forest(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth)), base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = y - q, q * (1 - q)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            start, count = (1 << level) - 1, 1 << level
            at = node - start
            gain, choice = np.zeros(count), np.full(count, -1)
            for j in range(wide):
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                better = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                better[(hs < least) | (ht - hs < least)] = 0
                better[:, len(cuts[j]) :] = 0
                b = better.argmax(1)
                best = better[np.arange(count), b]
                upd = best > gain + 1e-9
                gain[upd], choice[upd] = best[upd], (j * bins + b)[upd]
            for k in np.flatnonzero(choice >= 0):
                j, b = divmod(int(choice[k]), bins)
                forest.feature[t, start + k], forest.threshold[t, start + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(rows), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        forest.leaf[t] = rate * gs / (hs + l2)
        total += forest.leaf[t][leaf]
    return forest


def _features(docs: DataFrame, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(texts) for _, texts in text_chunks(batch.column("text"))]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), values], names=[*extra, "x"])

    schema = StructType(list(docs.select(*extra).schema.fields)).add("x", ArrayType(DoubleType()))
    return docs.select(*extra, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Forest:
    """Fit on the rows of labels (doc_id, quality) that have a document, at most sample_rows of them.

    The rows with the smallest hashes of doc_id are taken; their features, sample_rows x 24 numbers, are what reaches the
    driver. Labels other than 0 and 1 and null ids are left out; of repeated labels the greatest counts; without any
    label the forest scores 0.5. Very long texts are read whole. Rows that repeat a doc_id are all learned from, up to
    2 * sample_rows rows in order of doc_id.
    """
    sample = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = sample.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = _features(joined, ["doc_id", "quality"]).orderBy("doc_id").limit(2 * sample_rows).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return boosted(x, rows["quality"].to_numpy(float))


def classify(docs: DataFrame, forest: Forest, keep_text: bool = False) -> DataFrame:
    """Add score (0 to 1, the share of label 1) and predicted (1 from 0.5 on) to docs, from the column text alone.

    Null and empty texts get the score of zero statistics. One row for each row, those that repeat included; very long texts
    are read whole; an empty table gives an empty one. Columns named like the added ones are replaced, the text is dropped
    unless keep_text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    docs = docs.drop("score", "predicted")
    carried = [c for c in docs.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(statistics(texts)) for _, texts in text_chunks(batch.column("text"))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*carried, "score", "predicted"]
            )

    schema = StructType(list(docs.select(*carried).schema.fields)).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of docs that classify predicts to be of label 1, with their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(statistics(texts)) for _, texts in text_chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(scores) >= 0.5 if scores else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
