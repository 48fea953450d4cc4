"""How filters over documents interact: what each removes at each place of each order, with exact duplicates told by routed fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row, functions as F

from serigraph.llm._common import checkpoint

#: The names of the filters in their masks' order; the last is that of exact duplicates.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of texts that a task compares with each other before anything is shuffled; parts of all rows above which a fingerprint is dealt twice.
LOCAL_BYTES, HOT_PARTS, LEAST_HOT = 16 << 20, 10_000, 64

#: The salt of rows whose mask is known already.
TOLD = -1

_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"

#: doc_id, part, mask and text of a row
Entry = tuple[int | None, str, int, str]


def text_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits: words are the runs between white space, white space being that of bytes.split()."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    return (
        (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text)) << 2
        | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3
    )


def _routed(entries: RDD, parts: int) -> RDD:
    """((fingerprint, salt, doc_id), entry) to the partition of fingerprint and salt, in order, so that chains stream past."""
    return entries.repartitionAndSortWithinPartitions(parts, lambda key: hash(key[:2]))


def _chains(rows: Iterable[tuple[tuple, Entry]]) -> Iterator[tuple[int, int, Entry, bool]]:
    """(fingerprint, salt, entry, whether a smaller id has its text) of rows in order of fingerprint, salt and id.

    The chain of a fingerprint holds each text that has it, whole, with its least id. Rows of salt TOLD pass.
    """
    key, chain = None, []
    for (h, salt, doc), entry in rows:
        if salt == TOLD:
            yield h, salt, entry, False
            continue
        if (h, salt) != key:
            key, chain = (h, salt), []
        held = next((least for text, least in chain if text == entry[3]), None)
        if held is None:
            chain.append((entry[3], doc))
        yield h, salt, entry, held is not None and held < doc


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs (doc_id, text, lang): the filters it fails, bit k for the k-th of FILTERS.

    Null texts are empty, and a null lang is the part ''. A row fails E if its text is that of a row with a smaller id; of rows
    that repeat the least id all pass. Rows without an id neither fail E nor make others fail. Very long texts are
    compared whole. An empty table gives an empty one; other columns are dropped.

    Texts are routed by their xxhash. Before that each task compares what it holds, LOCAL_BYTES at a time, and sends on only
    one of equal texts; a fingerprint of more than one in HOT_PARTS rows (of which there are at most HOT_PARTS) goes to salted
    partitions first, and from each of these only the row of the least id to a second routing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    spark = docs.sparkSession
    often = rows.groupBy("h").count().where(F.col("count") > max(LEAST_HOT, rows.count() / HOT_PARTS)).collect()  # at most HOT_PARTS
    hot = spark.sparkContext.broadcast(frozenset(r["h"] for r in often))
    source = rows.rdd
    parts = max(source.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, int(parts**0.5))

    def local(task: int, found: Iterator[Row]) -> Iterator[tuple[tuple, Entry]]:
        held: list[tuple[tuple, Entry]] = []
        size = 0

        def told() -> Iterator[tuple[tuple, Entry]]:
            held.sort(key=lambda x: x[0])
            for h, _, (doc, part, mask, text), again in _chains(held):
                if again:
                    yield (task, TOLD, 0), (doc, part, mask | DUPLICATE, "")
                else:
                    yield (h, task % salts if h in hot.value else 0, doc), (doc, part, mask, text)

        for doc, part, text, h in found:
            if doc is None:
                yield (task, TOLD, 0), (doc, part, text_mask(text), "")
                continue
            held.append(((h, 0, doc), (doc, part, text_mask(text), text)))
            size += len(text)
            if size > LOCAL_BYTES:
                yield from told()
                held, size = [], 0
        yield from told()

    def once(found: Iterator[tuple[tuple, Entry]]) -> Iterator[tuple]:
        """Rows whose mask is known, and with fingerprint and text those that a second routing must tell."""
        for h, salt, (doc, part, mask, text), again in _chains(found):
            is_open = salt != TOLD and not again and h in hot.value
            yield h if is_open else None, doc, part, mask | DUPLICATE * again, text if is_open else None

    def twice(found: Iterator[tuple[tuple, Entry]]) -> Iterator[tuple]:
        for _, _, (doc, part, mask, _), again in _chains(found):
            yield doc, part, mask | DUPLICATE * again

    first = _routed(source.mapPartitionsWithIndex(local), parts).mapPartitions(once)
    state = checkpoint(spark.createDataFrame(first, "h long, doc_id long, part string, mask int, text string", verifySchema=False))
    still = state.where("h is not null").rdd.map(lambda r: ((r["h"], 0, r["doc_id"]), (r["doc_id"], r["part"], r["mask"], r["text"])))
    second = spark.createDataFrame(_routed(still, parts).mapPartitions(twice), "doc_id long, part string, mask int", verifySchema=False)
    return state.where("h is null").select("doc_id", "part", "mask").unionByName(second)


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id) of each row whose text is that of a row with a smaller id."""
    return masked(docs).where(F.col("mask").bitwiseAND(DUPLICATE) != 0).select("doc_id")


def mask_counts(masks: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): how many rows of each mask there are in all, of good and of toxic documents, a row of the array for each.

    labels (doc_id, quality, toxic); of rows that repeat an id, 1 counts if any has it. Documents without labels are neither.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def added(counts: np.ndarray, row: tuple[int, int, int]) -> np.ndarray:
        counts[:, row[0]] += (1, *row[1:])
        return counts

    keyed = rows.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: added(np.zeros((3, 1 << len(FILTERS)), np.int64), row), added, np.add)


def order_rows(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """For every order of the filters and each of its steps what is kept, removed and lost, from the counts of masks."""
    masks = np.arange(counts.shape[1])
    steps, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = masks & bit > 0
            here = fails & (masks & before == 0)
            removed, good, toxic = (int(x) for x in counts[:, here].sum(1))
            before |= bit
            total[name] += removed
            steps.append((name, "".join(order), step, int(counts[0, masks & before == 0].sum()), removed, int(counts[0, fails & ~here].sum()), int(counts[0, bit]), good, toxic))
    for name, *row in steps:
        yield part, *row, total[name]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part of docs, order of the filters and step of it: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley), the counts being rows of the part.

    Rows, nulls, ties and repeats count as masked() and mask_counts() say. An empty table gives an empty one.
    """
    counts = mask_counts(masked(docs), labels)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: order_rows(*x)), AUDIT, verifySchema=False)
