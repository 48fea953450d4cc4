"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from serigraph.llm._common import CHUNK_BYTES, checkpoint, record_batch, text_chunks

ORDER = 4
BITS = np.uint64(16)
SPACE = 32
#: Distinct grams times languages of one part of a model; a larger model is as many parts as it takes.
PART_CELLS = 4_000_000
_PRIME = 1_000_003


@cache
def letters() -> np.ndarray:
    """For each 16-bit code: its lower-case code if it is a letter or mark, else that of a space."""
    out = np.full(1 << 16, SPACE, np.uint64)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


def normalised(text: bytes) -> np.ndarray:
    """Lower-case letters of the whole text, other runs as one space, with a space at both ends; empty without letters."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(codes) and codes.max() >= 1 << 16:
        # a letter beyond the basic plane is the two surrogates that stand for it alone, other characters there are spaces
        high = codes >= 1 << 16
        is_letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in codes[high]), bool)
        low = letters()[np.where(high, SPACE, codes)]
        beyond = codes[high] - (1 << 16)
        low[high] = np.where(is_letter, 0xD800 + (beyond >> 10), SPACE)
        pairs = np.flatnonzero(high)[is_letter]
        low = np.insert(low, pairs + 1, 0xDC00 + (beyond[is_letter] & 0x3FF))
    else:
        low = letters()[codes]
    if not (low != SPACE).any():
        return low[:0]
    low = np.concatenate([[np.uint64(SPACE)], low, [np.uint64(SPACE)]])
    return low[np.concatenate([[True], (low[1:] != SPACE) | (low[:-1] != SPACE)])]


def grams(codes: np.ndarray) -> np.ndarray:
    """Keys of the ORDER-grams: the codes, 16 bits each."""
    if len(codes) < ORDER:
        codes = np.concatenate([np.full(ORDER - len(codes), SPACE, np.uint64), codes])
    n = len(codes) - ORDER + 1
    key = codes[:n].copy()
    for k in range(1, ORDER):
        key = (key << BITS) | codes[k : n + k]
    return key


def distinct_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(grams(codes))
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that each ORDER-gram is scored by, from its two middle characters: all that it backs off to is there as well."""
    return (keys >> BITS & np.uint64(0xFFFFFFFF)) % np.uint64(_PRIME) % np.uint64(parts)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, inverse = np.unique(keys, return_inverse=True)
    return out, np.bincount(inverse, values, len(out))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class KneserNey:
    """Sorted hash arrays of one order each: keys, and for each language the discounted share and the backed-off weight."""

    langs: list[str]
    share_keys: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    full: np.ndarray | None = None
    floor: np.ndarray | None = None

    @classmethod
    def trained(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], discounts: dict[str, dict[int, float]] | None = None, pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> KneserNey:
        """counts: for each language its sorted ORDER-gram keys and their counts.

        If these are those of one part, discounts (by order) and pairs (sorted keys of order 2 and their counts) are of the whole.
        """
        model = cls(sorted(counts))
        orders: list[list[tuple]] = [[] for _ in range(ORDER)]
        sizes = []
        for lang in model.langs:
            keys, n = counts[lang]
            n = n.astype(float)
            for order in range(ORDER, 0, -1):
                if order == 2 and pairs is not None:
                    keys, n = pairs[lang]
                context = keys >> BITS
                discount = _discount((n == 1).sum(), (n == 2).sum()) if discounts is None or order < 3 else discounts[lang][order]
                groups, total = _summed(context, n)
                types = np.bincount(np.searchsorted(groups, context), minlength=len(groups))
                at = np.searchsorted(groups, context)
                orders[order - 1].append((keys, (n - discount).clip(0) / total[at], groups, discount * types / total))
                # the next order counts the types that end in it (continuation counts)
                mask = np.uint64((1 << (16 * (order - 1))) - 1)
                keys, n = _summed(keys & mask, np.ones(len(keys)))
            sizes.append(len(orders[0][-1][0]))
        for tables in orders:
            keys = np.unique(np.concatenate([t[0] for t in tables]))
            contexts = np.unique(np.concatenate([t[2] for t in tables]))
            share, backoff = np.zeros((len(keys), len(tables))), np.ones((len(contexts), len(tables)))
            for j, (k, p, g, w) in enumerate(tables):
                share[np.searchsorted(keys, k), j] = p
                backoff[np.searchsorted(contexts, g), j] = w
            model.share_keys.append(keys)
            model.share.append(share)
            model.context_keys.append(contexts)
            model.backoff.append(backoff)
        model.floor = 1.0 / (np.array(sizes, float) + 1)
        model.full = np.log2(model.probability(model.share_keys[-1], ORDER)).astype(np.float32)
        return model

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Interpolated probability of the last character of each key after those before it, for every language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs)))
        lower = self.probability(keys & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
        at, seen = _lookup(self.context_keys[order - 1], keys >> BITS)
        out = np.where(seen[:, None], self.backoff[order - 1][at], 1.0) * lower
        at, seen = _lookup(self.share_keys[order - 1], keys)
        out[seen] += self.share[order - 1][at[seen]]
        return out

    def bits(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits under each language of distinct grams that occur n times."""
        at, seen = _lookup(self.share_keys[-1], keys)
        bits = -(n[seen] @ self.full[at[seen]]).astype(float)
        if not seen.all():
            bits = bits - n[~seen] @ np.log2(self.probability(keys[~seen], ORDER))
        return bits


@dataclass
class Model:
    """KneserNey parts, each broadcast by itself, and the limits of rejection."""

    langs: list[str]
    parts: list[Broadcast] = field(default_factory=list)
    calibrated: dict[str, float] = field(default_factory=dict)


def count_grams(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                codes = normalised(value.as_buffer().to_pybytes()) if value.is_valid else ()
                if len(codes):
                    held.setdefault(name, []).append(grams(codes))
            for name, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield record_batch({"lang": ([name] * len(keys), pa.string()), "gram": (keys.view(np.int64), pa.int64()), "n": (n, pa.int64())})

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _arrays(counts: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted keys and their counts of counts (l, gram, n), l its place in langs."""
    rows = counts.select(F.col("l").cast("int"), "gram", "n").toArrow()
    l, keys, n = (rows.column(c).to_numpy() for c in ("l", "gram", "n"))  # noqa: E741
    keys = keys.view(np.uint64)
    order = np.lexsort((keys, l))
    l, keys, n = l[order], keys[order], n[order]  # noqa: E741
    bounds = np.searchsorted(l, np.arange(len(langs) + 1))
    return {lang: (keys[a:b], n[a:b]) for lang, a, b in zip(langs, bounds, bounds[1:], strict=False)}


def _parts(counts: DataFrame, langs: list[str]) -> Iterator[KneserNey]:
    """The whole model of counts (l, gram, n), in parts of bounded size; no gram is left out."""
    parts = -(-counts.select("gram").distinct().count() * len(langs) // PART_CELLS)
    if parts == 1:
        yield KneserNey.trained(_arrays(counts, langs))
        return
    # what no part can tell alone: the discounts of the higher orders and the table of pairs
    shorter = lambda table, order: table.groupBy("l", F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    triples = checkpoint(shorter(counts, 3))
    pairs = _arrays(shorter(triples, 2), langs)
    discounts: dict[str, dict[int, float]] = {lang: {} for lang in langs}
    for order, table in ((4, counts), (3, triples)):
        for row in table.groupBy("l").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts[langs[row["l"]]][order] = _discount(row["ones"], row["twos"])
    part = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFFFFFF)) % _PRIME % parts
    for k in range(parts):
        yield KneserNey.trained(_arrays(counts.where(part == k), langs), discounts, pairs)


def train(labelled: DataFrame, quantile: float = 0.999) -> Model:
    """A model from all rows of labelled (doc_id, text, lang) with text and lang.

    Counts cover every row, and the model every gram and language. Where grams and languages are many, it is dealt into
    parts that are broadcast one by one, with the same scores. The limit of rejection of a language is the given quantile
    of the cross-entropy, to 4 places, over all rows that are taken for it.
    """
    spark = labelled.sparkSession
    counts = checkpoint(count_grams(labelled))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    places = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "l int, lang string"))
    model = Model(langs, [spark.sparkContext.broadcast(part) for part in _parts(counts.join(places, "lang").select("l", "gram", "n"), langs)])
    rows = identify(labelled.where("lang is not null and text is not null").select("text"), model).where("lang_pred <> 'und'")
    sizes = rows.groupBy("lang_pred", F.round("bits", 4).alias("bits")).agg(F.count("*").alias("n"))
    for row in sizes.groupBy("lang_pred").agg(F.expr(f"percentile(bits, {quantile}, n)").alias("limit")).collect():
        model.calibrated[row["lang_pred"]] = row["limit"]
    return model


def identify(docs: DataFrame, model: Model, reject: bool = False, sharpness: float = 40.0, keep_text: bool = False) -> DataFrame:
    """Add lang_pred, score, bits and rejected to docs, from the column text alone (dropped unless keep_text).

    lang_pred: the language of the lowest bits per character over the whole text; 'und' if text is null or has no
    letter, or nothing was learned. score: its share among all languages, from the differences of the cross-entropies
    over min(length, sharpness) characters (0 for 'und'). rejected: bits are above the language's calibrated limit; with
    reject=True such rows are 'und' as well. Ties go to the name that sorts first. Columns of these names are replaced. One
    row for each row, those that repeat included; very long texts are read whole. A letter beyond the basic plane counts as two.
    """
    langs, parts, limits = model.langs, model.parts, model.calibrated
    step = CHUNK_BYTES if len(parts) < 2 else 8 * CHUNK_BYTES
    docs = docs.drop("lang_pred", "score", "bits", "rejected")
    carried = [c for c in docs.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, bits, rejected = [], [], [], []
            for _, texts in text_chunks(batch.column("text"), step):
                codes = [normalised(t) if langs else () for t in texts]
                found = {i: distinct_grams(c) for i, c in enumerate(codes) if len(c)}
                total = np.zeros((len(texts), len(langs)))
                for k, part in enumerate(parts):
                    table = part.value
                    for i, (keys, n) in found.items():
                        own = slice(None) if len(parts) == 1 else part_of(keys, len(parts)) == k
                        total[i] += table.bits(keys[own], n[own])
                    if len(parts) > 1:
                        del table
                        part.__dict__.pop("_value", None)  # a worker holds one part at a time
                for i, c in enumerate(codes):
                    if i not in found:
                        row = ("und", 0.0, None, False)
                    else:
                        h = total[i] / found[i][1].sum()
                        best = int(h.argmin())
                        share = 1.0 / np.exp2(-(h - h[best]) * min(len(c), sharpness)).sum()
                        far = bool(h[best] > limits.get(langs[best], np.inf))
                        row = ("und" if reject and far else langs[best], float(share), float(h[best]), far)
                    for column, x in zip((pred, score, bits, rejected), row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*carried, "lang_pred", "score", "bits", "rejected"],
            )

    schema = StructType(list(docs.select(*carried).schema.fields)).add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)
