"""Collocations: phrases whose words stand together far more often than apart, by pivot partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from serigraph.llm._common import checkpoint, mixed, record_batch, text_chunks
from serigraph.llm._words import _BASE, powers

#: Slots of the table of frequencies that is broadcast (16 MB, at every size); bytes of text whose fragments are counted together.
SLOTS, RUN_BYTES = 1 << 21, 3 << 20
#: Occurrences of a pivot above which its fragments are dealt over several groups; fragments that are mined together, and neighbours in a batch, at least.
PIVOT_ROWS, MINED, PACKED = 100_000, 1 << 18, 1 << 22

_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_VALUE = np.random.default_rng(20250911).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Tokens:
    """Words of some texts (A-Z lower-cased), with the piece each stands in and a hash of it together with its language."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]  # texts are pieces of their own
        self.data = data.tobytes()
        inside = ~(_BREAK[data] | _SPACE[data])
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        self.start, self.end = (np.flatnonzero(edge == way).astype(kind) for way in (1, -1))
        self.piece = np.cumsum(_BREAK[data], dtype=kind)[self.start]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = (np.searchsorted(bounds, self.start, side="right") - 1).astype(kind)
        own = {lang: np.frombuffer(lang.encode().ljust(8, b"\0"), np.uint8).astype(np.uint64) for lang in set(langs)}
        salt = {lang: mixed(np.array([(x * powers(len(x))).sum()], np.uint64))[0] for lang, x in own.items()}
        self.hash = np.zeros(len(self.start), np.uint64)
        if len(self.start):
            # sums over all bytes, of which each word's are a difference, moved back to its start
            sums = np.cumsum(_VALUE[data] * powers(len(data)))
            letters = sums[self.end - 1] - np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
            letters *= powers(int(self.start[-1]) + 1, _INVERSE)[self.start]
            self.hash = mixed(letters + (self.end - self.start).astype(np.uint64)) ^ np.array([salt[x] for x in langs], np.uint64)[self.text]

    def __len__(self) -> int:
        return len(self.start)

    def words(self, at: np.ndarray) -> list[str]:
        """The words at these numbers."""
        data = self.data
        return [data[a:b].decode() for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[Tokens, list[str]]]:
    langs = batch.column("lang").to_pylist()
    for first, texts in text_chunks(batch.column("text"), RUN_BYTES):
        yield Tokens(texts, langs[first : first + len(texts)]), langs[first : first + len(texts)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, f): how often each word stands in each language; counted in each run of texts before the shuffle. h: the hash that fragments() uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, langs in _tokens(batch):
                h, at, n = np.unique(t.hash, return_index=True, return_counts=True)
                yield record_batch({
                    "lang": ([langs[i] for i in t.text[at]], pa.string()), "word": (t.words(at), pa.string()), "h": (h.view(np.int64), pa.int64()), "n": (n, pa.int64()),
                })

    return docs.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))


def frequency_table(words: DataFrame) -> np.ndarray:
    """For each slot the frequency of the most frequent word that falls on it: for every word a bound from above that is exact while
    slots are many, and the same everywhere. 0: no frequent word falls on it."""
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    rows = words.groupBy(slot.alias("slot")).agg(F.max("f").alias("f")).toArrow()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("f").to_numpy()
    return table


FRAGMENTS = "pivot long, share int, lang string, lefts binary, rights binary, counts binary, near binary"


def _binary(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Items first[i]:first[i + 1] of data as the bytes of row i."""
    data = np.ascontiguousarray(data[first[0] : first[-1]])
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(((first - first[0]) * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _items(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of all rows that _binary() made, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)
    return data, np.diff(offsets) // data.itemsize


def _width(longest: int) -> type:
    return np.uint8 if longest <= 256 else np.uint32


def fragments(docs: DataFrame, table: Broadcast, longest: int) -> DataFrame:
    """The texts rewritten for each pivot: (pivot, share, lang, lefts, rights, counts, near), a row for each group and run of texts.

    A pivot is a word and owns the phrases in which no word is rarer; of equal ones the leftmost owns. Its fragment at a
    place is itself and what of the longest - 1 words on each side can stand in a phrase that it owns: frequent words of the piece as far
    as none is rarer. Words are told by their hashes. near: the words beside the pivot, of all fragments; lefts, rights: how many of them are
    before and after it in each; counts: how often the same fragment is in the run. Fragments without a neighbour are left out.

    A pivot and a share are a group, which has all occurrences of the phrases that are counted in it. A pivot's share is 0; if it has more than
    PIVOT_ROWS occurrences, it has several: phrases that go on after the pivot belong to a share of the word after it, those
    that end with the pivot to a share of the word before it, so that a place gives up to two fragments.
    """
    width, around = _width(longest), np.array([*range(1 - longest, 0), *range(1, longest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = table.value
        for batch in batches:
            for t, langs in _tokens(batch):
                h, n = t.hash, len(t)
                f = frequency[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                reach = []
                for step in (-1, 1):
                    far, going = np.zeros(n, np.int8 if longest < 100 else np.int64), f > 0
                    for k in range(1, min(longest, n)):
                        # each word and the one k places before or after it, as views
                        own, near = (slice(k, None), slice(None, n - k)) if step < 0 else (slice(None, n - k), slice(k, None))
                        more = (f[near] > f[own]) | (f[near] == f[own]) & ((h[near] > h[own]) if step < 0 else (h[near] >= h[own]))
                        going[own] &= (f[near] > 0) & (t.piece[near] == t.piece[own]) & more
                        going[: k if step < 0 else 0] = False
                        going[n - k if step > 0 else n :] = False
                        far += going
                    reach.append(far)
                at = np.flatnonzero(reach[0] | reach[1])
                if not len(at):
                    continue
                left, right = (x[at].astype(np.int64) for x in reach)
                parts = (-(-f[at] // PIVOT_ROWS)).astype(np.uint64)
                whole, ahead, behind = (np.flatnonzero(x) for x in (parts == 1, (parts > 1) & (right > 0), (parts > 1) & (left > 0)))
                dealt = [h[at[x] + step] % parts[x] + np.uint64(1) for x, step in ((ahead, 1), (behind, -1))]
                share = np.concatenate([np.zeros(len(whole), np.uint64), *dealt])
                left, right = np.concatenate([left[whole], np.minimum(left[ahead], longest - 2), left[behind]]), np.concatenate([right[whole], right[ahead], 0 * behind])
                at = at[np.concatenate([whole, ahead, behind])]
                key = h[at] * np.uint64(31) + left.astype(np.uint64)
                for k in around.tolist():
                    beside = h[np.clip(at + k, 0, n - 1)] * ((k >= -left) & (k <= right))
                    key = (key ^ (key >> np.uint64(31))) * _BASE + beside
                key = mixed(key)
                # groups stand together, and so do equal fragments
                order = np.argsort(mixed(h[at] + share * _BASE) & np.uint64(0xFFFFFFFF00000000) | key >> np.uint64(32))
                key = key[order]
                one = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                counts = np.diff(one, append=len(at)).astype(np.uint32)
                at, left, right, share = (x[order[one]] for x in (at, left, right, share))
                pivot = h[at]
                beside = (around >= -left[:, None]) & (around <= right[:, None])
                near = h[(at[:, None] + around)[beside]]
                first = np.flatnonzero(np.append(True, (share[1:] != share[:-1]) | (pivot[1:] != pivot[:-1])))
                ends = np.append(first, len(at))
                near_ends = np.concatenate([[0], np.cumsum(left + right)])[ends]
                lang = pa.array(langs, pa.string()).take(pa.array(t.text[at[first]]))
                cuts = [0, *(np.flatnonzero(np.diff(near_ends[:-1] // PACKED)) + 1).tolist(), len(first)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own, rows = ends[a : b + 1], first[a:b]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(pivot[rows].view(np.int64)), pa.array(share[rows].astype(np.int32)), lang[a:b], _binary(left.astype(width), own), _binary(right.astype(width), own),
                        _binary(counts, own), _binary(near, near_ends[a : b + 1]),
                    ], names=["pivot", "share", "lang", "lefts", "rights", "counts", "near"])

    return docs.mapInArrow(run, FRAGMENTS)


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal tuples stand together, and where in it each tuple begins. Sorts by a hash, and by the columns only if two tuples share one."""
    key = columns[0]
    for c in columns[1:]:
        key = mixed(key * _BASE + c)
    order = np.argsort(key)
    for again in (True, False):
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        key = key[order]
        if not again or not (new[1:] & (key[1:] == key[:-1])).any():
            return order, np.flatnonzero(new)
        order, key = np.lexsort(columns), np.zeros(len(order), np.uint64)


def mined(rows: pa.Table, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, w, f): the phrases of these groups that occur at least `least` times, as hashes of their words."""
    column = lambda name: rows.column(name).combine_chunks()
    kinds = {"lefts": _width(longest), "rights": _width(longest), "counts": np.uint32, "near": np.uint64}
    (left, of_row), (right, _), (n, _), (near, _) = (_items(column(name), kind) for name, kind in kinds.items())
    row = np.repeat(np.arange(len(of_row)), of_row)
    pivot, lang = column("pivot").to_numpy().view(np.uint64)[row], column("lang")
    ends = (column("share").to_numpy()[row] == 0) | (right == 0)  # whether phrases that end with the pivot are counted from this fragment
    sizes = left.astype(np.int64) + right
    place = np.cumsum(sizes) - sizes + left  # of the first word after the pivot
    for m in range(2, longest + 1):
        for before in range(m):
            own = np.flatnonzero((left >= before) & ((right >= m - 1 - before) if before < m - 1 else ends))
            if not len(own):
                continue
            begin = place[own] - before
            words = [pivot[own] if j == before else near[begin + (j - (j > before))] for j in range(m)]
            order, first = _sorted_runs(words)
            f = np.add.reduceat(n[own][order].astype(np.int64), first)
            one, f = order[first[f >= least]], f[f >= least]
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * m, pa.int32()), pa.array(np.stack([x[one] for x in words], axis=1).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(row[own[one]])), w, pa.array(f)], names=["lang", "w", "f"])


def _size(rows: pa.RecordBatch) -> int:
    """How many fragments they have."""
    return len(_items(rows.column("counts"), np.uint32)[0])


def _of_group(rows: pa.Table, group: tuple[int, int]) -> np.ndarray:
    return (rows.column("pivot").to_numpy() == group[0]) & (rows.column("share").to_numpy() == group[1])


def frequent_phrases(docs: DataFrame, known: DataFrame, table: Broadcast, least: int, longest: int) -> DataFrame:
    """(lang, phrase, m, f): phrases of m words, 2 to longest, that occur at least `least` times.

    Fragments are dealt by pivot and share, once; all phrases of a group are then counted where they are, without another
    shuffle, and rare ones dropped. known: (lang, word, h) of all words that occur so often.
    """
    group = ["pivot", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; one that may go on is held for the next batch, or if large, counted so far."""
        held, size, begun, open_group = [], 0, Counter(), None

        def begin(rows: pa.Table) -> None:
            for batch in mined(rows, 1, longest):
                for lang, w, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    begun[lang, *w] += f

        def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """What is begun, which may go on at the start of rows, and the whole groups after it."""
            if begun:
                more = int(_of_group(rows, open_group).sum())
                if more:
                    begin(rows[:more])
                rows = rows[more:]
                found = [(lang, list(w), f) for (lang, *w), f in begun.items() if f >= least]
                begun.clear()
                if found:
                    lang, w, f = zip(*found, strict=True)
                    yield record_batch({"lang": (lang, pa.string()), "w": (w, pa.list_(pa.int64())), "f": (f, pa.int64())})
            if rows.num_rows:
                yield from mined(rows, least, longest)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += _size(batch)
            if size < MINED:
                continue
            rows = pa.Table.from_batches(held)
            last = tuple(rows.column(name)[-1].as_py() for name in group)
            whole = rows.num_rows - int(_of_group(rows, last).sum())
            if whole or last != open_group:
                yield from close(rows[:whole])
            held = rows[whole:].to_batches()
            size = sum(map(_size, held))
            if size >= MINED:
                begin(rows[whole:])
                held, size, open_group = [], 0, last
        if held or begun:
            yield from close(pa.Table.from_batches(held, batch.schema))

    found = fragments(docs, table, longest).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "lang string, w array<long>, f long")
    placed = found.select("lang", "w", "f", F.posexplode("w").alias("at", "h")).join(known.select("lang", "h", "word"), ["lang", "h"])
    spelt = F.sort_array(F.collect_list(F.struct("at", "word")))["word"]
    return placed.groupBy("lang", "w", "f").agg(F.array_join(spelt, " ").alias("phrase")).select("lang", "phrase", F.size("w").alias("m"), "f")


def _cut(phrase: Column, k: int, m: int) -> tuple[Column, Column]:
    words = F.split(phrase, " ", -1)
    return F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, m - k), " ")


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits, which hold it for a up to 10**16."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, best: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the best phrases of 2 to longest words that occur at least `least` times.

    docs (text, lang): A-Z are lower-cased, texts are split at . , ; : ! ? and line breaks into pieces, and these at spaces and
    tabs into words. n: words of the language; a: occurrences of the phrase. A cut after k words gives l and r, the occurrences
    of its two parts, and the score floor(1000000 * a * a / (l * r)), exactly; the lowest cut counts, of equal ones the shortest first part.
    A phrase goes if a longer candidate that holds its words has at least inside percent of its occurrences. Ranks are by score,
    a, and the phrase's bytes.

    Null texts are empty; a null lang is 'und'. Rows that repeat count each time. Very long texts are read whole, in a step each.
    An empty table gives an empty one; other columns are dropped.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = word_counts(rows)
    often = F.col("f") >= least
    # rare words are one row of each language, for its total
    words = checkpoint(counted.groupBy("lang", F.when(often, F.col("word")).alias("word"), F.when(often, F.col("h")).alias("h")).agg(F.sum("f").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where("word is not null")
    if known.groupBy("lang", "h").count().where("count > 1").limit(1).count():
        raise RuntimeError("two frequent words of a language share a hash of 64 bits")
    table = docs.sparkSession.sparkContext.broadcast(frequency_table(known))
    candidates = checkpoint(frequent_phrases(rows, known, table, least, longest))
    # every contiguous part of a candidate is a word or a candidate itself
    lengths = known.select("lang", F.col("word").alias("part"), "f").unionByName(candidates.select("lang", F.col("phrase").alias("part"), "f"))
    asked = []
    for m in range(2, longest + 1):
        of = candidates.where(F.col("m") == m)
        cuts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _cut(F.col("phrase"), k, m)[side].alias("part")) for k in range(1, m) for side in (0, 1)]
        within = [F.struct(F.lit(0).alias("k"), F.lit(2).alias("side"), F.array_join(F.slice(F.split("phrase", " ", -1), i + 1, size), " ").alias("part")) for size in range(2, m) for i in range(m - size + 1)]
        asked.append(of.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*cuts, *within)).alias("x")).select("lang", "phrase", "a", "x.*"))
    every = asked[0]
    for more in asked[1:]:
        every = every.unionByName(more)
    joined = checkpoint(every.join(lengths, ["lang", "part"]))
    held = joined.where((F.col("side") == 2) & (100 * F.col("a") >= inside * F.col("f"))).select("lang", F.col("part").alias("phrase")).distinct()
    sides = joined.where("side < 2").groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = sides.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    left = lowest.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language, then of several shares, so that no task ranks a whole one
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    for shares in (groups, int(groups**0.5), 1):
        among = Window.partitionBy("lang", F.pmod("share", F.lit(shares))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(among)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
