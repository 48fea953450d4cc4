"""Best-fit packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serigraph.llm._common import checkpoint, record_batch, text_chunks
from serigraph.llm._tokens import END, NUMBER, ODD, OTHER, WHITE, WHOLE, KnownParts, between, kinds, odd_places, parts_of, split_tails, units_of

#: Encoded parts after which a worker forgets those met least lately; few, since the pipeline's other stages leave a worker little memory.
KEPT = 250_000
#: Bytes of text whose parts are looked up together.
RUN_BYTES = 2 << 20
#: Characters of parts that aren't made here: not visible, beyond U+024F, or of more than one character in lower case.
_UNUSUAL = re.compile("[^\x21-\x7e\xa1-\u012f\u0131-\u024f]")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each UTF-16 unit, and the unit in lower case."""
    kind, lower = kinds(), np.arange(1 << 16).astype("<u2")
    for c in np.flatnonzero((kind != ODD) & (kind != WHITE)).tolist():
        if len(chr(c).lower()) == 1:
            lower[c] = ord(chr(c).lower())
        else:
            kind[c] = ODD
    return kind, lower


class PartEncoder:
    """Token ids of whole texts, from those of the parts that the tokenizer's own pattern makes, in lower case and without white space.

    The tokenizer drops white space and never joins over it. A string between white space that holds other than usual
    characters is a part as it is.
    """

    def __init__(self, tokenizer_file: str, end_id: int) -> None:
        self.parts = KnownParts(tokenizer_file, [end_id])
        vocabulary = self.parts.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def split(self, texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The parts of all texts, a stop after each text, and which parts are the stops."""
        kind_of, lower_of = _tables()
        units, stops = units_of(texts)
        kind = kind_of[units]
        kind[stops] = END
        lower = lower_of[units]
        odd = odd_places(units, kind)
        if len(odd):
            gaps = np.flatnonzero((kind == WHITE) | (kind == END))
            k = np.unique(np.searchsorted(gaps, odd))
            inside = between(np.where(k > 0, gaps[k - 1] + 1, 0), gaps[k])
            kind[inside] = WHOLE
            lower[inside] = units[inside]
        start = kind >= NUMBER  # each digit is a part
        start[:1] = True
        start[1:] |= kind[1:] != kind[:-1]
        split_tails(start, lower, kind, np.flatnonzero(start & (lower == ord("'")) & (kind == OTHER)))
        seen = kind != WHITE
        start &= seen
        return parts_of(lower[seen], np.flatnonzero(start[seen])), np.searchsorted(np.flatnonzero(start), stops)

    def encode(self, parts: list[str]) -> list[bytes]:
        whole = ["<|" in p or _UNUSUAL.search(p) is not None for p in parts]
        found = iter(self.parts.encoded_apart([p for p, w in zip(parts, whole, strict=True) if not w], " ", ends=self.ends))
        as_is = iter(self.parts.encoded([p for p, w in zip(parts, whole, strict=True) if w]))
        return [next(as_is if w else found) for w in whole]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and their end ids, one after the other, and where each text's end."""
        parts, stops = self.split(texts)
        ids, total = self.parts.ids(parts, self.encode, KEPT)
        return ids, total[stops]


@cache
def encoder(tokenizer_file: str, end_id: int) -> PartEncoder:
    """One for each worker process, which its tasks share."""
    return PartEncoder(tokenizer_file, end_id)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece of at most size tokens: its digest, and its place among this task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, end_id)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            docs_of = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch.column("text"), RUN_BYTES):
                ids, ends = encode(texts)
                begin = 0
                for doc, end in zip(docs_of[first : first + len(texts)], ends.tolist(), strict=True):
                    for piece, at in enumerate(range(begin, end, size)):
                        n = min(size, end - at)
                        place = seen.get(n, 0)
                        seen[n] = place + 1
                        for column, value in zip(out, (doc, piece, at - begin, n, zlib.crc32(ids[at : at + n]), place), strict=True):
                            column.append(value)
                    begin = end
            long, int32 = pa.int64(), pa.int32()
            yield record_batch(
                {"doc_id": (out[0], long), "piece": (out[1], int32), "start": (out[2], long), "length": (out[3], long), "ids_crc32": (out[4], long), "task": ([task] * len(out[0]), int32), "place": (out[5], long)}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset) for a histogram of lengths.

    Best-fit decreasing on counts: lengths from long to short; all pieces of a length go to the open sequences with the
    least sufficient room, and what is left opens sequences of floor(size / length) pieces each. Sequences of one fill
    are runs of numbers, so that work and plan depend on the number of lengths, not of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    plan, fresh = [], 0

    def keep(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = room[space].pop()
                take = min(left, n)
                if take < n:
                    room[space].append((first + take, n - take))
                elif not room[space]:
                    del room[space]
                    spaces.pop(i)
                plan.append((length, rank, take, first, size - space))
                keep(space - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = size // length
            full, rest = divmod(left, each)
            for n, fill in ((full, each), (1 if rest else 0, rest)):
                if n:
                    for k in range(fill):
                        plan.append((length, rank, n, fresh, k * length))
                        rank += n
                    keep(size - fill * length, fresh, n)
                    fresh += n
            left = 0
    return plan


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack docs (doc_id, text) into few sequences of at most size tokens; one row per piece.

    A document is its ids and end_id; only longer documents are cut, into pieces of size tokens, the last may be
    shorter. Null and empty texts are the end_id alone. Repeated rows and null ids are packed as rows of their own. The
    histogram of lengths (at most size rows) is planned on the driver; each piece then takes the planned slot of its rank
    among the pieces of its length: its place in its task plus those of earlier tasks. Other columns are dropped. An empty
    table gives an empty one. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = checkpoint(tokenized_pieces(docs, tokenizer_file, size, end_id))
    counts = checkpoint(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(histogram, size)
    by_length: dict[int, list[np.ndarray]] = {}
    for length in histogram:
        rows = np.array([p[1:] for p in plan if p[0] == length], np.int64)
        by_length[length] = list(rows.T)
    slots = docs.sparkSession.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, start, where = slots.value[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = start[i] + rank[at] - first[i], where[i]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return pieces.join(before, ["length", "task"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
