"""Token-ID files: each shard is a wavelet matrix in one compressed file that answers look-ups without being decoded."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serigraph.llm._common import checkpoint, record_batch, text_chunks
from serigraph.llm._tokens import END, OTHER, WHITE, WHOLE, KnownParts, between, kinds, odd_places, parts_of, split_tails, units_of

#: Tokens after which a shard is closed (a longer document is a shard of its own); bits of a block of a plane.
SHARD_TOKENS, BLOCK_BITS = 4_000_000, 1 << 15
#: Encoded parts after which a worker forgets those met least lately; bytes of text whose parts are looked up together.
KEPT, RUN_BYTES = 1_000_000, 8 << 20
#: Characters of parts that the tokenizer has to see one by one.
_UNUSUAL = re.compile("[^\x21-\x7e\xa1-\u024f]")
MAGIC = b"WAVELET1"


# --- tokens ----------------------------------------------------------------------------------------------------------


class Encoder:
    """Token ids of whole texts, from those of the parts that the byte-level tokenizer's own pattern makes.

    Its parts are runs of letters, digits or marks with the space before them, tails after an apostrophe, and white space.
    Between lone spaces, which stand between two visible characters and which it never joins over, a string that holds
    other than usual characters is a part as it is, with the space before it.
    """

    def __init__(self, tokenizer_file: str, end_id: int | None = None) -> None:
        """end_id: what follows the ids of each text, if anything does."""
        self.parts = KnownParts(tokenizer_file, [] if end_id is None else [end_id])
        self.kind_of = kinds()
        self.is_space = np.array([chr(c).isspace() for c in range(1 << 16)])
        vocabulary = self.parts.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def split(self, texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The parts of all texts, a stop after each text, and which parts are the stops."""
        units, stops = units_of(texts)
        kind = self.kind_of[units]
        kind[stops] = END
        space, first = units == ord(" "), np.zeros(0, np.int64)
        odd = odd_places(units, kind)
        if len(odd):
            lone = np.flatnonzero(space)
            seen = lambda at: (kind[at] != END) & ~self.is_space[units[at]]
            lone = lone[(lone > 0) & seen(lone - 1) & seen(lone + 1)]
            gaps = np.union1d(lone, stops)
            k = np.unique(np.searchsorted(gaps, odd))
            first = np.where(k > 0, gaps[k - 1] + (kind[gaps[k - 1]] == END), 0)
            kind[between(first, gaps[k])] = WHOLE
        white = kind == WHITE
        start = kind == END
        start[:1] = True
        start[1:] |= kind[1:] != kind[:-1]
        start[1:] &= ~(white[:-1] & space[:-1]) | white[1:] | (kind[1:] == END)  # a space belongs to what it precedes,
        start[:-1] |= white[:-1] & ~white[1:] & (kind[1:] != END)  # and is apart from white space before it
        start[first] = True
        split_tails(start, units, kind, np.flatnonzero(start & (units == ord("'")) & (kind == OTHER)))
        begin = np.flatnonzero(start)
        return parts_of(units, begin), np.searchsorted(begin, stops)

    def encode(self, parts: list[str]) -> list[bytes]:
        usual = [len(p) > 1 and p[0] == " " and "<|" not in p and _UNUSUAL.search(p, 1) is None for p in parts]
        found = iter(self.parts.encoded_apart([p[1:] for p, u in zip(parts, usual, strict=True) if u], " ", begins=self.opens))
        as_is = iter(self.parts.encoded([p for p, u in zip(parts, usual, strict=True) if not u]))
        return [next(found if u else as_is) for u in usual]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        parts, stops = self.split(texts)
        ids, total = self.parts.ids(parts, self.encode, KEPT)
        return ids, np.diff(total[stops], prepend=0)


@cache
def encoder(tokenizer_file: str, end_id: int) -> Encoder:
    """One for each worker process, which its tasks share."""
    return Encoder(tokenizer_file, end_id)


# --- one file --------------------------------------------------------------------------------------------------------


def packed_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard: its documents in order, and their ids as a wavelet matrix.

    Ids are numbered by falling frequency in the shard, so that there are as few planes as the shard's alphabet needs and the
    upper ones are sparse. Plane l holds bit l, from the top, of all numbers, stably sorted by the bits above it. Each plane
    is cut into blocks of BLOCK_BITS bits, compressed one by one where that makes them smaller; the ones before each block
    are kept, which makes rank a look-up in one block.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    number = np.zeros(len(counts), np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    row = number[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(ids) else 0
    sections: list[bytes] = []

    def add(raw: bytes) -> list[int]:
        """Where the section starts, after the header, and its length."""
        nonlocal size
        sections.append(raw)
        size += len(raw)
        return [size - len(raw), len(raw)]

    size, head = 0, {"tokens": len(ids), "documents": len(doc_ids), "levels": levels, "planes": []}
    for name, values in (
        ("doc_ids", np.array([0 if d is None else d for d in doc_ids], "<i8")), ("without_id", np.packbits([d is None for d in doc_ids]) if doc_ids else np.zeros(0, np.uint8)),
        ("lengths", np.array(lengths, "<i8")), ("alphabet", alphabet.astype("<u4")), ("counts", counts[alphabet].astype("<i8")),
    ):
        head[name] = add(pack(values.tobytes()))
    for level in range(levels):
        bit = (row & row.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.packbits(bit)
        ones = np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64))
        plane, blocks = packed.tobytes(), []
        for at in range(0, len(plane), BLOCK_BITS // 8):
            raw = plane[at : at + BLOCK_BITS // 8]
            small = pack(raw)
            blocks.append(small if len(small) < len(raw) else raw)
        head["planes"].append({"zeros": int(len(row) - ones[-1])})
        for name, values in (("ones", np.concatenate([[0], ones])), ("ends", np.cumsum([0, *map(len, blocks)]))):
            head["planes"][-1][name] = add(pack(values.astype("<i8").tobytes()))
        head["planes"][-1]["bits"] = add(b"".join(blocks))
        zeros = len(row) - int(ones[-1])
        after = np.empty_like(row)
        np.compress(bit, row, out=after[zeros:])
        np.logical_not(bit, out=bit)
        np.compress(bit, row, out=after[:zeros])
        row = after
    raw = json.dumps(head).encode()
    return b"".join([MAGIC, len(raw).to_bytes(8, "little"), raw, *sections])


class TokenFile:
    """A shard read back: access, rank, count, select and whole documents. data: its bytes, or a memory map of them."""

    def __init__(self, data) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("no token file")
        self.base = 16 + int.from_bytes(view[8:16], "little")
        self.view, self.head = view, json.loads(bytes(view[16 : self.base]))
        self.n, self.levels, self.planes = self.head["tokens"], self.head["levels"], self.head["planes"]
        self.doc_ids, self.lengths = self._numbers("doc_ids", "<i8"), self._numbers("lengths", "<i8")
        self.without_id = np.unpackbits(self._numbers("without_id", np.uint8), count=self.head["documents"]) > 0
        self.alphabet, self.counts = self._numbers("alphabet", "<u4"), self._numbers("counts", "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.number = {int(t): i for i, t in enumerate(self.alphabet)}
        for plane in self.planes:
            plane |= {k: self._numbers(plane[k], "<i8") for k in ("ones", "ends")}
        self._block = lru_cache(256)(self._read_block)

    def __len__(self) -> int:
        return self.n

    def _raw(self, place: list[int]) -> memoryview:
        return self.view[self.base + place[0] : self.base + place[0] + place[1]]

    def _numbers(self, place: str | list[int], kind) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._raw(self.head[place] if isinstance(place, str) else place)), kind)

    def _read_block(self, level: int, block: int) -> bytes:
        plane = self.planes[level]
        a, b = (int(x) for x in plane["ends"][block : block + 2])
        raw = bytes(self._raw([plane["bits"][0] + a, b - a]))
        size = (min(self.n - block * BLOCK_BITS, BLOCK_BITS) + 7) // 8
        return raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw)

    def _bit(self, level: int, i: int) -> int:
        block, k = divmod(i, BLOCK_BITS)
        return self._block(level, block)[k >> 3] >> (7 - (k & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """How many of the first i bits of a plane are set."""
        block, k = divmod(i, BLOCK_BITS)
        before = int(self.planes[level]["ones"][block])
        if not k:
            return before
        return before + (int.from_bytes(self._block(level, block)[: (k + 7) >> 3], "big") >> (-k & 7)).bit_count()

    def _place(self, level: int, k: int, bit: int) -> int:
        """Where the k-th bit of this value stands in a plane, from 0."""
        ones = self.planes[level]["ones"]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self._block(level, block), np.uint8), count=min(self.n - block * BLOCK_BITS, BLOCK_BITS))
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def token(self, i: int) -> int:
        """The token at place i, by one rank on each plane."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        number = 0
        for level, plane in enumerate(self.planes):
            bit, ones = self._bit(level, i), self._ones(level, i)
            number = number << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return int(self.alphabet[number])

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        a, b = self._range(token, 0, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often token stands in start:stop."""
        return self.rank(token, self.n if stop is None else stop) - self.rank(token, start)

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        number = self.number.get(token)
        if number is None:
            return 0, 0
        for level, plane in enumerate(self.planes):
            low, high = self._ones(level, a), self._ones(level, b)
            a, b = (plane["zeros"] + low, plane["zeros"] + high) if number >> (self.levels - 1 - level) & 1 else (a - low, b - high)
        return a, b

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of token, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i, number = a + k, self.number[token]
        for level in reversed(range(self.levels)):
            bit = number >> (self.levels - 1 - level) & 1
            i = self._place(level, i - self.planes[level]["zeros"] * bit, bit)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, from the leaf of the matrix upward, all at once."""
        a, b = self._range(token, 0, self.n)
        places = np.arange(a, b)
        for level in reversed(range(self.levels if b > a else 0)):
            bit = self.number[token] >> (self.levels - 1 - level) & 1
            places = np.flatnonzero(self._bits(level) == bit)[places - self.planes[level]["zeros"] * bit]
        return places

    def _bits(self, level: int) -> np.ndarray:
        blocks = range(len(self.planes[level]["ends"]) - 1)
        return np.unpackbits(np.frombuffer(b"".join(self._read_block(level, k) for k in blocks), np.uint8), count=self.n)

    def tokens(self) -> np.ndarray:
        """All tokens: the stable sorts undone plane by plane, from the last."""
        out = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = self._bits(level) > 0
            before, zeros = out, self.planes[level]["zeros"]
            out = np.empty_like(before)
            out[~bit] = before[:zeros]
            out[bit] = before[zeros:] | (1 << (self.levels - 1 - level))
        return self.alphabet[out] if self.n else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids with the end id) of each document, in order."""
        ids = self.tokens()
        for k in range(len(self.doc_ids)):
            yield None if self.without_id[k] else int(self.doc_ids[k]), int(self.starts[k]), ids[self.starts[k] : self.starts[k + 1]]


# --- many files ------------------------------------------------------------------------------------------------------


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder that driver and executors share; a bare path is a local one."""
    if "://" in folder:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def _write(folder: str, name: str, raw: bytes) -> str:
    """Write under a name of this attempt, then move: a file is whole or not there, and a repeated task replaces it by its equal."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(raw)
    store.move(attempt, f"{path}/{name}")
    return f"{folder}/{name}"


def open_file(path: str) -> TokenFile:
    store, inside = _store(path)
    with store.open_input_file(inside) as f:
        return TokenFile(f.read())


MANIFEST = "path string, task int, before long, n_documents long, n_tokens long, n_bytes long"


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of docs (doc_id, text), each document's followed by end_id, to files in folder; returns their manifest.

    Documents are in ascending order of doc_id over all files: rows are range-partitioned and sorted within partitions, and
    tokens are made after that shuffle, once. A file holds whole documents, and is closed at shard_tokens; a longer document
    is in one by itself. Null and empty texts are end_id alone. Null ids come last; rows that repeat an id follow each other, by
    the text's hash, then text. Very long texts are encoded whole. Other columns are dropped; an empty table gives no files.
    folder: a path or address that Python's workers reach on every machine. Manifest: path, task, before (tokens in the
    task's earlier files), n_documents, n_tokens, n_bytes; checkpointed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_file, end_id), TaskContext.get().partitionId()
        ids, lengths, held, size, before, number = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal before, number, size
            raw = packed_file(ids, lengths, np.concatenate(held))
            path = _write(folder, f"{task:06d}-{number:06d}.tokens", raw)
            out = {"path": (path, pa.string()), "task": (task, pa.int32()), "before": (before, pa.int64()), "n_documents": (len(ids), pa.int64()), "n_tokens": (size, pa.int64()), "n_bytes": (len(raw), pa.int64())}
            before, number, size = before + size, number + 1, 0
            for x in (ids, lengths, held):
                x.clear()
            return record_batch({k: ([v], t) for k, (v, t) in out.items()})

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch.column("text"), RUN_BYTES):
                found, n = encode(texts)
                at = 0
                for k, m in enumerate(n.tolist()):
                    if ids and size + m > shard_tokens:
                        yield closed()
                    ids.append(names[first + k])
                    lengths.append(m)
                    held.append(found[at : at + m])
                    size, at = size + m, at + m
        if ids:
            yield closed()

    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").drop("h")
    return checkpoint(ordered.mapInArrow(run, MANIFEST))


def _over_files(manifest: DataFrame, read: Callable[[TokenFile, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of every file; read is given a file and the tokens in all files before it. A file is opened by the task that holds its manifest row."""
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = manifest.join(F.broadcast(tasks), "task").select("path", (F.col("base") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield from read(open_file(path), start)

    return placed.mapInArrow(run, schema)


def documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids as an array if with_ids.

    start: the tokens of all documents before it. n_tokens and ids_crc32, over little-endian unsigned 32-bit ids, hold the end id.
    """

    def read(file: TokenFile, start: int) -> Iterator[pa.RecordBatch]:
        rows = [(d, start + at, len(x), zlib.crc32(x.astype("<u4").tobytes()), *((x,) if with_ids else ())) for d, at, x in file.documents()]
        names = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})
        if rows:
            yield record_batch({k: (v, t) for (k, t), v in zip(names.items(), zip(*rows, strict=True), strict=True)})

    return _over_files(manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of tokens stands in all files, by rank alone; 0 rows for one that no file holds."""

    def read(file: TokenFile, start: int) -> Iterator[pa.RecordBatch]:
        found = [(t, file.count(t)) for t in tokens]
        yield record_batch({"token": ([t for t, _ in found], pa.int64()), "n": ([n for _, n in found], pa.int64())})

    return _over_files(manifest, read, "token long, n long").where("n > 0").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, at): every place of token over all files, and its place in its document."""

    def read(file: TokenFile, start: int) -> Iterator[pa.RecordBatch]:
        places = file.occurrences(token)
        of = np.searchsorted(file.starts, places, side="right") - 1
        ids = pa.array(file.doc_ids[of], pa.int64(), mask=file.without_id[of])
        yield pa.RecordBatch.from_arrays([ids, pa.array(places + start), pa.array(places - file.starts[of])], names=["doc_id", "place", "at"])

    return _over_files(manifest, read, "doc_id long, place long, at long")
