"""Exact top-k by inner product through distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from serigraph.llm._common import checkpoint, record_batch

#: Numbers of a packed chunk of candidates; bins of a histogram; queries scored at once.
CHUNK_NUMBERS, BINS, STEP = 1 << 18, 256, 128
#: Bytes of the queries that are broadcast in one round.
ROUND_BYTES = 64 << 20
#: A query's histogram is refined until so many candidates for each of its k places are left.
LEFT = 16


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=0, keepdims=True)
    return top[:, 0] * np.linalg.norm(np.divide(x, top, out=np.zeros_like(x), where=top > 0), axis=1)


def _packed(vectors: DataFrame) -> DataFrame:
    """(ids, dim, norm, matrix): chunks of integer vectors floor(256 * x) of one length, as 32-bit floats where those are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                rows = batch.filter(pa.array(size == dim))
                step = CHUNK_NUMBERS // max(dim, 1) or 1
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step)
                    x = np.floor(256.0 * part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(part.num_rows, dim)
                    kind = np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64
                    yield record_batch({
                        "ids": ([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "dim": ([dim], pa.int32()),
                        "norm": ([_norms(x).max()], pa.float64()), "matrix": ([x.astype(kind).tobytes()], pa.binary()),
                    })

    return vectors.mapInArrow(run, "ids binary, dim int, norm double, matrix binary")


class Round:
    """The queries of one round, and what tells how they are scored: small numbers go as 32-bit floats."""

    def __init__(self, ids: np.ndarray, x: list[np.ndarray], norm: float) -> None:
        self.ids = ids
        self.matrix = np.zeros((len(x), max(map(len, x))))
        for i, v in enumerate(x):
            self.matrix[i, : len(v)] = np.floor(256.0 * v)
        # no partial sum is beyond this (Cauchy and Schwarz)
        self.bound = norm * float(_norms(self.matrix).max()) * (1 + 1e-9) + 1
        self.kind = np.float32 if self.bound < 1 << 24 else np.float64
        self.matrix = self.matrix.astype(self.kind)

    def scores(self, some: slice, row: dict) -> np.ndarray:
        """Inner products of some queries with a chunk, which are exact; shorter vectors end in zeros; -inf for a query's own rows."""
        ids, dim, raw = np.frombuffer(row["ids"], "<i8"), row["dim"], row["matrix"]
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim).astype(self.kind, copy=False)
        both = min(dim, self.matrix.shape[1])
        s = (self.matrix[some, :both] @ x[:, :both].T).astype(float)
        s[self.ids[some, None] == ids[None, :]] = -np.inf
        return s


HISTOGRAM = "q int, need int, bin int, n long"


def _histograms(shared: Broadcast, lo: Broadcast, width: float, k: int):
    """Of one task: how many candidates the k best bins of each query have; no others can hold its k-th value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (least, above) = shared.value, lo.value
        n = len(queries.ids)
        best = np.full((n, k), -1, np.int16)
        for batch in batches:
            for row in batch.to_pylist():
                for at in range(0, n, STEP):
                    some = slice(at, min(n, at + STEP))
                    place = (queries.scores(some, row) - least[some, None]) / width
                    # a value above the interval is counted already
                    place = np.where((place >= 0) & (place < BINS), place, -1).astype(np.int16)
                    if place.shape[1] > k:
                        place = np.partition(place, place.shape[1] - k, axis=1)[:, place.shape[1] - k :]
                    both = np.concatenate([best[some], place], axis=1)
                    best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        for at in range(0, n, STEP):
            part = best[at : at + STEP]
            i, _ = np.nonzero(part >= 0)
            counts = np.bincount(i * BINS + part[part >= 0], minlength=len(part) * BINS).reshape(-1, BINS)
            i, b = np.nonzero(counts)
            if len(i):
                yield record_batch({"q": (i + at, pa.int32()), "need": (k - above[i + at], pa.int32()), "bin": (b, pa.int32()), "n": (counts[i, b], pa.int64())})

    return run


FOUND = "query_id long, vec_id long, value double"


def _select(shared: Broadcast, lo: Broadcast, k: int):
    """The candidates not below the bin of the k-th value; of one chunk k at most, the best, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (least, _) = shared.value, lo.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                for at in range(0, len(queries.ids), STEP):
                    some = slice(at, min(len(queries.ids), at + STEP))
                    s = queries.scores(some, row)
                    i, j = np.nonzero((s >= least[some, None]) & (s > -np.inf))
                    order = np.lexsort((ids[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, np.arange(len(s)))[i] < k
                    i, j = i[kept], j[kept]
                    if len(i):
                        yield record_batch({"query_id": (queries.ids[some][i], pa.int64()), "vec_id": (ids[j], pa.int64()), "value": (s[i, j], pa.float64())})

    return run


#: The rank of a score: whether it is above (1) or below (-1) the range of long, itself held in that range, and whole as bytes in order.
EXACT = "query_id long, vec_id long, beyond int, score long, whole binary"
ORDER = ("beyond", "score", "whole")


def _whole(score: int) -> tuple[int, int, bytes | None]:
    """The columns of EXACT for a score of any size; a sum of 2**31 products of doubles has under 2200 bits."""
    beyond = (score >= 1 << 63) - (score < -(1 << 63))
    return (beyond, (1 << 63) - 1 if beyond > 0 else -(1 << 63), (score + (1 << 2399)).to_bytes(300)) if beyond else (0, score, None)


def _integers(x: list[float]) -> list[int]:
    """floor(256 * x), also where 256 * x is beyond a double."""
    return [(n << 8) // d for n, d in (v.as_integer_ratio() for v in x)]


def _large(shared: Broadcast, k: int):
    """Scores in whole numbers of any size, for pairs in which either vector is a large one: of a batch the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[int, list] = {}
            for vec, x, large in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "large")), strict=True):
                x = _integers(x)
                for query, q, big in shared.value:
                    if (large or big) and query != vec:
                        held = best.setdefault(query, [])
                        held.append((-sum(a * b for a, b in zip(q, x, strict=False)), vec))
                        if len(held) > 8 * k:
                            best[query] = sorted(held)[:k]
            rows = [(query, vec, *_whole(-score)) for query, held in best.items() for score, vec in sorted(held)[:k]]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield record_batch({f.split()[0]: (v, t) for f, v, t in zip(EXACT.split(", "), zip(*rows, strict=True), kinds, strict=True)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for every query, by integer inner product.

    vectors and queries have (vec_id long, embedding array of numbers); a component x counts as floor(256 * x). Ties go to
    the smaller vec_id; a row of a query's own vec_id is no candidate for it; with fewer than k candidates all are
    returned. Null ids, and vectors that are null or hold null or non-finite components, take no part; empty ones score 0.
    Rows that repeat are separate candidates but one query, by the least of their vectors. Shorter vectors end in zeros.
    Empty tables give an empty one. Other columns are dropped. Ranks are those of the whole integers, whatever their size; a
    score beyond the range of long is shown as its end.

    Candidates stay where they are: the queries are broadcast to them in rounds of ROUND_BYTES, and only histograms and
    the candidates left are shuffled. Each pass scores everything. The first passes count a histogram of BINS bins over
    each query's interval, sum them over all tasks, and narrow the interval to the bin of the k-th value, until a bin is one
    value or few candidates are left. The last pass takes those that are not below it. Vectors so large (256 * norm of 2**26
    and more is) that double arithmetic would round are scored beside that, in Python's integers, one by one.
    """
    spark = vectors.sparkSession
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fit)
    large = F.exists("embedding", lambda x: F.abs(x) * F.sqrt(F.size("embedding")) >= 2.0**17)
    rows = clean(vectors).withColumn("large", large)
    chunks = checkpoint(_packed(rows.where(~F.col("large"))))
    asked = checkpoint(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("large", large))
    n, dim, big = asked.agg(F.count("*"), F.max(F.size("embedding")), F.count_if("large")).first()
    norm = chunks.agg(F.max("norm")).first()[0]
    big += rows.where("large").count()
    found = []
    rounds = -(-n * max(dim or 0, 1) * 8 // ROUND_BYTES)
    for number in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == number).toArrow()
        ids, x, of = block.column("vec_id").to_numpy(), block.column("embedding").to_pylist(), block.column("large").to_pylist()
        plain = [i for i, b in enumerate(of) if not b]
        if plain and norm is not None:
            found.append(checkpoint(_one_round(chunks, Round(ids[plain], [np.array(x[i], float) for i in plain], norm), k)))
        if big and len(ids):
            shared = spark.sparkContext.broadcast([(int(q), _integers(v), b) for q, v, b in zip(ids, x, of, strict=True)])
            found.append(checkpoint(rows.mapInArrow(_large(shared, k), EXACT)))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*map(F.desc, ORDER), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_round(chunks: DataFrame, queries: Round, k: int) -> DataFrame:
    context = chunks.sparkSession.sparkContext
    shared = context.broadcast(queries)
    n = len(queries.ids)
    least, above = np.full(n, -queries.bound), np.zeros(n, np.int64)
    width = 2 * queries.bound / (BINS - 1)
    while True:
        counted = chunks.mapInArrow(_histograms(shared, context.broadcast((least, above)), width, k), HISTOGRAM)
        summed = counted.groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        # the bin of the k-th value and how many are above it; with fewer than k in all the lowest
        at = F.struct("bin", (F.col("so_far") - F.col("n")).alias("over"), "n")
        places = summed.withColumn("so_far", so_far).groupBy("q").agg(F.coalesce(F.max(F.when(F.col("so_far") >= F.col("need"), at)), F.min(at)).alias("at"))
        places = places.select("q", "at.bin", "at.over", "at.n").toArrow()
        q, bins, over, inside = (places.column(c).to_numpy() for c in ("q", "bin", "over", "n"))
        least[q] += bins * width
        above[q] += over
        if width <= 1 or not len(q) or (above[q] + inside).max() <= LEFT * k:
            break
        width /= BINS - 1
    # a little lower, since the bounds of bins are rounded
    least -= np.maximum(np.abs(least), queries.bound) * 2.0**-48
    best = chunks.mapInArrow(_select(shared, context.broadcast((least, above)), k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(0).alias("beyond"), F.col("value").cast("long").alias("score"), F.lit(None).cast("binary").alias("whole"))
