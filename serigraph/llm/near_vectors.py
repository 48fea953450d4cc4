"""Embedding near-duplicates by collision counting on sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serigraph.llm._common import checkpoint, connected_components, record_batch

#: Vectors, and bytes of them, that the projections of one length are fitted and calibrated on.
SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 32 << 20
#: Vectors of a cell, about; vectors of one side of a task, for a fuller cell is a grid of such tasks.
CELL_ROWS, SIDE = 2_048, 8_192
#: Lengths that get projections of their own, the most frequent ones; vectors of any other length are all compared exactly.
FITTED_LENGTHS = 16
#: Full cells that are looked up in a broadcast table, some 40 bytes each; more of them are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Most deals of the vectors into cells, most near splits that a query crosses in one of them, pairs that calibrate.
DEALS, CROSSED, PAIRS = 12, 4, 4_000


class Projections:
    """Directions, windows and the least number of collisions, all calibrated for the wanted recall.

    Pairs to calibrate on are of three kinds: the pairs of the sample at or above the threshold that are nearest to it, and
    sampled vectors with one made at the threshold itself, in any direction and in that between two sampled vectors (as
    near vectors differ where the sample has few dimensions). The wanted recall must hold for each kind.

    In each deal a vector lies in one cell, by the sides of as many splits as n vectors need, each at the median of a
    projection. As a query it is also in those cells that its window reaches: across the splits nearest to it, measured by
    what near vectors differ by. There are as many deals as the recall takes, the fewest cells in all.
    """

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float, many: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        kinds = calibrating(sample, cosine, rng)
        share = (1 - recall) / 2
        directions = rng.normal(size=(many, sample.shape[1]))
        self.directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
        gaps = [np.abs((a - b) @ self.directions.T) for a, b in kinds]
        self.width = np.max([np.quantile(g, 0.9, axis=0) for g in gaps], axis=0) + 1e-9
        self.least = min(int(np.quantile((g <= self.width).sum(1), share, method="lower")) for g in gaps)
        bits = int(np.ceil(np.log2(max(1.0, n / CELL_ROWS))))
        _, sizes, principal = np.linalg.svd(sample - sample.mean(0), full_matrices=False)
        span = principal[: max(1, int((sizes**2 > 1e-4 * (sizes**2).sum() / len(sizes)).sum()))]
        while True:
            # rotations of the directions in which the sample varies
            turns = [np.linalg.qr(rng.normal(size=(len(span),) * 2))[0] for _ in range(-(-max(1, DEALS * bits) // len(span)))]
            self.splits = (np.concatenate(turns) @ span)[: DEALS * bits]
            self.at = np.median(sample @ self.splits.T, axis=0)
            self.scale = np.max([np.sqrt((((a - b) @ self.splits.T) ** 2).mean(0)) for a, b in kinds], axis=0) + 1e-12
            best = None
            for self.crossed in range(min(bits, CROSSED) + 1):
                found = [np.logical_or.accumulate(np.logical_or(*reached(*self.placed(a), *self.placed(b))), axis=1) for a, b in kinds]
                enough = np.min([f.mean(0) for f in found], axis=0) >= 1 - share
                if enough.any():
                    deals = int(enough.argmax()) + 1
                    cost = deals * (1.0 + (1 << self.crossed))
                    best = min(best or (cost, deals, self.crossed), (cost, deals, self.crossed))
            if best:
                break
            bits -= 1  # fewer, larger cells; a single one loses nothing
        _, self.deals, self.crossed = best
        self.splits, self.at, self.scale = (x[: self.deals * bits] for x in (self.splits, self.at, self.scale))

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and deal its cell and the bits of the splits that it crosses as a query."""
        deals = len(self.splits) and getattr(self, "deals", DEALS)
        if not deals:
            return np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.int64)
        side = (x @ self.splits.T - self.at).reshape(len(x), deals, -1)
        bit = np.int64(1) << np.arange(side.shape[2], dtype=np.int64)
        near = np.argsort(np.abs(side) / self.scale.reshape(1, deals, -1), axis=2)[:, :, : self.crossed]
        return (side > 0) @ bit, bit[near].sum(2)

    def steps(self) -> list[tuple[int, ...]]:
        """Which of the crossed splits, in order of bits, a query crosses to get to each of its cells."""
        return [c for r in range(self.crossed + 1) for c in combinations(range(self.crossed), r)]


class Everything:
    """For a length without projections: one cell, and every pair of it is verified."""

    directions, width, least, crossed = None, (), 0, 0

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.int64)

    def steps(self) -> list[tuple[int, ...]]:
        return [()]


def calibrating(sample: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each kind to calibrate on; real ones only if there are enough to tell a recall from."""
    kinds = []
    base = sample[rng.integers(0, len(sample), PAIRS)]
    for away in (rng.normal(size=base.shape), sample[rng.integers(0, len(sample), PAIRS)] - base):
        away -= (away * base).sum(1, keepdims=True) * base
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        on = norm[:, 0] > 1e-9
        if on.any():
            kinds.append((base[on], cosine * base[on] + np.sqrt(1 - cosine**2) * away[on] / norm[on]))
    real: list[np.ndarray] = []
    for at in range(0, len(sample), 500):
        near = np.triu(sample[at : at + 500] @ sample.T, at + 1)
        i, j = np.nonzero(near >= cosine)
        some = np.argsort(near[i, j])[:PAIRS]
        real.append(np.stack([near[i, j][some], i[some] + at, j[some]]))
    found = np.concatenate(real, axis=1)
    found = found[1:, np.argsort(found[0])[:PAIRS]].astype(np.int64)
    if found.shape[1] >= 100:
        kinds.append((sample[found[0]], sample[found[1]]))
    return kinds or [(base, base)]


def reached(code: np.ndarray, crossed: np.ndarray, other: np.ndarray, other_crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By deal: whether a query is in the cell of the other, and the other as a query in its cell."""
    differ = code ^ other
    return (differ & ~crossed) == 0, (differ & ~other_crossed) == 0


def collisions(q: np.ndarray, x: np.ndarray, width: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pairs (position in q, position in x) with at least so many windows in common, by blocks of q; rows are projected values.

    On each projection x is sorted, and the window around a query is a range of ranks, widened to whole 256ths of them so
    that a byte holds each and none is missed.
    """
    n = len(x)
    lines, buckets = [], np.empty((len(width), n), np.uint8)
    for k in range(len(width)):
        order = np.argsort(x[:, k], kind="stable")
        buckets[k, order] = np.arange(n) * 256 // n
        lines.append(x[order, k])
    step = max(16, (1 << 19) // n)
    for at in range(0, len(q), step):
        some = q[at : at + step]
        hits = np.zeros((len(some), n), np.uint8)
        held, inside = np.empty_like(hits), np.empty(hits.shape, bool)
        for k in range(len(width)):
            low = np.searchsorted(lines[k], some[:, k] - width[k], side="left")
            high = np.maximum(np.searchsorted(lines[k], some[:, k] + width[k], side="right"), low + 1) - 1
            first, last = np.minimum(low, n - 1) * 256 // n, np.minimum(high, n - 1) * 256 // n
            np.subtract(buckets[k][None, :], first.astype(np.uint8)[:, None], out=held)  # below the window it wraps around
            np.less_equal(held, (last - first).astype(np.uint8)[:, None], out=inside)
            np.add(hits, inside.view(np.uint8), out=hits)
        found = np.flatnonzero(hits.ravel() >= least)
        yield at, len(some), found // n, found % n


class Forest:
    """A spanning forest of links among numbered nodes; copies of a link cost no more than a lookup."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.root[a] != self.root[b]
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        _, first = np.unique(self.root[a] * len(self.root) + self.root[b], return_index=True)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = v = parent.get(up, up)
            return v

        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            p, q = find(int(self.root[x])), find(int(self.root[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))
        to = np.arange(len(self.root))
        for v in list(parent):
            to[v] = find(v)
        self.root = to[self.root]


def verified(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (row i of x, row j of y) have the cosine; of many pairs the whole block is multiplied."""
    if len(i) * 8 > len(x) * len(y):
        return (x @ y.T)[i, j] >= cosine
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        some = slice(at, at + (1 << 15))
        out[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]]) >= cosine
    return out


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of rows that are kept as 32-bit floats where those are exact."""
    x = np.empty((len(raw), dim))
    short = np.fromiter((len(r) == 4 * dim for r in raw), bool, len(raw))
    for on, kind in ((short, "<f4"), (~short, "<f8")):
        at = np.flatnonzero(on)
        x[at] = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, many: int = 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Rows are linked when their cosine, in double precision, is at least the given one and the pair shares a cell and enough
    windows. Equal vectors are one class; classes are compared, and rows of a class count as links of each other. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with nothing. Vectors of
    different lengths never link. Rows that repeat a vec_id are separate vectors. An empty table gives an empty one. Other
    columns are dropped.

    A pair counts in the first deal where either vector is a query in the cell of the other, so that its links are sums
    over tasks. A full cell is a grid of tasks. A task returns sums and edges of a spanning forest, never its pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # 128 bits of hash stand for the vector; -0.0 equals 0.0
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))
    fits = rows.where("fit").withColumn("h", F.struct(F.xxhash64(plain), F.xxhash64(F.reverse(plain))))
    classes = fits.groupBy("h").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))  # a vec_id may be of several classes
    links = checkpoint(_links(classes, cosine, recall, many))
    sums = links.where("linked is not null").groupBy("rep").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.select("h", "rep", "n", "least").join(sums, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("h", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "root")
    components = known.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpoint(known.join(components, "root", "left").select("h", "n_links", F.coalesce("component_id", "least").alias("component_id")))
    linked = fits.select("vec_id", "h").join(known, "h").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


PLACED = "dim int, rep long, n long, unit binary, cells binary, crossed binary"
GRID = "dim int, deal int, cell long, query boolean, rep long, n long, unit binary, cells binary, crossed binary"
LINKS = "rep long, linked long, other long"


def _links(classes: DataFrame, cosine: float, recall: float, many: int) -> DataFrame:
    """(rep, linked, null): rows that a class is linked with, by task; (rep, null, other): edges of spanning forests."""
    spark = classes.sparkSession
    lengths = classes.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(FITTED_LENGTHS).collect()
    fitted: dict[int, Projections] = {}
    for dim, n in lengths:
        rows = max(100, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("rep")).limit(rows).select("embedding").toArrow()
        unit = sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim)
        unit = unit / np.abs(unit).max(1, keepdims=True)
        fitted[dim] = Projections(unit / np.linalg.norm(unit, axis=1, keepdims=True), n, cosine, recall, many)
    shared, rest = spark.sparkContext.broadcast(fitted), Everything()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                some = batch.filter(pa.array(size == dim))
                x = some.column("embedding").flatten().to_numpy().reshape(-1, dim)
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                raw = short if (short == x).all() else x.astype("<f8")
                cells, crossed = shared.value.get(dim, rest).placed(unit_rows(list(map(bytes, raw)), dim))
                yield record_batch({
                    "dim": ([dim] * len(x), pa.int32()), "rep": (some.column("rep"), pa.int64()), "n": (some.column("n"), pa.int64()), "unit": (list(map(bytes, raw)), pa.binary()),
                    "cells": (list(map(bytes, cells.astype("<i8"))), pa.binary()), "crossed": (list(map(bytes, crossed.astype("<i8"))), pa.binary()),
                })

    def spread(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, bool]]:
        """(rows, length, deal, their cells, as queries) of a batch of placed vectors."""
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            cells, crossed = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), "<i8").reshape(len(at), -1) for c in ("cells", "crossed"))
            steps = shared.value.get(dim, rest).steps()
            for deal in range(cells.shape[1]):
                yield at, dim, deal, cells[:, deal], False
                left, bits = crossed[:, deal].copy(), []
                while left.any():
                    bits.append(left & -left)
                    left &= left - 1
                for step in steps:
                    yield at, dim, deal, cells[:, deal] ^ sum((bits[b] for b in step), np.int64(0)), True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, dim, deal, cell, query in spread(batch):
                cell, n = np.unique(cell, return_counts=True)
                yield record_batch({"dim": ([dim] * len(n), pa.int32()), "deal": ([deal] * len(n), pa.int32()), "cell": (cell, pa.int64()), "query": ([query] * len(n), pa.bool_()), "rows": (n, pa.int64())})

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, dim, deal, cell, query in spread(batch):
                carried = batch.take(pa.array(at))
                columns = [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), deal, np.int32)), pa.array(cell), pa.array(np.full(len(at), query))]
                yield pa.RecordBatch.from_arrays([*columns, *(carried.column(c) for c in ("rep", "n", "unit", "cells", "crossed"))], names=["dim", "deal", "cell", "query", "rep", "n", "unit", "cells", "crossed"])

    def link(table: pa.Table) -> pa.Table:
        dim, deal = table.column("dim")[0].as_py(), table.column("deal")[0].as_py()
        p = shared.value.get(dim, rest)
        nodes, node = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        weight = table.column("n").to_numpy()
        x = unit_rows(table.column("unit").to_pylist(), dim)
        cells, crossed = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8").reshape(len(x), -1) for c in ("cells", "crossed"))
        is_query = table.column("query").to_numpy()
        at, to = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        total, forest = np.zeros(len(nodes)), Forest(len(nodes))
        if len(at) and len(to):
            if p.directions is None:
                every = np.arange(len(to))
                step = max(16, (1 << 19) // len(to))
                blocks = ((k, len(at[k : k + step]), np.repeat(np.arange(len(at[k : k + step])), len(to)), np.tile(every, len(at[k : k + step]))) for k in range(0, len(at), step))
            else:
                h = x @ p.directions.T
                blocks = collisions(h[at], h[to], p.width, p.least)
            y = x[to]
            for first, n, i, j in blocks:
                some = at[first : first + n]
                near = verified(x[some], y, i, j, cosine)
                a, b = some[i[near]], to[j[near]]
                there, back = reached(cells[a, : deal + 1], crossed[a, : deal + 1], cells[b, : deal + 1], crossed[b, : deal + 1])
                # not in an earlier deal, and once if each is in the cell of the other
                new = (node[a] != node[b]) & ~(there | back)[:, :deal].any(1) & (~back[:, deal] | (node[a] < node[b]))
                a, b = a[new], b[new]
                total += np.bincount(node[a], weight[b], len(nodes)) + np.bincount(node[b], weight[a], len(nodes))
                forest.add(node[a], node[b])
        some = np.flatnonzero(total)
        batch = record_batch({
            "rep": ([*nodes[some].tolist(), *nodes[[a for a, _ in forest.edges]].tolist()], pa.int64()),
            "linked": ([*total[some].astype(np.int64).tolist(), *[None] * len(forest.edges)], pa.int64()),
            "other": ([*[None] * len(some), *nodes[[b for _, b in forest.edges]].tolist()], pa.int64()),
        })
        return pa.Table.from_batches([batch])

    placed = checkpoint(classes.select("rep", "n", "embedding").mapInArrow(place, PLACED))
    key = ["dim", "deal", "cell"]
    sizes = placed.select("dim", "cells", "crossed").mapInArrow(count, "dim int, deal int, cell long, query boolean, rows long").groupBy(*key).agg(
        F.ceil(F.sum(F.when(F.col("query"), F.col("rows"))) / SIDE).cast("int").alias("as"), F.ceil(F.sum(F.when(~F.col("query"), F.col("rows"))) / SIDE).cast("int").alias("bs")
    )
    full = checkpoint(sizes.where("`as` > 1 or bs > 1"))
    grid = placed.mapInArrow(deal_out, GRID)
    grid = grid.join(F.broadcast(full) if full.count() <= BROADCAST_CELLS else full, key, "left")
    side = lambda query, own: F.when(F.col("query") == query, F.array(F.pmod(F.xxhash64("rep"), F.coalesce(own, F.lit(1))).cast("int")))
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    grid = grid.withColumn("a", F.explode(F.coalesce(side(True, F.col("as")), every(F.col("as"))))).withColumn("b", F.explode(F.coalesce(side(False, F.col("bs")), every(F.col("bs")))))
    return grid.drop("as", "bs").groupBy(*key, "a", "b").applyInArrow(link, LINKS)
