"""N-gram Jaccard join: groups of near-duplicate documents by a prefix-tree join of word shingles."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Observation, Window, functions as F

from serigraph.llm._common import checkpoint, connected_components, mixed, record_batch, text_chunks
from serigraph.llm._words import powers, words_of

#: Shingles that one task counts at a time, about; shingles of the documents that one tree holds, about.
PART_SHINGLES, TREE_SHINGLES = 3_000_000, 1_000_000
#: Shingles that a task gathers before it deals them out.
FLUSH = 2_000_000
#: One text in so many is looked at for hot shingles, those in so many of these texts; at most so many of them, 8 bytes each, are broadcast.
HOT_ONE_IN, HOT_TEXTS, HOT_SHINGLES = 1_024, 32, 1_000_000
#: What a hot shingle counts for in the order of rarity.
HOT = 0xFFFFFFFF
#: Sets that one task links on a shingle of their prefixes are dealt by salts.
SALTS = 16
#: Sets of a candidate component that every one of its blocks gets, to link the blocks.
PIVOTS = 8
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a shorter text has its whole sequence as one."""
    words = words_of(texts, lower=True)
    h, count = words.hash, len(words.hash)
    step = powers(n, _STEP)
    runs = np.zeros(max(0, count - n + 1), np.uint64)
    for k in range(n):
        runs += h[k : count - n + 1 + k] * step[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(mixed((h[a:b] * step[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def least_shared(size: int, percent: int) -> int:
    """Shingles that a set of this size must share with any set that it links with."""
    return -(-size * percent // 100)


# --- counting shingles over all documents --------------------------------------------------------------------------

DEALT = "part int, hot boolean, doc_id long, words long, sig long, size int, keys binary, sizes binary, counts binary, tokens binary"


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _looked_over(rows: DataFrame, n: int) -> tuple[int, int, np.ndarray]:
    """Bytes and number of all texts, and the hot shingles, sorted, from one text in HOT_ONE_IN; in one scan."""
    seen = Observation()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_chunks(batch.column("text")):
                yield record_batch({"token": (np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts, n)]).view(np.int64), pa.int64())})

    some = rows.select("text", F.xxhash64("text").alias("h")).observe(seen, F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    # written at once: a plan that runs in stages can lose what it has seen if one of them is empty
    some = checkpoint(some.where(F.col("text").isNotNull() & (F.pmod("h", F.lit(HOT_ONE_IN)) == 0)))
    counts = some.dropDuplicates(["h"]).select("text").mapInArrow(tokens, "token long").groupBy("token").count().where(F.col("count") >= HOT_TEXTS)
    hot = [r["token"] for r in counts.orderBy(F.desc("count"), "token").limit(HOT_SHINGLES).collect()]
    return seen.get["bytes"] or 0, seen.get["rows"], np.sort(np.array(hot, np.int64).view(np.uint64))


def _dealt(docs: DataFrame, n: int, parts: int, hot: Broadcast) -> DataFrame:
    """A row for each document (doc_id, words, sig, size), and rows that carry the shingles of a part: those of each set in turn.

    Hot shingles, of which a part could not hold all, are no part's; each set's own go with the rows of its key. Rows of
    documents pass through any part, so that copies and empty texts are dealt evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        turn = TaskContext.get().partitionId()

        def rows(keys: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, of: np.ndarray, part: np.ndarray, is_hot: bool) -> Iterator[pa.RecordBatch]:
            order = np.argsort(part, kind="stable")
            tokens, of = tokens[order], of[order]
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                first = np.flatnonzero(np.concatenate([[True], of[a + 1 : b] != of[a : b - 1]]))
                sets = of[a:b][first]
                row = {"keys": keys[sets], "sizes": sizes[sets].astype("<u4"), "counts": np.diff(np.append(first, b - a)).astype("<u4"), "tokens": tokens[a:b]}
                yield record_batch(
                    {"part": ([int(p)], pa.int32()), "hot": ([is_hot], pa.bool_()), "doc_id": ([None], pa.int64()), "words": ([None], pa.int64()), "sig": ([None], pa.int64()), "size": ([None], pa.int32())}
                    | {c: ([v.tobytes()], pa.binary()) for c, v in row.items()}
                )

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(held, np.int64, len(held))
            sizes = np.fromiter(map(len, held.values()), np.int64, len(held))
            tokens, of = np.concatenate(list(held.values())), np.repeat(np.arange(len(keys)), sizes)
            held.clear()
            narrow = np.uint16 if parts < 1 << 16 else np.int64
            mine = _among(tokens, hot.value)
            if mine.any():
                yield from rows(keys, sizes, tokens[mine], of[mine], (keys % parts)[of[mine]].astype(narrow), True)
                tokens, of = tokens[~mine], of[~mine]
            if len(tokens):
                yield from rows(keys, sizes, tokens, of, ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(narrow), False)

        for batch in batches:
            sig, size = [], []
            for _, texts in text_chunks(batch.column("text")):
                for s in shingle_sets(texts, n):
                    key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    sig.append(key)
                    size.append(len(s))
                    if len(s) and key not in held:
                        held[key] = s
                        total += len(s)
                if total > FLUSH:
                    yield from flush()
                    total = 0
            none = pa.nulls(len(sig), pa.binary())
            part = (turn + np.arange(len(sig))) % parts
            turn += len(sig)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.nulls(len(sig), pa.bool_()), batch.column("doc_id"), batch.column("words"), pa.array(sig, pa.int64()), pa.array(size, pa.int32()), none, none, none, none],
                names=["part", "hot", "doc_id", "words", "sig", "size", "keys", "sizes", "counts", "tokens"],
            )
        if held:
            yield from flush()

    return docs.mapInArrow(run, DEALT)


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x is not None), kind)


def _shared_tokens(parts: int):
    """Of one part: the tokens that at least two different sets have, with the number of such sets, by set."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.filter(pa.compute.is_null(table.column("keys"))).select(["doc_id", "words", "sig", "size"])
        none = pa.nulls(len(docs), pa.binary())
        out = [pa.Table.from_arrays([pa.nulls(len(docs), pa.int32()), *docs.columns, none, none, none, none, none], names=SHARED_NAMES)]
        hot = table.filter(table.column("hot"))
        df = pa.array([np.full(len(t) // 8, HOT, "<u4").tobytes() for t in hot.column("tokens").to_pylist()], pa.binary())
        empty = [pa.nulls(len(hot), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
        out.append(pa.Table.from_arrays([hot.column("part"), *empty, *(hot.column(c) for c in ("keys", "sizes", "counts", "tokens")), df], names=SHARED_NAMES))
        blocks = table.filter(pa.compute.invert(table.column("hot")))
        tokens = _joined(blocks, "tokens", np.uint64)
        counts = _joined(blocks, "counts", "<u4")
        ordered = np.sort(tokens)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, tokens), len(again) - 1)
            on = again[at] == tokens
            keys = np.repeat(_joined(blocks, "keys", np.int64), counts)[on]
            sizes = np.repeat(_joined(blocks, "sizes", "<u4"), counts)[on]
            at = at[on]
            order = np.lexsort((at, keys))
            keys, sizes, at = keys[order], sizes[order], at[order]
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])  # copies dealt by several tasks
            keys, sizes, at = keys[first], sizes[first], at[first]
            df = np.bincount(at, minlength=len(again))
            live = df[at] > 1
            keys, sizes, at = keys[live], sizes[live], at[live]
            group = keys % parts
            order = np.argsort(group, kind="stable")
            keys, sizes, at, group = keys[order], sizes[order], at[order], group[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(keys)][: len(starts)], strict=True):
                begin = a + np.flatnonzero(np.diff(keys[a:b], prepend=keys[a] - 1))
                row = (keys[begin], sizes[begin], np.diff(np.append(begin, b)).astype("<u4"), again[at[a:b]], df[at[a:b]].astype("<u4"))
                out.append(pa.Table.from_arrays([pa.array([int(group[a])], pa.int32()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())), *(pa.array([v.tobytes()], pa.binary()) for v in row)], names=SHARED_NAMES))
        return pa.concat_tables(out)

    return run


SHARED_NAMES = ["group", "doc_id", "words", "sig", "size", "keys", "sizes", "counts", "tokens", "df"]
SHARED = "group int, doc_id long, words long, sig long, size int, keys binary, sizes binary, counts binary, tokens binary, df binary"
SETS = "sig long, size int, prefix int, tokens binary, df binary"


def _live_sets(percent: int):
    """Sets whose shared tokens suffice for a link: those tokens, the rarest first, and how many of them are prefix."""

    def run(table: pa.Table) -> pa.Table:
        counts = _joined(table, "counts", "<u4")
        keys, sizes = np.repeat(_joined(table, "keys", np.int64), counts), np.repeat(_joined(table, "sizes", "<u4"), counts)
        tokens, df = _joined(table, "tokens", np.uint64), _joined(table, "df", "<u4")
        order = np.lexsort((tokens, df, keys))
        keys, sizes, tokens, df = keys[order], sizes[order], tokens[order], df[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])])[: len(keys)]  # hot shingles of copies dealt by several tasks
        keys, sizes, tokens, df = keys[first], sizes[first], tokens[first], df[first]
        found: list[list] = [[], [], [], [], []]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
            size = int(sizes[a])
            need = least_shared(size, percent)
            if b - a >= need:
                # tokens that no other set has come first in the order of rarity, so the prefix starts with them
                for column, value in zip(found, (int(keys[a]), size, (size - need + 1) - (size - (b - a)), tokens[a:b].tobytes(), df[a:b].tobytes()), strict=True):
                    column.append(value)
        batch = record_batch({c: (v, t) for (c, t), v in zip((("sig", pa.int64()), ("size", pa.int32()), ("prefix", pa.int32()), ("tokens", pa.binary()), ("df", pa.binary())), found, strict=True)})
        return pa.Table.from_batches([batch])

    return run


# --- the tree -------------------------------------------------------------------------------------------------------


class PrefixTree:
    """A compressed trie of token sets in the order of df, in how many sets of all a token is: the most frequent first, so that alike sets share paths.

    Each node holds the tokens of its edge, the sets that end there, and bounds of its subtree: the least and greatest
    size of a set and the most tokens still to come.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], df: list[np.ndarray]) -> None:
        everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, first, back, counts = np.unique(everything, return_index=True, return_inverse=True, return_counts=True)
        weight = (np.concatenate(df) if df else np.zeros(0, np.uint32))[first].astype(np.int64)
        rank = np.empty(len(values), np.int64)
        common = int((counts > 1).sum())  # tokens that one set of the tree alone has never match: they come last
        rank[np.lexsort((values, -weight, counts == 1))] = np.arange(len(values))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(int)
        ranks = rank[back]
        self.sets = [np.sort(r[r < common]) for r in (ranks[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))]
        self.sizes, self.width = sizes, common
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.order = order
        n = len(order)
        shared = [0] * n
        for k in range(1, n):
            a, b = self.sets[order[k - 1]], self.sets[order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(differ[0]) if len(differ) else m
        self.nodes: list[tuple] = []  # edge tokens, first and past-last leaf, ending sets, children, least and greatest size, most tokens left
        self.root = self._build(shared)
        self.uniform: list[bool] = [False] * len(self.nodes)
        self.indexed = -1

    def _build(self, shared: list[int]) -> int:
        order, sets, sizes = self.order, self.sets, self.sizes
        todo = [(0, len(order), 0, -1)] if order else []
        kids: list[list[int]] = []
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = min(shared[lo + 1 : hi]) if hi - lo > 1 else len(sets[order[lo]])
            if parent < 0:
                end = 0
            number = len(self.nodes)
            kids.append([])
            if parent >= 0:
                kids[parent].append(number)
            edge = sets[order[lo]][depth:end]
            k = lo
            while k < hi and len(sets[order[k]]) == end:
                k += 1
            some = [order[i] for i in range(lo, hi)]
            low, high = min(sizes[i] for i in some), max(sizes[i] for i in some)
            self.nodes.append((edge, lo, hi, order[lo:k], low, high, max(len(sets[i]) for i in some) - end, end))
            start = k
            while start < hi:
                stop = start + 1
                while stop < hi and shared[stop] > end:
                    stop += 1
                todo.append((start, stop, end, number))
                start = stop
        # in the order of leaves, with the first leaf of each
        self.kids = [sorted(some, key=lambda k: self.nodes[k][1]) for some in kids]
        self.kid_leaves = [[self.nodes[k][1] for k in some] for some in self.kids]
        return 0

    def _prefix(self, i: int, percent: int) -> np.ndarray:
        """The rarest tokens of a set, one of which any set that links with it has among its own; those of no other set are the rarest."""
        n = self.sizes[i] - least_shared(self.sizes[i], percent) + 1 - (self.sizes[i] - len(self.sets[i]))
        return self.sets[i][max(0, len(self.sets[i]) - n) :] if n > 0 else self.sets[i][:0]

    def _index(self, percent: int) -> None:
        """For each token the leaves, in order, whose prefixes hold it."""
        parts = [self._prefix(i, percent) for i in self.order]
        tokens = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        leaves = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        by = np.argsort(tokens, kind="stable")
        self.leaves, self.bounds, self.indexed = leaves[by], np.searchsorted(tokens[by], np.arange(self.width + 1)), percent

    def links(self, query: int, percent: int, parent: list[int]) -> Iterator[int]:
        """Sets that link with the set numbered query and are not in its component yet, by one walk of the tree.

        A walk carries the overlap of the path, so that sets with a common start share it. A subtree is left out when no set in
        it shares a token of the prefixes, its sizes or the tokens that remain on either side cannot reach the bound, or all its
        sets are in the component.
        """
        if self.indexed != percent:
            self._index(percent)
        mine, size = self.sets[query], self.sizes[query]
        near = [self.leaves[self.bounds[t] : self.bounds[t + 1]] for t in self._prefix(query, percent).tolist()]
        near = np.unique(np.concatenate(near)).tolist() if near else []
        if len(near) < 2:  # its own leaf
            return
        mask = np.zeros(self.width + 1, bool)
        mask[mine] = True
        todo = [(self.root, 0)] if self.nodes else []
        while todo:
            number, overlap = todo.pop()
            edge, _, _, ending, low, high, left, _ = self.nodes[number]
            if 100 * high < percent * size or 100 * size < percent * low:
                continue
            if self._one_component(number, query, parent):
                continue
            if len(edge):
                overlap += int(mask[edge].sum())
                mine_left = len(mine) - int(np.searchsorted(mine, edge[-1], side="right"))
            else:
                mine_left = len(mine)
            if (100 + percent) * (overlap + min(left, mine_left)) < percent * (size + low):
                continue
            for other in ending:
                if other != query and (100 + percent) * overlap >= percent * (size + self.sizes[other]) and find(parent, other) != find(parent, query):
                    yield other
            todo += [(k, overlap) for k in self._held(number, near)]

    def _held(self, number: int, near: list[int]) -> list[int]:
        """The children of a node in whose subtrees some of the leaves are, which are in order."""
        kids, first = self.kids[number], self.kid_leaves[number]
        at, out = bisect_left(near, first[0]) if kids else len(near), []
        end = self.nodes[number][2]
        while at < len(near) and near[at] < end:
            k = kids[bisect_right(first, near[at]) - 1]
            out.append(k)
            at = bisect_left(near, self.nodes[k][2], at)
        return out

    def _one_component(self, number: int, query: int, parent: list[int]) -> bool:
        lo, hi = self.nodes[number][1:3]
        root = find(parent, query)
        if self.uniform[number]:
            return find(parent, self.order[lo]) == root
        # stops at the first set elsewhere; once uniform a subtree stays so
        if all(find(parent, self.order[k]) == root for k in range(lo, hi)):
            self.uniform[number] = True
            return True
        return False


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def tree_links(sets: list[np.ndarray], sizes: list[int], df: list[np.ndarray], percent: int, queries: list[int] | None = None, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between sets, all found by walks of one prefix tree.

    queries: the sets to walk for (all). joined: for each set a number; those of one number are known to be connected.
    """
    tree = PrefixTree(sets, sizes, df)
    parent = list(range(len(sets)))
    heads: dict[int, int] = {}
    for i, label in enumerate(joined or ()):
        parent[i] = find(parent, heads.setdefault(label, i))
    edges = []
    for q in range(len(sets)) if queries is None else queries:
        for other in tree.links(q, percent, parent):
            a, b = find(parent, q), find(parent, other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((q, other))
    return edges


# --- the join -------------------------------------------------------------------------------------------------------

EDGES = "a long, b long"


def _edges_of(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sig, size = table.column("sig").to_pylist(), table.column("size").to_pylist()
        comp, label = table.column("comp").to_pylist(), table.column("label").to_pylist()
        asks, raw, weights = (table.column(c).to_pylist() for c in ("asks", "tokens", "df"))
        by_comp: dict[int, dict[int, int]] = {}
        for i in range(len(sig)):
            by_comp.setdefault(comp[i], {}).setdefault(sig[i], i)
            if asks[i]:
                by_comp[comp[i]][sig[i]] = i
        a, b = [], []
        for members in by_comp.values():
            rows = list(members.values())
            sets = [np.frombuffer(raw[i], np.uint64) for i in rows]
            queries = [k for k, i in enumerate(rows) if asks[i]]
            df = [np.frombuffer(weights[i], "<u4") for i in rows]
            for x, y in tree_links(sets, [size[i] for i in rows], df, percent, queries, [label[i] for i in rows]):
                a.append(sig[rows[x]])
                b.append(sig[rows[y]])
        return pa.Table.from_batches([record_batch({"a": (a, pa.int64()), "b": (b, pa.int64())})])

    return run


def _tree_rounds(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect every pair of sets with enough overlap; comps: (sig, comp), no link leaves a comp.

    Small components are joined whole, many in a task. One of more than TREE_SHINGLES is cut into blocks by hash: each
    joins its own sets and a few pivots that all blocks have. Then the sets outside its largest group, the only ones that
    may still have unknown links, meet every block once more.
    """
    members = checkpoint(sets.join(comps, "sig").withColumn("n", F.octet_length("tokens") / 8))
    totals = members.groupBy("comp").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / TREE_SHINGLES).cast("int"))
    bins = max(1, int((totals.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // TREE_SHINGLES * 4 + 12))
    totals = checkpoint(totals)
    members = members.join(totals.select("comp", "blocks"), "comp")
    columns = ["sig", "size", "tokens", "df", "comp"]
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    small = members.where("blocks = 1").select(*columns, F.lit(-1).cast("long").alias("key"), F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("int").alias("block"))
    large = members.where("blocks > 1")
    first = small
    has_large = totals.where("blocks > 1").limit(1).count() > 0
    if has_large:
        pivots = large.groupBy("comp", F.pmod(F.hash("sig"), F.lit(PIVOTS))).agg(F.min("sig").alias("sig")).select("comp", "sig")
        everywhere = large.join(pivots, ["comp", "sig"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        first = small.unionByName(large.withColumn("block", own).select(*columns, F.col("comp").alias("key"), "block")).unionByName(everywhere.select(*columns, F.col("comp").alias("key"), "block"))
    first = first.withColumn("asks", F.lit(True)).withColumn("label", F.col("sig"))
    edges = checkpoint(first.groupBy("key", "block").applyInArrow(_edges_of(percent), EDGES))
    if not has_large:
        return edges
    labels = connected_components(edges).toDF("sig", "root")
    large = checkpoint(large.join(labels, "sig", "left").withColumn("label", F.coalesce("root", "sig")))
    groups = large.groupBy("comp", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("group_n"))
    most = groups.groupBy("comp").agg(F.max_by("label", F.struct("rows", "label")).alias("top"), F.count("*").alias("groups"), F.sum("group_n").alias("all_n"), F.max_by("group_n", F.struct("rows", "label")).alias("top_n"))
    most = most.where("groups > 1").select("comp", "top", F.ceil((F.col("all_n") - F.col("top_n")) / TREE_SHINGLES).cast("int").alias("slices"))
    rest = large.join(most, "comp")
    asking = rest.where("label <> top").withColumn("slice", F.pmod(F.hash("sig"), F.col("slices"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    asked = rest.withColumn("block", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("asks", F.lit(False))
    names = [*columns, "label", "asks", "block", "slice"]
    second = asking.select(*names).unionByName(asked.select(*names)).groupBy("comp", "block", "slice").applyInArrow(_edges_of(percent), EDGES)
    return checkpoint(edges.unionByName(second))


def _known(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, words, sig, size, root) of every row of docs (doc_id, text); words: a hash of the text, root: the component of its set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("words"))
    size, count, hot = _looked_over(rows, n)
    parts = int(max(size / 6, count) // PART_SHINGLES) + 1
    dealt = _dealt(rows, n, parts, docs.sparkSession.sparkContext.broadcast(hot))
    counted = checkpoint(dealt.groupBy("part").applyInArrow(_shared_tokens(parts), SHARED))
    sets = checkpoint(counted.where("keys is not null").select("group", "keys", "sizes", "counts", "tokens", "df").groupBy("group").applyInArrow(_live_sets(percent), SETS))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, prefix = batch.column("sig").to_numpy(), batch.column("prefix").to_numpy()
            tokens = [np.frombuffer(t, np.int64)[:p] for t, p in zip(batch.column("tokens").to_pylist(), prefix.tolist(), strict=True)]
            if tokens:
                yield record_batch({"token": (np.concatenate(tokens), pa.int64()), "sig": (np.repeat(sig, prefix), pa.int64())})

    pairs = sets.select("sig", "prefix", "tokens").mapInArrow(prefixes, "token long, sig long").withColumn("salt", F.pmod(F.hash("sig"), F.lit(SALTS)))
    low = pairs.groupBy("token", "salt").agg(F.min("sig").alias("low"), F.max("sig").alias("high"))
    least = low.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    near = pairs.join(low.where("low <> high"), ["token", "salt"]).where("sig <> low").select(F.col("sig").alias("a"), F.col("low").alias("b"))
    near = near.unionByName(low.join(least, "token").where("low <> least").select(F.col("low").alias("a"), F.col("least").alias("b")))
    comps = connected_components(near).toDF("sig", "comp")
    links = connected_components(_tree_rounds(sets, comps, percent)).toDF("sig", "root")
    known = counted.where("keys is null").select("doc_id", "words", "sig", "size")
    return known.join(links, "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    A document's set: the distinct runs of n words (A-Z lower-cased, words split at space and \\x09-\\x0D) of its whole
    text; with fewer words, the whole sequence; null texts and those without words are empty and link with nothing. Two
    documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id that links reach. Rows
    with a null doc_id take no part (component_id null). Rows that repeat a doc_id each count with their own text.
    Shingles are 64-bit hashes, and equal sets, told by a 64-bit hash too, are one set from the start (among 10**10 sets
    some 3 pairs are expected to share a hash). Other columns are dropped. An empty table gives an empty one.

    Shingles are counted over all documents; a set can link only if enough of its shingles are in other sets. Sets that
    share a token of their prefixes, the rarest first, are candidates; the components of that relation are joined exactly
    by prefix trees.
    """
    known = checkpoint(_known(docs, n, percent))
    # a table of its own, so that a component of very many documents can be split among tasks
    least = checkpoint(known.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    # texts without words share no root
    some = known.where("root is not null").join(least, "root").select("doc_id", F.col("size").cast("long").alias("n_shingles"), found.alias("component_id"))
    return some.unionByName(known.where("root is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (on ties of the least hash of its text, then of its row).

    Rows with a null doc_id, and those without words, all stay: they link with nothing. All columns stay.
    """
    known = _known(docs.where("doc_id is not null"), n, percent).groupBy("root", "doc_id", "words").agg(F.count("*").alias("times"))
    known = checkpoint(known)
    kept = known.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "words", "times")).alias("kept")).select("kept.*")
    kept = checkpoint(kept.unionByName(known.where("root is null").select("doc_id", "words", F.lit(1).cast("long").alias("times"))).toDF("kept_id", "kept_words", "times"))
    once, more = kept.where("times = 1"), kept.where("times > 1")
    same = lambda k: (docs["doc_id"].cast("long") == k["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == k["kept_words"])
    out = docs.join(once, same(once), "left_semi").unionByName(docs.where("doc_id is null"))
    if more.limit(1).count():
        rows = docs.join(more, same(more), "left_semi").select(F.struct("*").alias("row"))
        best = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.xxhash64("row"))
        out = out.unionByName(rows.withColumn("place", F.row_number().over(best)).where("place = 1").select("row.*"))
    return out
