"""Symbolic words of sliding windows.

A window of w points, dilation apart, is normalised, averaged into segments, and each mean becomes a symbol; the symbols
are the digits of the word. Signals that have no room for a window give no rows. Words of a constant signal are 0; a flat
or negligible window of another signal has the symbol of score 0 throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serigraph.functions import encoding, symbols
from serigraph.operators.sliding import Windows, bounded, spans
from serigraph.plans.planner import Config
from serigraph.sources.panel import KEYS

#: Positions whose windows one row of blocks() holds, at least; numbers that are made at once.
BLOCK, STEP = 4_096, 1_000_000


def segment_bounds(window_size: int, word_length: int) -> list[int]:
    """Where segments start and, last, where the window ends; uneven if the window is no multiple of the word."""
    if not 1 <= word_length <= window_size:
        raise ValueError(f"word length {word_length} must be 1 to window size {window_size}")
    return [j * window_size // word_length for j in range(word_length + 1)]


def whole_means(panel: DataFrame, word_length: int) -> DataFrame:
    """(ts_id, signal_id, j, mean): the means of word_length segments of each whole signal; none of a shorter signal.

    Plain aggregates: no task holds a signal.
    """
    lengths = panel.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= word_length)
    # the last segment that starts at pos or before: floor(j * n / word_length) <= pos
    j = F.call_function("div", (F.col("pos") + 1) * word_length - 1, F.col("n"))
    return panel.join(lengths, KEYS).groupBy(*KEYS, j.cast("int").alias("j")).agg(F.avg("value").alias("mean"))


def segment_means(panel: DataFrame, config: Config, normalise: bool = True, least_ratio: float = 0.0, cuts: Sequence[float] = ()) -> DataFrame:
    """(ts_id, signal_id, win_idx, constant, means): the segment means of every window, as normal scores if normalise.

    The window size may be any from the word length on; segments are uneven if it is no multiple. Sums are shared by all
    windows of a block, so that a long window costs no more than a short one. Scores so near 0 or one of cuts that rounding could
    tell the side are taken from the points of their window.
    """
    bounds = np.array(segment_bounds(config.window_size, config.word_length))
    sizes = np.diff(bounds)

    def means_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = Points.of(batch)
        starts = points.starts(config)
        place, windows = points.windows([(config.dilation, config.window_size, sizes.tolist())])[config.dilation]
        at = place[starts]
        columns = [windows.sums[int(n)][at + a] / n for a, n in zip(bounds, sizes, strict=False)] if len(starts) else [np.zeros(0)] * len(sizes)
        if not len(starts):
            means = np.zeros((0, len(sizes)))
        elif normalise:
            mean, std, flat, doubt = windows.scored(at, config.window_size)
            least = least_ratio * points.std[starts]
            zero = flat | (std == 0) | (std < least) | points.constant[starts]
            means = np.where(zero[:, None], 0.0, (np.stack(columns, 1) - mean[:, None]) / np.where(zero, 1.0, std)[:, None])
            margin = doubt * (1 + (config.window_size / sizes.min()) ** 0.5)
            unsure = doubt > 1e-3
            for cut in (0.0, *cuts):
                unsure |= (np.abs(means - cut) <= margin[:, None]).any(1) & ~zero
            if least_ratio:
                with np.errstate(invalid="ignore"):
                    unsure |= np.abs(std - least) <= doubt * std
            again = np.flatnonzero(unsure & ~flat & ~points.constant[starts])
            if len(again):
                means[again] = window_scores(points.value, starts[again], config.dilation, bounds, points.std[starts[again]], least_ratio)
        else:
            means = np.stack(columns, 1) + windows.center[at][:, None]
        of = pa.array(points.row[starts])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * len(sizes), pa.int32()), pa.array(means.ravel()))
        columns = [batch.column("ts_id").take(of), batch.column("signal_id").take(of), pa.array(points.pos[starts] // config.stride), pa.array(points.constant[starts]), lists]
        return pa.RecordBatch.from_arrays(columns, names=["ts_id", "signal_id", "win_idx", "constant", "means"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, "points"):
                yield means_of(part)

    return blocks(panel, config.span - 1).mapInArrow(run, "ts_id long, signal_id int, win_idx long, constant boolean, means array<double>")


def present_means(panel: DataFrame, config: Config, normalise: bool = True, least_ratio: float = 0.0) -> DataFrame:
    """(ts_id, signal_id, win_idx, means) of a panel in which missing points keep their place, null or NaN (sources.panel.placed_panel).

    Means, and with normalise the window's mean and std, are of the points that are there; the mean of a segment without any is
    null. Windows that hold no point at all have nulls alone.
    """
    bounds = np.array(segment_bounds(config.window_size, config.word_length))
    sizes = np.diff(bounds)
    w = config.window_size

    def means_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = Points.of(batch)
        starts = points.starts(config)
        order, place = points.by_residue(config.dilation)
        value, row = points.value[order], points.row[order]
        there = ~np.isnan(value)
        filled = np.where(there, value, 0.0)
        n_row, s_row = (np.bincount(row, x, batch.num_rows) for x in (there, filled))
        center = (s_row / np.maximum(n_row, 1))[row]
        moved = np.where(there, value - center, 0.0)
        sums, counts = spans(moved, {w, *sizes.tolist()}), spans(there.astype(float), {w, *sizes.tolist()})
        at = place[starts]
        if len(starts):
            held = np.stack([counts[int(n)][at + a] for a, n in zip(bounds, sizes, strict=False)], 1)
            means = np.stack([sums[int(n)][at + a] for a, n in zip(bounds, sizes, strict=False)], 1) / np.maximum(held, 1)
            if normalise:
                n = np.maximum(counts[w][at], 1)
                mean = sums[w][at] / n
                std = np.sqrt(np.maximum(spans(moved * moved, {w})[w][at] / n - mean * mean, 0.0))
                most, least = (spans(np.where(there, value, odd), {w}, f)[w][at] for f, odd in ((np.maximum, -np.inf), (np.minimum, np.inf)))
                zero = (most <= least) | (std == 0) | (std < least_ratio * points.std[starts]) | points.constant[starts]
                means = np.where(zero[:, None], 0.0, (means - mean[:, None]) / np.where(zero, 1.0, std)[:, None])
            else:
                means = means + center[at][:, None]
        else:
            held = means = np.zeros((0, len(sizes)))
        of = pa.array(points.row[starts])
        cells = pa.array(means.ravel(), mask=held.ravel() == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * len(sizes), pa.int32()), cells)
        columns = [batch.column("ts_id").take(of), batch.column("signal_id").take(of), pa.array(points.pos[starts] // config.stride), lists]
        return pa.RecordBatch.from_arrays(columns, names=["ts_id", "signal_id", "win_idx", "means"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, "points"):
                yield means_of(part)

    known = panel.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return blocks(known, config.span - 1).mapInArrow(run, "ts_id long, signal_id int, win_idx long, means array<double>")


def words(panel: DataFrame, config: Config, least_ratio: float = 0.0, constant_is_middle: bool = False) -> DataFrame:
    """(ts_id, signal_id, win_idx, word) of one configuration.

    constant_is_middle: a constant signal has the symbol of score 0 instead of 0.
    """
    return grid_words(panel, [config], least_ratio, constant_is_middle=constant_is_middle).drop("conf_idx")


def classic_words(panel: DataFrame, config: Config, least_ratio: float = 0.0, constant_is_middle: bool = False) -> DataFrame:
    """words() for any window size from the word length on, with uneven segments where it is no multiple."""
    scored = segment_means(panel, config, True, least_ratio, symbols.BREAKPOINTS[config.alphabet_size])
    digits = [symbols.symbol(F.get("means", F.lit(j)), config.alphabet_size) for j in range(config.word_length)]
    word = encoding.word_of_columns(digits, config.alphabet_size)
    return scored.select(*KEYS, "win_idx", (word if constant_is_middle else F.when(F.col("constant"), F.lit(0)).otherwise(word)).cast("long").alias("word"))


# --- many configurations at once ------------------------------------------------------------------------------------


def blocks(panel: DataFrame, halo: int) -> DataFrame:
    """(ts_id, signal_id, first, stop, points, global_std, constant): bounded runs of a signal with the points after them.

    A row holds the points from first on and halo points beyond stop, so that every window that starts in [first, stop) is
    whole; a signal of any length is dealt over many rows, and its std is a plain aggregate.
    """
    size = max(BLOCK, halo)
    stats = panel.groupBy(*KEYS).agg(F.stddev_pop("value").alias("global_std"), (F.max("value") == F.min("value")).alias("constant"))
    own = F.floor(F.col("pos") / size)
    both = F.when((F.col("pos") % size < halo) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    runs = panel.withColumn("block", F.explode(both)).groupBy(*KEYS, "block").agg(F.collect_list(F.struct("pos", "value")).alias("points"))
    first = (F.col("block") * size).cast("long")
    return runs.join(stats, KEYS).select(*KEYS, first.alias("first"), (first + size).alias("stop"), "points", "global_std", "constant")


def window_scores(values: np.ndarray, starts: np.ndarray, dilation: int, bounds: Sequence[int], global_std: np.ndarray, least_ratio: float) -> np.ndarray:
    """The normal scores of the segments of the window at each start, a column for each segment; 0 in flat or negligible windows.

    Sums run from the first point to the last, one at a time, and the variance is Welford's, as SQL's aggregates over a list take
    them: a score that ties with a breakpoint in exact arithmetic falls on the same side of it.
    """
    n, w = len(starts), bounds[-1]
    total, mean, squares, sums = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, len(bounds) - 1))
    flat, first = np.ones(n, bool), values[starts]
    for j, (a, b) in enumerate(pairwise(bounds)):
        for k in range(a, b):
            x = values[starts + k * dilation]
            flat &= x == first
            total += x
            sums[:, j] += x
            moved = x - mean
            mean = mean + moved / (k + 1)
            squares += (x - mean) * moved
    std = np.sqrt(squares / w)
    zero = flat | (std == 0)
    if least_ratio:
        with np.errstate(divide="ignore", invalid="ignore"):
            zero |= std / global_std < least_ratio
    return np.where(zero[:, None], 0.0, (sums / np.diff(bounds) - (total / w)[:, None]) / np.where(zero, 1.0, std)[:, None])


def window_words(values: np.ndarray, starts: np.ndarray, config: Config, global_std: np.ndarray, constant: np.ndarray, least_ratio: float, constant_is_middle: bool = False) -> np.ndarray:
    """The word of the window at each start, from its points one by one; global_std and constant are those of its signal."""
    n = config.word_length
    bounds = np.arange(n + 1) * config.segment
    cuts, powers = np.array(symbols.BREAKPOINTS[config.alphabet_size]), config.alphabet_size ** np.arange(n - 1, -1, -1, dtype=np.int64)
    out = np.zeros(len(starts), np.int64)
    step = max(1, STEP // n)
    for at in range(0, len(starts), step):
        some = slice(at, at + step)
        z = window_scores(values, starts[some], config.dilation, bounds, global_std[some], least_ratio)
        word = np.searchsorted(cuts, z, side="right") @ powers
        out[some] = word if constant_is_middle else np.where(constant[some], 0, word)
    return out


@dataclass
class Points:
    """Points of a batch of blocks in order of block and position: their block, the block's end and the signal's std and constancy."""

    pos: np.ndarray
    value: np.ndarray
    row: np.ndarray
    ends: np.ndarray  # where the points of its block end
    stop: np.ndarray
    std: np.ndarray
    constant: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Points:
        points = batch.column("points")
        lengths = points.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        flat = points.flatten()
        pos, value = flat.field("pos").to_numpy(), flat.field("value").to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, row))
        batch = batch.set_column(batch.schema.get_field_index("constant"), "constant", batch.column("constant").fill_null(True))
        kept = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("stop", "global_std", "constant"))
        return cls(pos[order], value[order], row, np.cumsum(lengths)[row], *kept)

    def starts(self, config: Config) -> np.ndarray:
        """The points at which a window of this block starts."""
        return np.flatnonzero((self.pos < self.stop) & (self.pos % config.stride == 0) & (np.arange(len(self.pos)) + config.span <= self.ends))

    def by_residue(self, dilation: int) -> tuple[np.ndarray, np.ndarray]:
        """The points in order of block, residue and position, and where each then stands."""
        order = np.lexsort((self.pos, self.pos % dilation, self.row)) if dilation > 1 else np.arange(len(self.pos))
        place = np.empty(len(self.pos), np.int64)
        place[order] = np.arange(len(self.pos))
        return order, place

    def windows(self, wanted: Iterable[tuple[int, int, Iterable[int]]]) -> dict[int, tuple[np.ndarray, Windows]]:
        """By dilation, for (dilation, window size, sizes of segments): where each point stands in order of residue, so that a dilated window is a run; and the sums."""
        out = {}
        wanted = list(wanted)
        for d in {x[0] for x in wanted}:
            order, place = self.by_residue(d)
            of = [x for x in wanted if x[0] == d]
            out[d] = place, Windows(self.value[order], self.row[order], {x[1] for x in of}, {p for x in of for p in x[2]})
        return out


class Kernel:
    """Words of all windows of some blocks, for many configurations, from shared sums: no window is gathered.

    A word whose scores are so near a breakpoint, or whose std so near the least, that rounding could tell is taken from its
    points; so words are those of window_words().
    """

    def __init__(self, points: Points, configs: Iterable[Config]) -> None:
        self.points = points
        self.windows = points.windows((c.dilation, c.window_size, (c.segment,)) for c in configs)

    def words(self, starts: np.ndarray, config: Config, least_ratio: float = 0.0, constant_is_middle: bool = False) -> np.ndarray:
        global_std, constant = self.points.std[starts], self.points.constant[starts]
        place, windows = self.windows[config.dilation]
        w, n, segment = config.window_size, config.word_length, config.segment
        at = place[starts]
        mean, std, flat, doubt = windows.scored(at, w)
        zero = flat.copy()
        unsure = ~flat & (doubt > 1e-3)
        if least_ratio:
            least = least_ratio * global_std
            zero |= std < least
            with np.errstate(invalid="ignore"):
                unsure |= ~flat & (np.abs(std - least) <= doubt * std)
        inverse = 1.0 / np.where(zero | (std == 0), 1.0, std)
        margin = doubt * (1 + n**0.5)
        sums, word = windows.sums[segment], np.zeros(len(at), np.int64)
        cuts = symbols.BREAKPOINTS[config.alphabet_size]
        for j in range(n):
            z = np.where(zero, 0.0, (sums[at + j * segment] / segment - mean) * inverse)
            symbol = np.zeros(len(at), np.int64)
            for cut in cuts:
                symbol += z >= cut
                unsure |= (np.abs(z - cut) <= margin) & ~zero
            word = word * config.alphabet_size + symbol
        again = np.flatnonzero(unsure)
        if len(again):
            word[again] = window_words(self.points.value, starts[again], config, global_std[again], constant[again], least_ratio, True)
        return word if constant_is_middle else np.where(constant, 0, word)


def _tallied(word: np.ndarray, of: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word of each row once, and how often it is there."""
    if (int(of[-1]) + 1) * n_words < 1 << 62:
        both, n = np.unique(of * n_words + word, return_counts=True)
        return both % n_words, both // n_words, n
    order = np.lexsort((word, of))
    word, of = word[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])]))
    return word[first], of[first], np.diff(np.append(first, len(word)))


WORDS = "ts_id long, signal_id int, conf_idx int, win_idx long, word long"
COUNTS = "ts_id long, signal_id int, conf_idx int, word long, cnt long"


def grid_words(panel: DataFrame, configs: list[Config], least_ratio: float = 0.0, counted: bool = False, constant_is_middle: bool = False, with_points: bool = False) -> DataFrame:
    """Words of every window for all configurations: (ts_id, signal_id, conf_idx, win_idx, word), or counts within blocks; with_points: and x, the window's points.

    The panel is shuffled once into blocks; each block is read once for all configurations. counted: (ts_id, signal_id,
    conf_idx, word, cnt), summed in each batch of blocks, to be summed again over all.
    """
    for c in configs:
        c.checked()
    halo = max((c.span - 1 for c in configs), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, "points"):
                yield from words_of(part)

    def words_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        points = Points.of(batch)
        longest = int(batch.column("points").value_lengths().to_numpy().max(initial=0))
        kernel = Kernel(points, [c for c in configs if c.span <= longest])
        ts, signal = batch.column("ts_id"), batch.column("signal_id")
        for k, config in enumerate(configs):
            starts = points.starts(config)
            if not len(starts):
                continue
            word = kernel.words(starts, config, least_ratio, constant_is_middle)
            of = points.row[starts]
            if counted:
                word, of, n = _tallied(word, of, config.n_words)
            take = pa.array(of)
            columns = [ts.take(take), signal.take(take), pa.array(np.full(len(of), k, np.int32))]
            columns += [pa.array(word), pa.array(n)] if counted else [pa.array(points.pos[starts] // config.stride), pa.array(word)]
            names = ["ts_id", "signal_id", "conf_idx", *(("word", "cnt") if counted else ("win_idx", "word"))]
            if with_points:
                x = points.value[starts[:, None] + np.arange(config.window_size) * config.dilation]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * config.window_size, pa.int32()), pa.array(x.ravel())))
                names.append("x")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks(panel, halo).mapInArrow(run, COUNTS if counted else WORDS + (", x array<double>" if with_points else ""))
