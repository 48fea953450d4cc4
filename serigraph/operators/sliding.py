"""Sums and extrema of all windows of an array, in steps that do not depend on how long windows are.

A table of spans of 2m points is the one of m points met with itself m places on. So all sizes of a grid, which are powers of
two, share as many passes as the longest has bits, and rounding grows with that number alone: no differences of running sums
are taken, which would lose small windows behind large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Half a unit in the last place of 1; points whose sums are made at once.
ROUND, STEP = 2.0**-53, 500_000


def bounded(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists in column have about STEP elements at most together, a single row at least."""
    total = np.cumsum(batch.column(column).value_lengths().to_numpy())
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + STEP, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _met(a: np.ndarray, b: np.ndarray, by: int, combine: Callable) -> np.ndarray:
    """a[i] met with b[i + by]; where that is beyond the end a[i] stays, which no window within the array uses."""
    out = a.copy()
    combine(a[: len(a) - by], b[by:], out=out[: len(a) - by])
    return out


def spans(values: np.ndarray, sizes: Iterable[int], combine: Callable = np.add) -> dict[int, np.ndarray]:
    """For each size the array of values[i:i + size] combined (np.add, np.maximum, np.minimum), right for i + size <= len(values)."""
    sizes = {s for s in sizes if s <= len(values)}
    out: dict[int, np.ndarray] = {}
    done = dict.fromkeys(sizes, 0)
    table, power = values, 1
    while sizes:
        for size in sizes:
            if size & power:
                out[size] = _met(out[size], table, done[size], combine) if done[size] else table
                done[size] += power
        sizes = {s for s in sizes if s >= 2 * power}
        if sizes:
            table = _met(table, table, power, combine)
            power *= 2
    return out


def placed_sums(values: np.ndarray, size: int) -> np.ndarray:
    """The sum of k * values[i + k], k from 0, over the spans of one size."""
    table, moments, power = values, np.zeros_like(values), 1
    total = np.zeros_like(values)
    covered = 0
    while power <= size:
        if size & power:
            # the span of this power that begins where those before end
            ahead = moments + covered * table
            total = _met(total, ahead, covered, np.add) if covered else ahead.copy()
            covered += power
        moments = _met(moments, moments + power * table, power, np.add)
        table = _met(table, table, power, np.add)
        power *= 2
        if power > len(values):
            break
    return total


class Windows:
    """Statistics of the windows of signals that stand one after the other in values; row tells the signal of each.

    Values are centred by their signal before sums are taken.
    """

    def __init__(self, values: np.ndarray, row: np.ndarray, sizes: Iterable[int], parts: Iterable[int] = ()) -> None:
        sizes = set(sizes)
        first = np.flatnonzero(np.diff(row, prepend=row[0] - 1)) if len(row) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(first, len(row)))
        self.values = values
        self.center = np.repeat(np.add.reduceat(values, first) / lengths, lengths) if len(row) else values
        moved = values - self.center
        self.sums = spans(moved, sizes | set(parts))
        self.squares = spans(moved * moved, sizes)
        self.most, self.least = spans(values, sizes, np.maximum), spans(values, sizes, np.minimum)

    def scored(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows from each of at: mean (centred), std, whether all points are equal, and a bound of the error of a normal score.

        The bound covers the rounding of these sums and that of sums taken over the raw points, relative to the std.
        """
        mean, square = self.sums[size][at] / size, self.squares[size][at] / size
        most, least = self.most[size][at], self.least[size][at]
        flat = most == least
        var = np.maximum(square - mean * mean, 0.0)
        std = np.sqrt(var)
        round_ = (size.bit_length() + 4 + size / 8) * ROUND  # of these sums, and of those point by point
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            doubt = 16 * round_ * ((np.maximum(np.abs(most), np.abs(least)) + np.sqrt(square)) / std + square / var)
        return mean, std, flat, np.where(np.isfinite(doubt), doubt, np.inf)
