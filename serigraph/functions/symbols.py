"""Normal scores and symbols of segment means, and the checks of their parameters."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

#: Breakpoints of the standard normal for alphabets of 2 to 9 symbols, by a polynomial inverse error function.
BREAKPOINTS: dict[int, list[float]] = {
    2: [0.0],
    3: [-0.4307273521948292, 0.4307273521948291],
    4: [-0.6744897744388745, 0.0, 0.6744897744388745],
    5: [-0.8416211822956143, -0.25334711476046495, 0.25334711476046495, 0.8416211822956144],
    6: [-0.967421497321014, -0.4307273521948292, 0.0, 0.4307273521948291, 0.967421497321014],
    7: [-1.067570490942767, -0.5659488782650971, -0.18001236972136092, 0.18001236972136078, 0.5659488782650971, 1.0675704909427668],
    8: [-1.1503494048862308, -0.6744897744388745, -0.3186393908574708, 0.0, 0.3186393908574708, 0.6744897744388745, 1.1503494048862308],
    9: [-1.2206404282801846, -0.76470965596471, -0.4307273521948292, -0.13971029564052925, 0.13971029564052925, 0.4307273521948291, 0.76470965596471, 1.2206404282801844],
}


def breakpoints(alphabet_size: int, mean: float = 0.0, std: float = 1.0) -> list[float]:
    check_alphabet(alphabet_size)
    return [mean + std * b for b in BREAKPOINTS[alphabet_size]]


def normal_quantile(p: float, mean: float = 0.0, std: float = 1.0) -> float:
    """The value below which a normal variable is with probability p; infinite for 0 and 1."""
    if p in (0.0, 1.0):
        return math.inf if p else -math.inf
    return NormalDist(mean, std).inv_cdf(p)


def valid_alphabet(size: Column) -> Column:
    return size.between(2, 9)


def valid_alphabets(size: Column, slope_size: Column) -> Column:
    return valid_alphabet(size) & valid_alphabet(slope_size) & (size * slope_size <= 9)


def divisible(window_size: Column, word_length: Column) -> Column:
    return window_size % word_length == 0


def segmentable(window_size: Column, word_length: Column) -> Column:
    """Whether a window has a point for each segment."""
    return window_size >= word_length


def is_empty(values: Column) -> Column:
    return F.size(values) == 0


def check_alphabet(size: int, slope_size: int | None = None) -> None:
    if not 2 <= size <= 9 or slope_size is not None and not (2 <= slope_size <= 9 and size * slope_size <= 9):
        raise ValueError(f"alphabet sizes {size}, {slope_size}: each must be 2 to 9, their product at most 9")


def check_window(window_size: int, word_length: int) -> None:
    if word_length < 1 or window_size < word_length or window_size % word_length:
        raise ValueError(f"window size {window_size} must be a multiple of word length {word_length}")


def fits(length: Column | int, window_size: int, dilation: int) -> Column | bool:
    """Whether a signal has room for a dilated window."""
    return length >= (window_size - 1) * dilation + 1


def n_windows(length: Column, window_size: int, dilation: int = 1, stride: int = 1, padding: int = 0) -> Column:
    return (1 + F.floor((length + 2 * padding - window_size - (dilation - 1) * (window_size - 1)) / stride)).cast("long")


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """0 where std is 0."""
    return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(value - mean, std))


def unscored(score: Column, mean: Column, std: Column) -> Column:
    return score * std + mean


def negligible(std: Column, global_std: Column, least_ratio: float) -> Column:
    """Whether a window varies too little beside its signal: either is constant, or the ratio is below the least."""
    return (global_std == 0) | (std == 0) | F.coalesce(F.try_divide(std, global_std) < least_ratio, F.lit(False))


def symbol(score: Column, alphabet_size: int) -> Column:
    """How many breakpoints are not above the score; -1 for NaN."""
    steps = [F.when(score >= F.lit(b), 1).otherwise(0) for b in BREAKPOINTS[alphabet_size]]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return F.when(F.isnan(score), F.lit(-1)).otherwise(total)
