"""The grid of configurations for a panel, from its shortest and longest signal."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from serigraph.functions.symbols import check_alphabet, check_window


@dataclass(frozen=True)
class Config:
    window_size: int
    dilation: int
    word_length: int
    stride: int = 1
    alphabet_size: int = 3
    slope_alphabet_size: int = 0

    @property
    def span(self) -> int:
        """Points from the first to the last of a window, both included."""
        return (self.window_size - 1) * self.dilation + 1

    @property
    def segment(self) -> int:
        return self.window_size // self.word_length

    @property
    def n_words(self) -> int:
        return self.alphabet_size**self.word_length

    def checked(self) -> Config:
        check_window(self.window_size, self.word_length)
        check_alphabet(self.alphabet_size, self.slope_alphabet_size or None)
        if self.dilation < 1 or self.stride < 1:
            raise ValueError("dilation and stride must be at least 1")
        return self


def growing(start: int, most: float, power: float = 2) -> list[int]:
    """start and its whole multiples by power, up to most."""
    out = []
    while start <= most:
        out.append(start)
        start = int(start * power)
    return out


def window_sizes(shortest: int, longest: int, least: int = 4, most: int | None = None, power: float = 2) -> list[int]:
    """Sizes from 2 on; those below least, but for the 2, count only if the shortest signal is not far above them."""
    sizes = growing(2, longest if most is None else most, power)
    small = [s for s in sizes if s < least][1:]
    return [s for s in sizes if s >= least or s in small and shortest <= small[-1] * power]


def logarithmic_stride(length: int, w: int, d: int) -> int | None:
    """The stride that keeps windows in proportion to length * log(length); None where no stride does."""
    log = math.log(length)
    room = -w + d * w + length * w - d * w * w
    if w == 1:
        return 1 if length > 1 and log > 1 else None
    if not (length > w and 1 <= d < (length - 1) / w - 1):
        return None
    return 1 if log >= (room + 1) / length else math.ceil(room / (length * log - 1))


def plan(
    shortest: int, longest: int, *, least_window: int = 4, most_window: int | None = None, window_power: float = 2, n_word_lengths: int = 4, n_strides: int = 1,
    alphabets: range = range(3, 4), slope_alphabets: range = range(0, 1), least_dilation: int = 1, most_dilation: int | None = None, complexity: str = "quadratic",
) -> list[Config]:
    """Configurations in the order window size, stride, dilation, word length, alphabet, slope alphabet.

    Word lengths are powers of two; a word of one symbol needs slope symbols. complexity sets the stride: quadratic keeps
    it, linear makes it the word length, linear_logarithmic derives it from the shortest signal.
    """
    if complexity not in ("quadratic", "linear_logarithmic", "linear"):
        raise ValueError(complexity)
    windows = window_sizes(shortest, longest, least_window, most_window, window_power)
    dilations = growing(least_dilation, math.log2(longest) if most_dilation is None else most_dilation)
    lengths = [2**i for i in range(n_word_lengths)]
    out = []
    for w, s, d, n, a, b in product(windows, range(1, n_strides + 1), dilations, lengths, alphabets, slope_alphabets):
        if n > w or n == 1 and b <= 1 or w * d > longest:
            continue
        config = Config(w, d, n, s, a, b)
        if complexity == "linear":
            config = replace(config, stride=n)
        elif complexity == "linear_logarithmic":
            stride = logarithmic_stride(shortest, w, d)
            if stride is None:
                continue
            config = replace(config, stride=stride)
        out.append(config)
    return out


def config_table(spark: SparkSession, configs: list[Config], slopes: bool = False) -> DataFrame:
    """conf_idx and the fields of each configuration, that of slopes only if asked for."""
    fields = ("window_size", "dilation", "word_length", "stride", "alphabet_size", *(("slope_alphabet_size",) if slopes else ()))
    rows = [(i, *(int(asdict(c)[f]) for f in fields)) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "conf_idx int, " + ", ".join(f"{f} int" for f in fields))


def grouped(configs: list[Config], *fields: str) -> dict[tuple, list[Config]]:
    """Configurations that agree in fields, in order."""
    out: dict[tuple, list[Config]] = {}
    for c in configs:
        out.setdefault(tuple(getattr(c, f) for f in fields), []).append(c)
    return out
