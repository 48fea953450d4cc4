"""Words as integers: symbols of a word are the digits of a number in the base of the alphabet, the first the highest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _div(a: Column, b: int | Column) -> Column:
    """Division of longs, without a double in between."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def power(base: Column, exponent: Column) -> Column:
    """base to the exponent as a long, exact as long as that holds it."""
    return F.aggregate(F.array_repeat(base.cast("long"), exponent.cast("int")), F.lit(1).cast("long"), lambda product, b: product * b)


def word_of(symbols: Column, base: int | Column) -> Column:
    """The integer of an array of symbols."""
    return F.aggregate(symbols, F.lit(0).cast("long"), lambda word, s: word * base + s)


def word_of_columns(symbols: list[Column], base: int) -> Column:
    """The integer of symbols in columns of their own, in plain arithmetic that stays in generated code."""
    return reduce(lambda word, s: word * base + s, symbols, F.lit(0).cast("long"))


def symbols_of(word: Column, base: int | Column, length: int | Column) -> Column:
    """The symbols of a word, padded with zeros in front to the length."""
    base, length = (F.lit(x) if isinstance(x, int) else x for x in (base, length))
    places = F.sequence(F.lit(0), length - 1)
    return F.transform(places, lambda i: F.pmod(_div(word, power(base, length - 1 - i)), base).cast("int"))


def decimal_of(symbols: Column) -> Column:
    """The digits read as a decimal number."""
    return word_of(symbols, 10)


def rebased(decimal: Column, base: int) -> Column:
    """A number whose decimal digits are those of another base."""
    return F.conv(decimal.cast("string"), base, 10).cast("long")


def digits_rebased(number: Column, digits_base: int | Column, base: int | Column, most: int = 63) -> Column:
    """The digits of number in digits_base, read in base."""
    state = F.struct(number.cast("long").alias("rest"), F.lit(1).cast("long").alias("unit"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["rest"] > 0
        digit = acc["rest"] % digits_base
        return F.struct(
            _div(acc["rest"], digits_base).alias("rest"),
            F.when(more & (acc["rest"] >= digits_base), acc["unit"] * base).otherwise(acc["unit"]).cast("long").alias("unit"),
            F.when(more, acc["sum"] + digit * acc["unit"]).otherwise(acc["sum"]).cast("long").alias("sum"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda acc: acc["sum"])


#: The symbol of a pair (mean symbol, slope symbol); -1 is no legal pair.
PAIR_SYMBOLS = [
    [0, 4, 3, 2, 1, 5, 6, 7, 8],
    [1, 5, 7, 8, -1, -1, -1, -1, -1],
    [2, 6, 8, -1, -1, -1, -1, -1, -1],
    [3, 7, -1, -1, -1, -1, -1, -1, -1],
    [4, -1, -1, -1, -1, -1, -1, -1, -1],
    [5, -1, -1, -1, -1, -1, -1, -1, -1],
    [6, -1, -1, -1, -1, -1, -1, -1, -1],
    [7, -1, -1, -1, -1, -1, -1, -1, -1],
    [8, -1, -1, -1, -1, -1, -1, -1, -1],
]


def pair_symbol(mean: Column, slope: Column) -> Column:
    """The symbol of a pair of symbols; null beyond the table."""
    return F.get(F.get(F.lit(PAIR_SYMBOLS), mean), slope)


def pairs_decimal(means: Column, slopes: Column) -> Column:
    """Two arrays of symbols as one decimal number of their pair symbols."""
    return decimal_of(F.zip_with(means, slopes, pair_symbol))


def letters_of(symbols: Column) -> Column:
    """The characters whose codes are the symbols, as a string."""
    return F.array_join(F.transform(symbols, lambda s: F.char(s)), "")


def digits_text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: s.cast("string")), "")


def prepended(number: Column, prefix: Column, digits: Column) -> Column:
    """number with the prefix before its decimal digits."""
    return prefix * power(F.lit(10), digits) + number


def flat_index(row: Column, column: Column, width: int | Column) -> Column:
    return row * width + column


def unflattened(index: Column, *widths: int) -> list[Column]:
    """Coordinates of a flat index in an array whose sizes after the first are widths."""
    out: list[Column] = []
    for width in reversed(widths):
        out.append((index % width).cast("long"))
        index = _div(index, width)
    return [index.cast("long"), *reversed(out)]


def greatest_word(base: Column, length: Column) -> Column:
    return power(base, length) - 1


def halved_symbols(symbols: Column) -> Column:
    """Symbols of half the alphabet."""
    return F.transform(symbols, lambda s: F.floor(s / 2).cast("int"))


def halved_word(symbols: Column) -> Column:
    """Half as many symbols: the floor of the mean of each pair."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(symbols) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.floor((F.get(symbols, 2 * i) + F.get(symbols, 2 * i + 1)) / 2).cast("int"))


def digit_count(number: Column) -> Column:
    """Decimal digits of a positive number; exact for all longs."""
    return F.length(number.cast("string"))
