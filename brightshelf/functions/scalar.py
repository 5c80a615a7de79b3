"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000.0


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0.0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from `earlier` to `later`."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY)


def md5_word(text: Column, word: int = 0) -> Column:
    """32-bit word 0..3 of the md5 digest of `text`, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1 + 8 * word, 8), 16, 10).cast("bigint")


def md5_mod_10000(text: Column) -> Column:
    """The 128-bit md5 digest modulo 10000, folded word by word (2**32 % 10000 = 7296)."""
    folded = md5_word(text, 0) % 10000
    for word in (1, 2, 3):
        folded = (folded * 7296 + md5_word(text, word)) % 10000
    return folded


def md5_fraction(text: Column) -> Column:
    """Repeatable uniform draw in [0, 1) keyed by `text`."""
    return md5_word(text) / F.lit(4294967296.0)


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round, and turn -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)
