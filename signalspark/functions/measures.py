"""Counting with unreadable answers, and the three medians, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price buckets, closed below and open above.
PRICE_BUCKETS = (("under-1", 0, 1), ("1-9", 1, 10), ("10-19", 10, 20), ("20-49", 20, 50), ("50-99", 50, 100), ("100-plus", 100, None))
#: Fewest readable answers that a share is published for, and fewest members of a drawn group.
LEAST_READABLE, LEAST_MEMBERS = 6, 4


def bucket(amount: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, low, high in PRICE_BUCKETS:
        inside = amount >= low if high is None else (amount >= low) & (amount < high)
        out = F.when(inside, key).otherwise(out)
    return out


def lower_median(column: str) -> Column:
    """The value at (n - 1) // 2 of the sorted group."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def true_median(column: str) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.expr(f"percentile({column}, 0.5)")


def upper_quantile(column: str, q: float) -> Column:
    """The value at min(n - 1, floor(q * n)) of the sorted group: the first of which more than a
    share of q is at or below."""
    return F.expr(f"percentile_disc({min(1.0, q + 1e-9)!r}) WITHIN GROUP (ORDER BY {column})")


def three_counts(answer: Column) -> list[Column]:
    """yes, no and unreadable of a boolean answer whose null is *not readable*, never no."""
    n = lambda c: F.count(F.when(c, 1))
    return [n(answer).alias("yes"), n(~answer).alias("no"), n(answer.isNull()).alias("unreadable")]


def share(yes: Column, readable: Column) -> Column:
    """Percentage with one decimal, half up; null under ``LEAST_READABLE``."""
    return F.when(readable >= LEAST_READABLE, F.floor(yes * 1000 / readable + 0.5) / 10)


def flips_to_tie(yes_a: Column, n_a: Column, yes_b: Column, n_b: Column) -> Column:
    """Answers of the lower group b that would have to turn to yes for its share to reach that of
    a, in whole numbers; null without a denominator."""
    over = yes_a * n_b - yes_b * n_a
    return F.when((n_a > 0) & (n_b > 0), F.when(over <= 0, F.lit(0)).otherwise(F.ceil(over / n_a)).cast("long"))
