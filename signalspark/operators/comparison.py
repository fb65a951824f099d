"""Where one row stands among others: ranks with ties, quartile bands, roll-ups, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def ranked(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``place`` (1 is the greatest) and ``ties`` (others of the same value) within each group."""
    return ordering.ranked(rows, value, *by)


def quartiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, quartiles by floor index, and greatest of each group."""
    return ordering.quantiles(rows, value, QUARTILES, *by).drop("n")


def placement(value: Column) -> Column:
    """The band of a value among its group's ``quartiles``; the first that applies."""
    low, mid, high = F.col("p25"), F.col("median"), F.col("p75")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.col("least") == F.col("greatest"), "flat")
        .when(value <= low, "low")
        .when(value < mid, "below")
        .when(value == mid, "middle")
        .when(value <= high, "above")
        .otherwise("high")
    )


def status_rollup(results: DataFrame, statuses: tuple[str, ...], status: str, *by: str) -> DataFrame:
    """Targets of each run, and how many had each status; statuses that none had count 0."""
    counted = [F.count(F.when(F.col(status) == s, 1)).alias(s.replace("-", "_")) for s in statuses]
    return results.groupBy(*by).agg(F.count("*").alias("targets"), *counted)


def pacing(requests: DataFrame, host: str, order: str, delay: Column, least: int = 60) -> DataFrame:
    """``start``: seconds from the run's begin at which a request may go, so that a host is left
    alone between two for its delay, ``least`` at least."""
    before = Window.partitionBy(host).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.greatest(F.coalesce(delay, F.lit(0)), F.lit(least))
    return requests.withColumn("start", F.coalesce(F.sum(gap).over(before), F.lit(0)).cast("long"))


def origins_differ(environment_a: Column, country_a: Column, environment_b: Column, country_b: Column) -> Column:
    """same, different or indeterminate; an unknown place is never taken for another."""
    a, b = (F.coalesce(e, F.lit("unknown")) for e in (environment_a, environment_b))
    known = (a != "unknown") & (b != "unknown") & (a != b)
    return F.when(known, "different").when(country_a.isNull() | country_b.isNull(), "indeterminate").when(country_a == country_b, "same").otherwise("different")


def signal_status(value: Column, suspect: Column, nulls: Column) -> Column:
    """null, suspect, held or fresh: whether a published value was read, or is carried."""
    return F.when(value.isNull(), F.lit(None).cast("string")).when(suspect > 0, "suspect").when(nulls > 0, "held").otherwise("fresh")
