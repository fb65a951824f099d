"""Order over whole tables, with no task that has all rows: positions, quantiles, first names, as-of values.

Values are counted, the distinct ones dealt to ranges by Spark's range partitioning, and each range
knows from the others' sums how many rows come before it. So ranks and exact quantiles of a
group hold at any size of the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: A key of over one in so many rows is joined by a broadcast; there are fewer such keys than this.
HOT_SHARE = 1000


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns by name, nulls being equal."""
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join, nulls being equal, of ``rows`` with ``unique``, which has each key once and in ``n`` how
    many of ``rows`` have it. Hot keys are broadcast, the others shuffled without the rows of hot ones.
    ``unique`` should be checkpointed."""
    total, most = unique.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    names = [f"__k{i}" for i in range(len(keys))]
    known = unique.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    least = max(1000, total // HOT_SHARE)
    if most <= least:
        return rows.join(known, same(keys, names)).drop(*names)
    hot = F.broadcast(known.where(F.col(n) > least))
    common = rows.join(hot, same(keys, names))
    rest = rows.join(hot.select(*names), same(keys, names), "left_anti").join(known.where(F.col(n) <= least), same(keys, names))
    return common.unionByName(rest).drop(*names)


def _dealt(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in ranges, with ``__p``, the range's number; written, so that numbers stay what they are."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def positions(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``(by, value, n, before, total)``: for each value of a group how many rows have it, how many have
    a smaller one, and how many the group has. A null is the smallest value."""
    return positions_of(rows.groupBy(*by, value).agg(F.count("*").alias("n")), value, *by)


def positions_of(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """The same from ``counts(by, value, n)``."""
    counts = _dealt(counts.select(*by, value, "n"), *by, value)
    sums = counts.groupBy(*by, "__p").agg(F.sum("n").alias("sum"))  # a row a range and group at most
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("sum").over(group))
    names = [f"__g{i}" for i in range(len(by) + 1)]
    starts = starts.select(*(F.col(c).alias(n) for c, n in zip((*by, "__p"), names, strict=True)), "start", "total")
    inside = F.sum("n").over(Window.partitionBy(*by, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, same([*by, "__p"], names))
    return checkpointed(placed.select(*by, value, "n", (F.col("start") + F.col("inside")).alias("before"), "total"))


def ranked(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``place`` (1 is the greatest) and ``ties`` (others of the same value) within each group."""
    placed = join_unique(rows, positions(rows, value, *by), [*by, value], "n")
    return placed.withColumn("place", (F.col("total") - F.col("before") - F.col("n") + 1).cast("long")).withColumn("ties", F.col("n") - 1).drop("n", "before", "total")


def quantiles(rows: DataFrame, value: str, parts: dict[str, float], *by: str) -> DataFrame:
    """``(by, n, least, ..., greatest)`` of each group's values that aren't null, and for each name in ``parts``
    the value at min(n - 1, floor(q * n)) in their order: exact, by counts and not by a sorted group."""
    placed = positions(rows.where(F.col(value).isNotNull()).select(*by, value), value, *by)

    def at(q: float) -> Column:
        index = F.least(F.col("total") - 1, F.floor(F.col("total") * q))
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col(value)))

    found = placed.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(value).alias("least"), *(at(q).alias(name) for name, q in parts.items()), F.max(value).alias("greatest"))
    if not by:
        return found
    names = [f"__g{i}" for i in range(len(by))]  # groups without a value have a row too
    groups = rows.select(*by).distinct().join(found.withColumnsRenamed(dict(zip(by, names, strict=True))), same(list(by), names), "left")
    return groups.drop(*names).withColumn("n", F.coalesce("n", F.lit(0)))


def first_of(rows: DataFrame, by: list[str], name: str, order: list[str | Column], most: int) -> DataFrame:
    """``(by, first)``: an array of the first ``most`` names of each group. A task sends no more of a group
    than that, and a group's list never has more."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = rows.select(*by, F.col(name).alias("__name"), place.alias("__place")).where(F.col("__place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__place", "__name"))), lambda x: x["__name"])
    return top.groupBy(*by).agg(listed.alias("first"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within: Column | None = None) -> DataFrame:
    """``left`` and ``found``: of the rows of ``right`` with equal keys the last one at or before ``left_at``,
    as a struct, not longer before it than ``within`` where that is given; null for none, and for a null key or time.

    The two are one table in the order of keys and time, dealt in ranges; a range takes the last row
    of those before it. So there is one row a row of either side, and a key with a third of all rows
    has many ranges. Of rows of ``right`` at one time the greatest holds.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    end = lambda frame, at, own, side: frame.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(at).alias("__at"), F.lit(side).alias("__side"), own)
    first = end(right, right_at, F.struct(*right.columns).alias("__found"), 0).where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in (*names, "__at"))))
    second = end(left, left_at, F.struct(*left.columns).alias("__row"), 1)
    rows = _dealt(first.unionByName(second, allowMissingColumns=True), *names, "__at")
    inside = F.last("__found", ignorenulls=True).over(Window.partitionBy(*names, "__p").orderBy("__at", "__side", "__found").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.groupBy(*names, "__p").agg(F.max_by("__found", F.when(F.col("__side") == 0, F.struct("__at", "__found"))).alias("__last"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(n).alias(f"_{n}") for n in names), F.col("__p").alias("___p"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = rows.withColumn("__inside", inside).where("__side = 1").join(carried, same([*names, "__p"], [*(f"_{n}" for n in names), "___p"]), "left")
    found = F.coalesce("__inside", "__carried")
    known = F.col("__at").isNotNull()
    if within is not None:
        known = known & (found[right_at] >= F.col("__at") - within)
    return joined.select("__row.*", F.when(known, found).alias("found"))
