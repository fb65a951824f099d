"""Groups and cuts with three-valued answers, suppression and fragility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M


def cells(rows: DataFrame, group: str, cuts: dict[str, Column], groups: DataFrame | None = None) -> DataFrame:
    """``(group, cut, yes, no, unreadable, readable, share)`` of each answer in each group.

    Answers are unpivoted after they are counted, so rows are never multiplied by cuts. Groups of
    ``groups`` without rows keep empty cells; a null group is left out; a share is null under six
    readable answers.
    """
    counted = [F.struct(F.lit(name).alias("cut"), *(c for c in M.three_counts(answer))).alias(name) for name, answer in cuts.items()]
    wide = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(*counted)
    long = wide.select("group", F.explode(F.array(*cuts)).alias("c")).select("group", "c.*")
    if groups is not None:
        empty = groups.select(F.col(group).alias("group")).distinct().select("group", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
        long = empty.join(long, ["group", "cut"], "left").fillna(0, ["yes", "no", "unreadable"])
    readable = F.col("yes") + F.col("no")
    return long.withColumn("readable", readable).withColumn("share", M.share(F.col("yes"), readable))


def fragility(cells_: DataFrame, least_groups: int = 8, flat: int = 2) -> DataFrame:
    """``(cut, drawable, top, bottom, flips, withheld)``: the groups of highest and lowest share
    (compared as exact fractions), the flips to a tie, and why a cut is withheld: too few
    drawable groups before too flat a spread."""
    drawn = cells_.where(F.col("readable") >= M.LEAST_READABLE)
    # exact order of fractions: a decimal of the quotient with more digits than the counts have
    rate = (F.col("yes").cast("decimal(18,0)") / F.col("readable").cast("decimal(18,0)")).alias("rate")
    ranked = drawn.select("cut", "group", "yes", "readable", rate)
    item = F.struct("group", "yes", "readable")
    ends = ranked.groupBy("cut").agg(
        F.count("*").alias("drawable"), F.min_by(item, F.struct(-F.col("rate"), "group")).alias("top"), F.max_by(item, F.struct(-F.col("rate"), "group")).alias("bottom")
    )
    flips = M.flips_to_tie(F.col("top.yes"), F.col("top.readable"), F.col("bottom.yes"), F.col("bottom.readable"))
    reason = F.when(F.col("drawable") < least_groups, "coverage").when(flips <= flat, "flat")
    return ends.select("cut", "drawable", F.col("top.group").alias("top"), F.col("bottom.group").alias("bottom"), flips.alias("flips"), reason.alias("withheld"))


def cross_cut(rows: DataFrame, group: str, answer: Column) -> DataFrame:
    """``(group, n, yes, rate, suppressed, place)``: readable answers by group; suppressed groups
    last, then higher rates, then names. A null group is left out."""
    counted = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(answer).alias("n"), F.count(F.when(answer, 1)).alias("yes"))
    done = counted.withColumn("suppressed", F.col("n") < M.LEAST_READABLE).withColumn("rate", F.when(F.col("n") > 0, F.col("yes") / F.col("n")))
    order = Window.orderBy("suppressed", F.desc_nulls_last("rate"), F.collate(F.col("group"), "en"), "group")  # one row a group: the vocabulary of groups is small
    return done.withColumn("place", F.row_number().over(order).cast("long"))


def dense(rows: DataFrame, key: str, least: int = M.LEAST_MEMBERS, limit: int = 12) -> DataFrame:
    """``(key, n, kept)`` for each group of ``(key, n)``: the ``limit`` largest of ``least`` members."""
    top = rows.where(F.col("n") >= least).orderBy(F.desc("n"), F.collate(F.col(key), "en"), key).limit(limit).select(key, F.lit(True).alias("kept"))
    return rows.join(top, key, "left").select(key, "n", F.coalesce("kept", F.lit(False)).alias("kept"))


def composition(rows: DataFrame, column: str) -> DataFrame:
    """``(group, n, share)``: members of each value, null and blank ones as ``__none``."""
    group = F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("__none"))
    counted = rows.groupBy(group.alias("group")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("group", "n", (F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10).alias("share"))
