"""Ordered sequences of symbols: runs, positions, prevalence, distance, neighbours, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from . import ordering


def collapsed_runs(items: DataFrame, key: str, position: str, symbol: str) -> DataFrame:
    """``(key, run, symbol, first, spans)``: neighbours of one symbol as one run."""
    w = Window.partitionBy(key).orderBy(position)
    starts = items.withColumn("__new", (~F.col(symbol).eqNullSafe(F.lag(symbol).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = starts.withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(key, "run").agg(F.first(symbol).alias(symbol), F.min(position).alias("first"), F.count("*").alias("spans"))


def position_profile(items: DataFrame, position: str, symbol: str, last: int = 8) -> DataFrame:
    """``(position, symbol, n, share)``: what stands at each of the first positions."""
    counted = items.where(F.col(position) < last).groupBy(position, symbol).agg(F.count("*").alias("n"))
    totals = counted.groupBy(position).agg(F.sum("n").alias("total"))
    return counted.join(totals, position).select(position, symbol, "n", (F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10).alias("share"))


def prevalence(items: DataFrame, key: str, symbol: str, vocabulary: list[str]) -> DataFrame:
    """``(symbol, n, pages)`` for all of a vocabulary, those on no page with n = 0."""
    spark = items.sparkSession
    known = spark.createDataFrame([(v,) for v in vocabulary], f"`{symbol}` string")
    counted = items.groupBy(symbol).agg(F.countDistinct(key).alias("n"))
    pages = items.agg(F.countDistinct(key).alias("pages"))
    return known.join(counted, symbol, "left").crossJoin(F.broadcast(pages)).select(symbol, F.coalesce("n", F.lit(0)).alias("n"), "pages")


def scale(rows: DataFrame, column: str) -> DataFrame:
    """n, least, quartiles (by floor index) and greatest of a column."""
    return ordering.quantiles(rows.where(F.col(column).isNotNull()), column, {"p25": 0.25, "median": 0.5, "p75": 0.75})


def first_places(items: DataFrame, key: str, position: str, symbol: str, size: str) -> DataFrame:
    """``(key, symbol, position, size)`` of each symbol's first place in a sequence."""
    first = items.groupBy(key, symbol).agg(F.min_by(F.struct(position, size), F.col(position)).alias("f"))
    return first.select(key, symbol, F.col(f"f.{position}").alias(position), F.col(f"f.{size}").alias(size))


def archetype(items: DataFrame, key: str, position: str, symbol: str, size: str, floor: float = 0.15) -> DataFrame:
    """``(symbol, carriers, share, position, size)`` of symbols that enough sequences carry, by
    each one's first place there; medians are true ones."""
    first = first_places(items, key, position, symbol, size)
    total = items.agg(F.countDistinct(key).alias("total"))
    counted = first.groupBy(symbol).agg(F.count("*").alias("carriers"), M.true_median(position).alias("position"), M.true_median(size).alias("size"))
    share = F.floor(F.col("carriers") * 1000 / F.col("total") + 0.5) / 1000
    return counted.crossJoin(F.broadcast(total)).withColumn("share", share).where(F.col("share") >= floor).select(symbol, "carriers", "share", "position", "size")


def typical_positions(items: DataFrame, position: str, symbol: str) -> DataFrame:
    counted = items.groupBy(symbol, position).agg(F.count("*").alias("n"))
    return counted.groupBy(symbol).agg((F.sum(F.col(position) * F.col("n")) / F.sum("n")).alias("typical"))


def encoded(items: DataFrame, key: str, position: str, symbol: str, vocabulary: list[str]) -> DataFrame:
    """``(key, sequence)``: each sequence as a string with a letter a symbol; others are ``?``."""
    letters = F.create_map(*(F.lit(x) for i, v in enumerate(vocabulary) for x in (v, chr(97 + i))))
    letter = F.coalesce(F.try_element_at(letters, F.col(symbol)), F.lit("?"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), letter.alias("l"))))
    return items.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "").alias("sequence"))


def distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; null if either is empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _far(x: Column, y: Column) -> Column:
    """Distance of two sequences in thousandths, half up."""
    return F.floor(distance(x, y) * 1000 + 0.5)


def _useful(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (x, y, far, size) but those that more than ``k`` members of nearer sequences come before."""
    nearer = F.sum("size").over(Window.partitionBy("x").orderBy("far").rangeBetween(Window.unboundedPreceding, -1))
    return pairs.withColumn("nearer", F.coalesce(nearer, F.lit(0))).where(F.col("nearer") <= k).drop("nearer")


#: The last radius, in edits, before the rest is held against all.
FAR = 4


def _segments(known: DataFrame, tau: int) -> DataFrame:
    """``(y, m, i, part)``: each sequence of over ``tau`` symbols in ``tau + 1`` even parts, the last ones longer by one."""
    size, left = F.floor(F.col("m") / (tau + 1)), F.col("m") % (tau + 1)
    late = F.greatest(F.lit(0), F.col("i") - (tau + 1 - left))
    rows = known.where(F.col("m") > tau).select("y", "m", F.explode(F.sequence(F.lit(0), F.lit(tau))).alias("i"))
    start, length = F.col("i") * size + late, size + (F.col("i") >= tau + 1 - left).cast("int")
    return rows.select("y", "m", "i", F.substring("y", start.cast("int") + 1, length.cast("int")).alias("part"))


def _probes(left: DataFrame, tau: int, longest: int) -> DataFrame:
    """``(x, m, i, part)``: what of ``left(x, n)`` may be part i of a sequence of m symbols at most ``tau``
    edits away. That part stands d places from where it stands there, with |d| + |n - m - d| <= tau."""
    lengths = F.sequence(F.greatest(F.lit(tau + 1), F.col("n") - tau), F.least(F.lit(longest), F.col("n") + tau))
    able = F.least(F.lit(longest), F.col("n") + tau) >= F.greatest(F.lit(tau + 1), F.col("n") - tau)
    rows = left.where(able).select("x", "n", F.explode(lengths).alias("m"))
    size, more = F.floor(F.col("m") / (tau + 1)), F.col("m") % (tau + 1)
    rows = rows.select("x", "n", "m", size.alias("size"), more.alias("more"), F.explode(F.sequence(F.lit(0), F.lit(tau))).alias("i"))
    start = F.col("i") * F.col("size") + F.greatest(F.lit(0), F.col("i") - (tau + 1 - F.col("more")))
    length = F.col("size") + (F.col("i") >= tau + 1 - F.col("more")).cast("int")
    gap = F.col("n") - F.col("m")
    rows = rows.select("x", "n", "m", "i", length.cast("int").alias("length"), start.cast("int").alias("start"), gap.alias("gap"))
    first = F.greatest(F.lit(0), F.col("start") - F.floor((tau - F.col("gap")) / 2).cast("int"))
    last = F.least(F.col("n") - F.col("length"), F.col("start") + F.floor((tau + F.col("gap")) / 2).cast("int"))
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last").select("x", "m", "i", "length", F.explode(F.sequence("first", "last")).alias("at"))
    return rows.select("x", "m", "i", F.substring("x", F.col("at") + 1, F.col("length")).alias("part")).distinct()


def candidates(left: DataFrame, known: DataFrame, tau: int, longest: int) -> DataFrame:
    """``(x, y)``: every pair of ``left(x, n)`` and ``known(y, m)`` at most ``tau`` edits apart, and few others.

    Of ``tau + 1`` parts of y one is untouched by ``tau`` edits, so x has it near its place: a join on
    parts. Sequences of ``tau`` symbols or fewer have no such parts, and are met by their length.
    """
    parts = _probes(left, tau, longest).join(_segments(known, tau), ["m", "i", "part"]).select("x", "y")
    # the lengths run upwards as n <= 2 * tau and n, tau >= 1
    short = left.where(F.col("n") <= 2 * tau).select("x", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - tau), F.least(F.lit(tau), F.col("n") + tau))).alias("m"))
    return parts.union(short.join(known.where(F.col("m") <= tau), "m").select("x", "y")).distinct()


def nearest_sequences(members: DataFrame, k: int) -> DataFrame:
    """``(x, y, distance)`` of distinct sequences ``members(sequence, size)``: for each the others, and
    itself, that can be among the k nearest of one of its members.

    The radius grows, in edits: 1, 2, 4, and then all. What is farther than ``tau`` edits has a distance of
    ``(tau + 1) / (n + tau + 1)`` at least, n being the own length; so a sequence with more than k
    members nearer than that is done, and only those that stand alone are held against every other.
    """
    known = _cut(members.where(F.length("sequence") > 0).select(F.col("sequence").alias("y"), "size", F.length("sequence").alias("m")))
    longest = known.agg(F.max("m")).first()[0] or 0
    open_, done, tau = known.select(F.col("y").alias("x"), F.col("m").alias("n")), [], 1
    while True:
        near = candidates(open_, known.select("y", "m"), tau, longest).where(F.levenshtein("x", "y", tau) >= 0)
        pairs = _cut(near.join(known.select("y", "size"), "y").select("x", "y", _far(F.col("x"), F.col("y")).alias("far"), "size"))
        least = F.floor(1000 * (tau + 1) / F.least(F.lit(longest), F.length("x") + tau + 1) + 0.5)
        enough = pairs.groupBy("x").agg(F.sum(F.when(F.col("far") < least, F.col("size"))).alias("held")).where(F.col("held") > k).select("x") if tau < longest else open_.select("x")
        enough = _cut(enough)
        done.append(_useful(pairs.join(enough, "x", "left_semi"), k))
        open_ = _cut(open_.join(enough, "x", "left_anti"))
        if open_.isEmpty():
            break
        tau = 2 * tau if tau < FAR else max(longest, 1)  # what stands alone is held against all that is left
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select("x", "y", (F.col("far") / 1000).alias("distance"))


def neighbours(sequences: DataFrame, key: str, k: int = 6) -> DataFrame:
    """``(src, dst, distance, place)``: the k nearest of each sequence, by distance to three
    places and then key.

    Equal sequences are compared once: distances are between distinct sequences, and each keeps
    the few nearest that can hold k members.
    """
    members = sequences.groupBy("sequence").agg(F.count("*").alias("size"))
    useful = nearest_sequences(members, k)
    left = sequences.select(F.col(key).alias("src"), F.col("sequence").alias("x"))
    # of equal sequences only the first k + 1 keys can be anyone's neighbours
    place = F.row_number().over(Window.partitionBy("sequence").orderBy(key))
    right = sequences.withColumn("__n", place).where(F.col("__n") <= k + 1).select(F.col(key).alias("dst"), F.col("sequence").alias("y"))
    near = left.join(useful, "x").join(right, "y").where("src <> dst")
    order = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return near.withColumn("place", order.cast("long")).where(F.col("place") <= k).select("src", "dst", "distance", "place")


def shapes(edges: DataFrame, keys: DataFrame, key: str, near: float = 0.30, least: int = 4) -> DataFrame:
    """``(key, shape)``: components over edges nearer than ``near``, numbered by size and then
    first key; -1 for those of fewer than ``least``.

    Labels spread by the smallest neighbour's label and the label's own label, so the rounds
    grow with the logarithm of a chain's length; each round is checkpointed.
    """
    both = edges.where(F.col("distance") < near).select("src", "dst")
    both = both.union(both.select("dst", "src")).distinct().toDF("src", "dst")
    labels = keys.select(F.col(key).alias("node"), F.col(key).alias("label"))
    both, labels = _cut(both), _cut(labels)
    while True:
        heard = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("heard"))
        new = labels.join(heard, F.col("node") == F.col("src"), "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = _cut(new.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "next").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            break
        labels = new.select("node", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = sizes.withColumn("shape", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)
    return labels.join(numbered, "label", "left").select(F.col("node").alias(key), F.coalesce("shape", F.lit(-1)).cast("long").alias("shape"))


def _cut(frame: DataFrame) -> DataFrame:
    from ..sources.tables import checkpointed

    return checkpointed(frame)


def scored(predicted: DataFrame, truth: DataFrame, keys: list[str], label: str, trivial: str, order: str | None = None) -> DataFrame:
    """matched, correct, and both without the trivial label, of predictions against the truth. Of
    labels that repeat a key the last by ``order`` holds, of those at one place the greatest."""
    at = F.col(order) if order else F.lit(0)
    known = truth.groupBy(*keys).agg(F.max_by(label, F.struct(at, F.col(label))).alias("__truth"))
    both = predicted.join(known, keys)
    right = F.col(label) == F.col("__truth")
    rest = F.col("__truth") != trivial
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(F.count("*").alias("matched"), n(right).alias("correct"), n(rest).alias("rest_matched"), n(rest & right).alias("rest_correct"))
