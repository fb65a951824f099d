"""Page structure in numbers: how sure the types are, what stands where, and how one page compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, measures as M
from ..sources.tables import checkpointed
from . import comparison, ordering, readmodels, sequences
from .insights import COLLATION

#: Measures of a page as columns of its strip (``sequence, sections, words``): a registry to add to.
PAGE_SCALES = {
    "sections": lambda: F.col("sections"),
    "words": lambda: F.col("words"),
    "words_a_section": lambda: F.when(F.col("sections") > 0, formats.rounded(F.col("words") / F.col("sections"), 1)),
    "kinds": lambda: F.size(F.array_distinct(F.split("sequence", " > "))),
}


def page_scales(strips: DataFrame) -> DataFrame:
    """``(measure, n, least, p25, median, p75, greatest)`` of every measure of ``PAGE_SCALES``."""
    parts = [F.struct(F.lit(name).alias("measure"), of().cast("double").alias("value")) for name, of in PAGE_SCALES.items()]
    long = strips.select(F.explode(F.array(*parts)).alias("m")).select("m.*").where("value is not null")
    return ordering.quantiles(long, "value", comparison.QUARTILES, "measure").select("measure", "n", "least", "p25", "median", "p75", "greatest")


def classifier_quality(items: DataFrame, page: str, symbol: str, other: str, worst: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row of all sections and those without a type, with their share; and the pages of the
    largest shares of such sections."""
    n = lambda c: F.count(F.when(c, 1))
    whole = items.agg(F.count("*").alias("sections"), n(F.col(symbol) == other).alias("other")).withColumn("share", F.when(F.col("sections") > 0, formats.rounded(F.col("other") / F.col("sections"), 3)))
    by_page = items.groupBy(page).agg(F.count("*").alias("sections"), n(F.col(symbol) == other).alias("other")).where("other > 0")
    share = formats.rounded(F.col("other") / F.col("sections"), 3)
    return whole, by_page.withColumn("share", share).orderBy(F.desc("share"), F.desc("sections"), page).limit(worst)


def scale_ends(rows: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """``(end, place, key, value)``: the k lowest and the k highest rows; ties by key."""
    known = rows.where(F.col(value).isNotNull()).select(key, value)
    ends = []
    for end, order in (("lowest", F.asc(value)), ("highest", F.desc(value))):
        top = known.orderBy(order, key).limit(k)
        place = F.row_number().over(Window.orderBy(order, key))  # of k rows
        ends.append(top.select(F.lit(end).alias("end"), place.cast("long").alias("place"), key, value))
    return ends[0].union(ends[1])


def company_strips(items: DataFrame, page: str, position: str, symbol: str, size: str) -> DataFrame:
    """A row a page: its types in order, how many, and their words."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(symbol).alias("s"))))
    return items.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " > ").alias("sequence"), F.count("*").alias("sections"), F.sum(size).alias("words"))


def accuracy_block(scores: DataFrame) -> DataFrame:
    """Agreement with the labels, in all and without the trivial type, to two places."""
    ratio = lambda a, b: F.when(F.col(b) > 0, formats.rounded(F.col(a) / F.col(b), 2))
    return scores.withColumn("accuracy", ratio("correct", "matched")).withColumn("rest_accuracy", ratio("rest_correct", "rest_matched"))


def slots(profile: DataFrame, position: str, symbol: str, most: int = 3) -> DataFrame:
    """``(position, place, symbol, n, rest)`` of ``profile(position, symbol, n)``: the commonest types of
    each position, and how many sections there have another."""
    w = Window.partitionBy(position)
    place = F.row_number().over(w.orderBy(F.desc("n"), F.collate(F.col(symbol), COLLATION), symbol))
    ranked = profile.withColumn("place", place.cast("long")).withColumn("total", F.sum("n").over(w))
    shown = F.sum(F.when(F.col("place") <= most, F.col("n"))).over(w)
    return ranked.withColumn("rest", F.col("total") - shown).where(F.col("place") <= most).select(position, "place", symbol, "n", "rest")


def families(items: DataFrame, page: str, symbol: str, family_of: dict[str, str]) -> DataFrame:
    """``(family, pages, share)``: pages with a section of each family of types."""
    lookup = F.create_map(*(F.lit(x) for pair in family_of.items() for x in pair))
    found = items.select(page, F.try_element_at(lookup, F.col(symbol)).alias("family")).where("family is not null")
    total = items.agg(F.countDistinct(page).alias("total"))
    counted = found.groupBy("family").agg(F.countDistinct(page).alias("pages"))
    return counted.crossJoin(F.broadcast(total)).select("family", "pages", formats.rounded(F.col("pages") / F.col("total"), 3).alias("share"))


def same_sequence(sequences: DataFrame, key: str) -> DataFrame:
    """``(key, others)``: how many other pages have exactly the same sequence."""
    counts = checkpointed(sequences.groupBy("sequence").agg(F.count("*").alias("n")))
    return ordering.join_unique(sequences.select(key, "sequence"), counts, ["sequence"], "n").select(key, (F.col("n") - 1).alias("others"))


def page_insights(pages: DataFrame, page: str, value: str) -> DataFrame:
    """``(page, value, place, ties, of, band)``: where a page stands among all by one measure."""
    known = pages.where(F.col(value).isNotNull()).select(page, value)
    bands = ordering.quantiles(known, value, comparison.QUARTILES).withColumnRenamed("n", "of")
    joined = ordering.ranked(known, value).crossJoin(F.broadcast(bands))
    return joined.select(page, value, "place", "ties", "of", comparison.placement(F.col(value)).alias("band"))


def section_insights(items: DataFrame, page: str, position: str, symbol: str, size: str) -> DataFrame:
    """What is usual for a type: pages with it and their share, median position and words, and in
    words how common it is."""
    first = items.groupBy(page, symbol).agg(F.min(position).alias("__p"), F.min_by(size, position).alias("__s"))
    total = items.agg(F.countDistinct(page).alias("total"))
    counted = first.groupBy(symbol).agg(F.count("*").alias("pages"), M.true_median("__p").alias("position"), M.true_median("__s").alias("words"))
    share = F.col("pages") / F.col("total")
    return counted.crossJoin(F.broadcast(total)).select(symbol, "pages", formats.rounded(share, 3).alias("share"), "position", "words", formats.prevalence_words(share).alias("how_common"), formats.share_text(F.col("pages"), F.col("total")).alias("text"))


def shape_names(shapes: DataFrame, items: DataFrame, key: str, symbol: str, most: int = 2, plain: tuple[str, ...] = ("hero", "other")) -> DataFrame:
    """``(shape, n, name)``: each shape by its commonest types, those that half of its pages have."""
    members = shapes.where("shape >= 0")
    size = members.groupBy("shape").agg(F.count("*").alias("n"))
    has = members.join(items.select(key, symbol).distinct(), key).where(~F.col(symbol).isin(*plain)).groupBy("shape", symbol).agg(F.count("*").alias("m"))
    common = has.join(size, "shape").where(2 * F.col("m") >= F.col("n"))
    place = F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("m"), F.collate(F.col(symbol), COLLATION), symbol))
    named = common.withColumn("place", place).where(F.col("place") <= most).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("place", symbol))).alias("t"))
    return size.join(named, "shape", "left").select("shape", "n", F.coalesce(F.array_join(F.transform("t", lambda x: x[symbol]), " + "), F.lit("")).alias("name"))


def examples(items: DataFrame, page: str, symbol: str, most: int = 12) -> DataFrame:
    """``(symbol, examples)``: the first pages that carry each type."""
    place = F.row_number().over(Window.partitionBy(symbol).orderBy(page))
    first = items.select(page, symbol).distinct().withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy(symbol).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", page))), lambda x: x[page].cast("string")), ",").alias("examples"))


def archetype_bands(
    items: DataFrame, page: str, name: str, position: str, symbol: str, size: str, vocabulary: list[str], pinned: str = "hero", unnamed: str = "other", floor: float = 0.15, most: int = 10
) -> DataFrame:
    """``(symbol, carriers, absent, share, position, size, place, breakers, omitted)`` of each type that a page has.

    ``place`` is the band's in the composite page: the pinned type is first and always there, the others go by their
    typical position, then the commoner first; null for those too few pages carry. ``breakers`` are the first names of
    the pages that differ from most: those without a type that half of the pages carry, else those with it;
    ``omitted`` is how many more there are. The unnamed type is none. No pages give no rows.
    """
    kinds = [v for v in vocabulary if v != unnamed]
    named = items.where(F.col(symbol).isin(*kinds))
    order = [F.collate(F.col(name), COLLATION), F.col(page)]
    counted = readmodels.carriers_and_absent(items, items.select(page, name), page, name, symbol, kinds, most).where("carriers > 0")
    middle = sequences.first_places(named, page, position, symbol, size).groupBy(symbol).agg(M.true_median(position).alias("position"), M.true_median(size).alias("size"))
    carriers = ordering.first_of(named.select(page, name, symbol).distinct(), [symbol], name, order, most)
    exact = F.col("carriers") / (F.col("carriers") + F.col("absent"))
    rows = counted.join(middle, symbol).join(carriers, symbol).withColumn("share", formats.rounded(exact, 3))
    rows = rows.withColumn("shown", (exact >= floor) | (F.col(symbol) == pinned))
    # a row a type: the window holds no more than the vocabulary
    place = F.row_number().over(Window.partitionBy("shown").orderBy(F.col(symbol) != pinned, "position", F.desc("share"), F.collate(F.col(symbol), COLLATION)))
    usual = F.col("share") >= 0.5
    return rows.select(
        symbol, "carriers", "absent", "share", "position", "size", F.when(F.col("shown"), place).alias("place"), F.when(usual, F.col("missing")).otherwise(F.array_join("first", ", ")).alias("breakers"),
        F.greatest(F.when(usual, F.col("absent")).otherwise(F.col("carriers")) - most, F.lit(0)).cast("long").alias("omitted"),
    )


def stacked(parts: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """``(..., width, offset)``: widths of a stacked bar's parts in percent of their group, and where each begins."""
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(n).over(w)
    return parts.withColumn("width", formats.width(F.col(n), total)).withColumn("offset", formats.width(before, total))


def lead_and_spread(rates: DataFrame, group: str) -> DataFrame:
    """One row of ``cross_cut``'s drawn groups: the highest and lowest rate, and how many points apart."""
    drawn = rates.where("not suppressed")
    ends = drawn.agg(F.min_by(group, "place").alias("top"), F.max_by(group, "place").alias("bottom"), F.max("rate").alias("high"), F.min("rate").alias("low"), F.count("*").alias("groups"))
    return ends.select("top", "bottom", formats.rounded((F.col("high") - F.col("low")) * 100, 1).alias("points"), "groups")


def withheld_note(share: DataFrame) -> DataFrame:
    """``near_unanimous`` of rows with a ``share`` in percent: nine in ten or more agree, either way."""
    return share.withColumn("near_unanimous", (F.col("share") >= 90) | (F.col("share") <= 10))
