"""One page or one section held against all others, in numbers and words.

What is counted on a page (*measured*) and what the classifier thinks (*judged*) are kept apart; every
share comes with what it is a share of, and what can't be read is never a zero. Counts of places and types
are small tables joined to the sections; medians and ranks are exact and come from ranges of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import measures as M
from ..sources.tables import checkpointed
from . import comparison, ordering, structure
from .insights import COLLATION


def _fact(key: str, kind: str, n: Column, of: Column, text: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), n.cast("double").alias("n"), of.cast("long").alias("of"), text.alias("text"))


def slot_counts(items: DataFrame, position: str, symbol: str) -> DataFrame:
    """``(position, symbol, n, of, rank, types, top, leaders, lead)``: how many sections at a place have each type, its rank
    there, and the first of the types that lead, how many lead, and with how many sections. A row a place and type."""
    w = Window.partitionBy(position)
    order = w.orderBy(F.desc("n"), F.collate(F.col(symbol), COLLATION), symbol)
    counted = items.groupBy(position, symbol).agg(F.count("*").alias("n")).withColumns({"of": F.sum("n").over(w), "rank": F.row_number().over(order), "types": F.count("*").over(w), "lead": F.max("n").over(w)})
    return counted.withColumn("leaders", F.sum((F.col("n") == F.col("lead")).cast("long")).over(w)).withColumn("top", F.first(symbol).over(order))


def section_comparisons(items: DataFrame, page: str, position: str, symbol: str, size: str) -> DataFrame:
    """``(page, position, symbol, facts)`` of every section of ``items``: facts are structs of key, kind, n, of and text.

    ``words`` and ``place`` are measured; ``slot`` (what usually stands there), ``same`` (how many have this type there) and
    ``anywhere`` (pages with this type) are judged. Words that can't be read give no ``words``.
    """
    own = items.groupBy(page).agg(F.count("*").alias("__sections"), F.count(size).alias("__sized"), M.upper_quantile(size, 0.5).alias("__median"))
    slots = checkpointed(slot_counts(items, position, symbol))
    carried = items.select(page, symbol).distinct().groupBy(symbol).agg(F.count("*").alias("__carry"))
    words = ordering.quantiles(items.select(size), size, {"m": 0.5}).select(F.col("n").alias("__all"), F.col("m").alias("__middle"))
    lengths = ordering.quantiles(own.select("__sections"), "__sections", {"m": 0.5}).select(F.col("n").alias("__pages"), F.col("m").alias("__usual"))
    rows = ordering.join_unique(items.select(page, position, symbol, size), slots, [position, symbol], "n").join(own, page).join(F.broadcast(carried), symbol)
    rows = rows.crossJoin(F.broadcast(words)).crossJoin(F.broadcast(lengths))
    c = F.col
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    num = formats.num
    facts = [
        F.when(c(size).isNotNull(), _fact("words", "measured", c(size), c("__sized"), say(num(c(size)), " words; the middle one of this page's ", num(c("__sized")), " sections has ", num(c("__median")), ", of all ", num(c("__all")), " ", num(c("__middle"))))),
        _fact("place", "measured", c(position) + 1, c("__sections"), say("section ", num(c(position) + 1), " of ", num(c("__sections")), "; the middle one of ", num(c("__pages")), " pages has ", num(c("__usual")))),
        _fact("slot", "judged", c("lead"), c("of"), F.when(c("leaders") == 1, say(formats.share_text(c("lead"), c("of")), " have ", c("top"), " here")).otherwise(say(num(c("leaders")), " types lead here, on ", formats.share_text(c("lead"), c("of")), " each"))),
        _fact("same", "judged", c("n"), c("of"), say(formats.share_text(c("n"), c("of")), " have ", c(symbol), " here", F.when(c("types") > 1, say(", the ", formats.ordinal(c("rank")), " of ", num(c("types")), " types")).otherwise(""))),
        _fact("anywhere", "judged", c("__carry"), c("__pages"), say(formats.share_text(c("__carry"), c("__pages")), " carry ", c(symbol), " somewhere")),
    ]
    return rows.select(page, position, symbol, F.filter(F.array(*facts), lambda f: f.isNotNull()).alias("facts"))


def page_comparisons(strips: DataFrame, page: str) -> DataFrame:
    """``(page, key, value, place, ties, of, band, text)``: each measure of ``structure.PAGE_SCALES`` of each page of
    ``strips(page, sequence, sections, words)``, where it stands among all, and its band; a measure that a page lacks has no row."""
    parts = [F.struct(F.lit(name).alias("key"), of().cast("double").alias("value")) for name, of in structure.PAGE_SCALES.items()]
    long = checkpointed(strips.select(page, F.explode(F.array(*parts)).alias("m")).select(page, "m.*").where("value is not null"))
    bands = ordering.quantiles(long, "value", comparison.QUARTILES, "key").withColumnsRenamed({"n": "of", "key": "__key"})
    rows = ordering.ranked(long, "value", "key").join(F.broadcast(bands), F.col("key") == F.col("__key"))
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    tied = F.when(F.col("ties") > 0, F.concat(F.lit(", with "), formats.num(F.col("ties")), F.lit(" others"))).otherwise("")
    text = F.concat(value, F.lit(", the "), formats.ordinal(F.col("place")), F.lit(" of "), formats.num(F.col("of")), tied)
    return rows.select(page, "key", "value", "place", "ties", "of", comparison.placement(F.col("value")).alias("band"), text.alias("text"))


def sequence_comparisons(strips: DataFrame, page: str) -> DataFrame:
    """``(page, sequence, same, of, text)``: how many pages, itself among them, run the very sequence of each page."""
    others = structure.same_sequence(strips, page).withColumnRenamed(page, "__page")
    total = F.broadcast(strips.agg(F.count("*").alias("of")))
    rows = strips.select(page, "sequence").join(others, F.col(page) == F.col("__page")).crossJoin(total).withColumn("same", F.col("others") + 1)
    text = F.when(F.col("others") > 0, F.concat(formats.share_text(F.col("same"), F.col("of")), F.lit(" run this sequence"))).otherwise("no other page runs this sequence")
    return rows.select(page, "sequence", "same", "of", text.alias("text"))


def carried_and_missing(items: DataFrame, page: str, symbol: str, vocabulary: list[str]) -> DataFrame:
    """``(page, symbol, carried, n, of)``: for every page each type of the vocabulary, whether it carries
    it, and how many of all pages do. A row a page and type; types are few."""
    pages = checkpointed(items.groupBy(page).agg(F.collect_set(symbol).alias("has")))
    n = pages.select(F.explode("has").alias("__symbol")).groupBy("__symbol").agg(F.count("*").alias("n"))
    total = F.broadcast(pages.agg(F.count("*").alias("of")))
    each = pages.select(page, "has", F.explode(F.array(*map(F.lit, vocabulary))).alias(symbol))
    joined = each.join(F.broadcast(n), F.col(symbol) == F.col("__symbol"), "left").crossJoin(total)
    return joined.select(page, symbol, F.array_contains("has", F.col(symbol)).alias("carried"), F.coalesce("n", F.lit(0)).alias("n"), "of")


def classifier_caveat(block: DataFrame) -> DataFrame:
    """``block`` of ``structure.accuracy_block`` with ``caveat``: at what rate a judged type is right, from the counts themselves."""
    text = F.concat(
        F.lit("Types of sections are judged, not read. Held against labels, "), formats.share_text(F.col("rest_correct"), F.col("rest_matched")),
        F.lit(" were right where the answer isn't plain, and "), formats.share_text(F.col("correct"), F.col("matched")), F.lit(" in all. Counts are measured and need no such word."),
    )
    return block.withColumn("caveat", text)


def segment_view(cells: DataFrame, verdicts: DataFrame, first: str) -> DataFrame:
    """``(cut, role, place, text)`` of every cut of ``segments.fragility``: the lead, which is ``first`` if it holds, else the one
    that comes first by name; the rest that hold; and those withheld, with the reason in words.

    ``cells`` are those of ``segments.cells``. A cut nearly all answers to which are alike says so.
    """
    overall = cells.groupBy("cut").agg(F.sum("yes").alias("yes"), F.sum("readable").alias("readable"), F.count("*").alias("groups"))
    rows = verdicts.join(overall, "cut")
    drawn = F.col("withheld").isNull()
    order = Window.orderBy(F.desc(drawn), F.desc(F.col("cut") == first), "cut")  # one row a cut, of which there are a handful
    alike = F.col("yes") * 10 >= F.col("readable") * 9
    alike = (F.col("readable") > 0) & (alike | (F.col("yes") * 10 <= F.col("readable")))
    few = F.concat(F.lit("only "), F.col("drawable").cast("string"), F.lit(" of "), F.col("groups").cast("string"), F.lit(" groups have enough answers"), F.when(alike, F.concat(F.lit("; of all "), F.col("readable").cast("string"), F.lit(" answers "), F.col("yes").cast("string"), F.lit(" are yes"))).otherwise(""))
    near = F.concat(F.lit("the best and the worst group are "), F.col("flips").cast("string"), F.lit(" answers apart"))
    apart = F.concat(F.col("top"), F.lit(" and "), F.col("bottom"), F.lit(" are "), F.col("flips").cast("string"), F.lit(" answers apart"))
    placed = rows.withColumn("place", F.row_number().over(order))
    role = F.when(~drawn, "withheld").when(F.col("place") == 1, "lead").otherwise("rest")
    return placed.select("cut", role.alias("role"), F.col("place").cast("long").alias("place"), F.when(drawn, apart).when(F.col("withheld") == "coverage", few).otherwise(near).alias("text"))


def yes_names(rows: DataFrame, group: str, answer: Column, name: str, most: int = 8) -> DataFrame:
    """``(group, yes, names)``: how many of each group answer yes, and the first of them by name."""
    yes = rows.where(answer & F.col(group).isNotNull()).select(F.col(group).alias("group"), name)
    first = ordering.first_of(yes, ["group"], name, [F.collate(F.col(name), COLLATION), F.col(name)], most)
    return yes.groupBy("group").agg(F.count("*").alias("yes")).join(first, "group").select("group", "yes", F.array_join("first", ", ").alias("names"))


def composition_headline(groups: DataFrame, group: str, n: str) -> DataFrame:
    """One row of ``groups(group, n)``: how many there are, of how many companies, which is the largest, and in words."""
    one = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.min_by(group, F.struct(-F.col(n), F.col(group))).alias("largest"), F.max(n).alias("members"))
    text = F.concat(formats.num(F.col("groups")), F.lit(" groups of "), formats.num(F.col("total")), F.lit(" companies; the largest is "), F.coalesce("largest", F.lit("none")), F.lit(" with "), formats.num(F.coalesce("members", F.lit(0))))
    return one.withColumn("text", text)


def probe_summary(results: DataFrame, ok: Column, cpu: str, size: str, found: str, expected: str) -> DataFrame:
    """One row on a trial run: pages read of all, signals found of those expected, the time's quantiles (by floor index), and the largest page."""
    good = results.where(ok)
    times = ordering.quantiles(good, cpu, {"p50": 0.5, "p95": 0.95}).select("n", "p50", "p95", F.col("greatest").alias("most"))
    sums = good.agg(F.coalesce(F.sum(found), F.lit(0)).alias("found"), F.coalesce(F.sum(expected), F.lit(0)).alias("expected"), F.max(size).alias("largest"))
    total = results.agg(F.count("*").alias("pages"))
    joined = times.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(total))
    return joined.withColumn("text", F.concat(formats.num(F.col("n")), F.lit(" of "), formats.num(F.col("pages")), F.lit(" pages read; signals "), formats.share_text(F.col("found"), F.col("expected"))))
