"""What a corpus says of itself, with three-valued answers: yes, no, and not readable.

Rows are companies; a null value is a page that couldn't be read, and never counts as a no.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from . import ordering, positioning
from .comparison import signal_status

# Published kinds of claims by the families that find them; others are counted in the total only.
CLAIM_KINDS = {"multiplier": "multiplier", "percent": "percent", "percent-trailing": "percent", "count": "count", "money": "money", "time": "time", "rank": "rank"}
#: Ties are broken as people sort names: by letters first, then accents and case.
COLLATION = "en"


def most_first(rows: DataFrame, count: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows by descending count, ties by name; ``limit`` of them."""
    ordered = rows.orderBy(F.desc(count), F.collate(F.col(key), COLLATION), key)
    return ordered if limit is None else ordered.limit(limit)


def coverage(rows: DataFrame, value: Column, suspect: Column, nulls: Column, name: Column, *by: str, most: int | None = None) -> DataFrame:
    """tracked, readable, unreadable, and of the readable those held from an earlier read and those
    that are suspect; ``missing`` are the names that couldn't be read, in order. A report that shows
    only so many takes ``most``: then no task holds or sends more of a group."""
    status = signal_status(value, suspect, nulls)
    n = lambda c: F.count(F.when(c, 1))
    if most is not None:
        counted = coverage(rows, value, suspect, nulls, F.lit(None).cast("string"), *by).drop("missing")
        first = ordering.first_of(rows.where(value.isNull()).select(*by, name.alias("__missing")).where("__missing is not null"), list(by), "__missing", ["__missing"], most)
        names = [f"__b{i}" for i in range(len(by))]
        joined = counted.join(first.withColumnsRenamed(dict(zip(by, names, strict=True))), ordering.same(list(by), names), "left").drop(*names)
        return joined.withColumn("missing", F.coalesce("first", F.array().cast("array<string>"))).drop("first")
    return rows.groupBy(*by).agg(
        F.count("*").alias("tracked"), F.count(value).alias("readable"), n(value.isNull()).alias("unreadable"), n(status == "held").alias("held"), n(status == "suspect").alias("suspect"),
        F.array_sort(F.collect_list(F.when(value.isNull(), name))).alias("missing"),
    )


def tally(rows: DataFrame, company: str, status: Column) -> DataFrame:
    """``(status, n)``: companies by the worst status of their signals; suspect before held before fresh."""
    order = F.create_map(F.lit("fresh"), F.lit(1), F.lit("held"), F.lit(2), F.lit("suspect"), F.lit(3))
    worst = rows.groupBy(company).agg(F.max(F.try_element_at(order, status)).alias("worst")).where("worst is not null")
    name = F.element_at(F.array(F.lit("fresh"), F.lit("held"), F.lit("suspect")), F.col("worst"))
    return worst.groupBy(name.alias("status")).agg(F.count("*").alias("n"))


def headline_words(rows: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """``(word, n, distinct_words)``: the commonest words, one vote a company, and how many
    different words there are in all."""
    stop = F.array(*map(F.lit, T.STOPWORDS))
    votes = rows.select(F.explode(F.array_except(T.tokens(F.col(text)), stop)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = votes.agg(F.count("*").alias("distinct_words"))
    return most_first(votes, "n", "word", limit).crossJoin(F.broadcast(total))


def mentions(fields: list[str]) -> Column:
    """Whether any field names machine intelligence: true, false where all that can be read is
    quiet, null where nothing can be read."""
    table = T.forms(T.AI_TERMS)
    hit = lambda c: F.size(T.families(F.col(c), table)) > 0
    some = reduce(lambda a, b: a | b, (F.coalesce(hit(c), F.lit(False)) for c in fields))
    read = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in fields))
    return F.when(read, some)


def ai_answers(rows: DataFrame, fields: list[str], *by: str) -> DataFrame:
    """mention, quiet and unreadable companies."""
    answer = mentions(fields)
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*by).agg(n(answer).alias("mention"), n(~answer).alias("quiet"), n(answer.isNull()).alias("unreadable"))


def ai_by_field(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, mention, readable)`` of each field by itself."""
    parts = [F.struct(F.lit(c).alias("field"), F.count(F.when(mentions([c]), 1)).alias("mention"), F.count(c).alias("readable")) for c in fields]
    return rows.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def ai_by_term(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(family, n)``: companies with a word of each family in any field; families that none has count 0."""
    table = T.forms(T.AI_TERMS)
    every = reduce(F.array_union, (F.coalesce(T.families(F.col(c), table), F.array().cast("array<string>")) for c in fields))
    parts = [F.struct(F.lit(f).alias("family"), F.count(F.when(F.array_contains(every, f), 1)).alias("n")) for f in T.AI_TERMS]
    return rows.agg(F.array(*parts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def ai_grid(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """``(name, mentions)`` of companies that can be read, those that mention it first."""
    return rows.select(name, mentions(fields).alias("mentions")).where("mentions is not null").orderBy(F.desc("mentions"), F.collate(F.col(name), COLLATION), name)


def pricing_shape(rows: DataFrame, tiers: str, free: str) -> DataFrame:
    """One row of what price pages say: free plans (yes, no, unreadable), price lists that can be
    read, companies that send some plan to the sales team, and the lower median of the entry prices.

    ``tiers`` is an array of struct(name, amount, currency), null where it can't be read; a null
    amount is a price on request. ``free`` is boolean.
    """
    amounts = F.filter(F.transform(tiers, lambda t: t["amount"]), lambda a: a > 0)
    n = lambda c: F.count(F.when(c, 1))
    entry = rows.select("*", F.array_min(amounts).alias("__entry"))
    return entry.agg(
        n(F.col(free)).alias("free_yes"), n(~F.col(free)).alias("free_no"), n(F.col(free).isNull()).alias("free_unreadable"), F.count(tiers).alias("tiers_readable"),
        n(F.exists(tiers, lambda t: t["amount"].isNull())).alias("contact_sales"), M.lower_median("__entry").alias("median_entry"),
    )


def entry_buckets(rows: DataFrame, tiers: str) -> DataFrame:
    """``(bucket, n)``: companies by their least positive price; buckets that none is in count 0."""
    entry = F.array_min(F.filter(F.transform(tiers, lambda t: t["amount"]), lambda a: a > 0))
    counted = rows.where(entry.isNotNull()).groupBy(M.bucket(entry).alias("bucket")).agg(F.count("*").alias("n"))
    known = rows.sparkSession.createDataFrame([(k,) for k, _, _ in M.PRICE_BUCKETS], "bucket string")
    return known.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def currency_mix(rows: DataFrame, tiers: str) -> DataFrame:
    """``(currency, n)``: companies that quote each currency, one vote each."""
    quoted = F.array_distinct(F.filter(F.transform(tiers, lambda t: t["currency"]), lambda c: c.isNotNull()))
    return rows.select(F.explode(quoted).alias("currency")).groupBy("currency").agg(F.count("*").alias("n"))


def contact_sales(rows: DataFrame, tiers: str, name: str) -> DataFrame:
    """Names of companies that have a plan without a price, in order."""
    return rows.where(F.exists(tiers, lambda t: t["amount"].isNull())).select(name).orderBy(F.collate(F.col(name), COLLATION), name)


def proof_claims(rows: DataFrame, text: str) -> DataFrame:
    """``(kind, n, claims, total_claims)``: companies and claims of each published kind; the total
    counts claims of every family."""
    found = rows.select(positioning.claims(F.col(text)).alias("c"))
    total = found.agg(F.coalesce(F.sum(F.size("c")), F.lit(0)).cast("long").alias("total_claims"))
    of = lambda families: F.size(F.filter("c", lambda x: x["kind"].isin(*families)))
    kinds = list(dict.fromkeys(CLAIM_KINDS.values()))
    sizes = {k: of([f for f, p in CLAIM_KINDS.items() if p == k]) for k in kinds}
    parts = [F.struct(F.lit(k).alias("kind"), F.count(F.when(s > 0, 1)).alias("n"), F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0)).cast("long").alias("claims")) for k, s in sizes.items()]
    return found.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*").where("n > 0").crossJoin(F.broadcast(total))


def category_distribution(rows: DataFrame, label: str, limit: int = 20) -> DataFrame:
    """``(label, n)``: the commonest labels in lower case."""
    return most_first(rows.where(F.col(label).isNotNull()).groupBy(F.lower(label).alias("label")).agg(F.count("*").alias("n")), "n", "label", limit)


def noun_tail(groups: DataFrame, readable: str, limit: int) -> DataFrame:
    """How many readable companies are outside the ``limit`` largest of ``groups(noun, n)``."""
    kept = most_first(groups.where("noun is not null"), "n", "noun", limit).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(readable))
    return total.crossJoin(F.broadcast(kept)).select(readable, "kept", (F.col(readable) - F.col("kept")).alias("tail"))
