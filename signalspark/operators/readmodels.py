"""Read models: companies joined to what was last read of them, their feed, health and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering, series
from .insights import COLLATION

#: Rows of a company's page: its events and its last fetches.
MOST_EVENTS, MOST_FETCHES, MOST_FEED, MOST_PEERS = 200, 20, 200, 8
# States of health, the worst first.
HEALTH_ORDER = ("blocked", "stale", "structure-changed", "error", "origin-shift", "degraded", "pending", "ok")


def latest_by_kind(observations: DataFrame, company: str, kind: str, order: str) -> DataFrame:
    """The last observation of each page."""
    return series.latest(observations, [company, kind], order)


def latest_signals(observations: DataFrame, company: str, order: str, signals: str = "signals") -> DataFrame:
    """``(company, signals)``: of every signal what the last observation that lists it says, null
    where that one couldn't read it; observations of all pages of a company add up."""
    each = observations.select(company, F.col(order).alias("__order"), F.explode(signals).alias("signal", "v"))
    last = each.groupBy(company, "signal").agg(F.max_by("v", "__order").alias("v"))
    return last.groupBy(company).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "v")))).alias("signals"))


def latest_by_company(companies: DataFrame, signals: DataFrame, company: str, name: str) -> DataFrame:
    """Every company with its ``signals``, null for one that was never read, in the order of names."""
    return companies.join(signals, company, "left").orderBy(F.collate(F.col(name), COLLATION), company)


def signal_value(signals: Column, name: str) -> Column:
    """The value of a signal, null where it can't be read; a blank one counts as that."""
    return F.nullif(F.try_element_at(signals, F.lit(name))["value"], F.lit(""))


def signal_json(signals: Column, name: str, schema: str) -> Column:
    """A signal's data by a schema; null for none or for broken JSON."""
    return F.from_json(F.try_element_at(signals, F.lit(name))["json"], schema)


def number_of(value: Column) -> Column:
    """The number in a text: all but digits, points and minus signs left out; null for none."""
    return F.regexp_replace(value, r"[^\d.-]", "").try_cast("double")


def sections_of(signals: Column) -> Column:
    """Sections of a page in order, null where they can't be read."""
    schema = "sections array<struct<position:int,type:string,heading:string,words:int,merged:int>>"
    return signal_json(signals, "anatomy_sections", schema)["sections"]


def recent_changes(events: DataFrame, retractions: DataFrame, keys: list[str], at: str, limit: int = MOST_FEED) -> DataFrame:
    """Published events, the latest first, ties by the key."""
    return series.published(events, retractions, keys).orderBy(F.desc(at), *keys).limit(limit)


def filtered_feed(feed: DataFrame, signal: str | None = None, segment: str | None = None, name: str | None = None, limit: int = 80) -> DataFrame:
    """Rows of a feed by signal, segment and a part of the name in any case."""
    if signal is not None:
        feed = feed.where(F.col("signal") == signal)
    if segment is not None:
        feed = feed.where(F.col("segment") == segment)
    if name is not None:
        feed = feed.where(F.lower("name").contains(name.lower()))
    return feed.limit(limit)


def company_events(events: DataFrame, queue: DataFrame, company: str, keys: list[str], at: str, limit: int = MOST_EVENTS) -> DataFrame:
    """Each company's last events, ``place`` 1 the latest, with whether a later read confirmed them."""
    place = F.row_number().over(Window.partitionBy(company).orderBy(F.desc(at), *keys))
    last = events.withColumn("place", place.cast("long")).where(F.col("place") <= limit)
    joined = last.join(queue.select(company, "last_ok_at"), company, "left")
    return joined.withColumn("confirmed", series.confirmed(F.col("last_ok_at"), F.col(at))).drop("last_ok_at")


def company_fetches(results: DataFrame, company: str, order: str, limit: int = MOST_FETCHES) -> DataFrame:
    """Each company's last fetches over all runs, ``place`` 1 the latest."""
    place = F.row_number().over(Window.partitionBy(company).orderBy(F.desc(order)))
    return results.withColumn("place", place.cast("long")).where(F.col("place") <= limit)


def max_of(*columns: Column) -> Column:
    """The latest of some times, nulls aside."""
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def company_health(companies: DataFrame, queue: DataFrame, suspects: DataFrame, changes: DataFrame, company: str, cutoff: Column) -> DataFrame:
    """Every company with the state of its reads, its suspect signals and its changes.

    ``queue(company, kind, last_attempted_at, last_ok_at, last_status)`` has a row a page; the
    home page's status is the company's, a page read from another place marks it as shifted, and
    the latest time of any page counts.
    """
    home = F.col("kind") == "home"
    pages = queue.groupBy(company).agg(
        F.max("last_attempted_at").alias("last_attempted_at"), F.max("last_ok_at").alias("last_ok_at"), F.max(F.when(home, F.col("last_status"))).alias("last_status"), F.max(F.col("last_status") == "origin-shift").alias("shifted")
    )
    joined = companies.join(pages, company, "left").join(suspects, company, "left").join(changes, company, "left").fillna(0, ["suspect", "changes"])
    state = series.health(F.col("last_attempted_at"), F.col("last_ok_at"), F.col("last_status"), F.col("suspect"), F.coalesce("shifted", F.lit(False)), cutoff)
    return joined.withColumn("state", state).drop("shifted")


def health_order(state: Column) -> Column:
    """Place of a state among the worst first."""
    return F.array_position(F.array(*map(F.lit, HEALTH_ORDER)), state)


def index_stats(observations: DataFrame, results: DataFrame, events: DataFrame, company: str, as_of: Column) -> DataFrame:
    """One row: observations, companies, time span, suspect readings, changes of 7 and 30 days, and
    fetches, blocked and failed ones of the last day."""
    since = lambda at, days: F.col(at) > as_of - F.make_dt_interval(F.lit(days))
    n = lambda c: F.count(F.when(c, 1))
    seen = observations.agg(F.count("*").alias("observations"), F.countDistinct(company).alias("companies"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), n(F.col("suspect") > 0).alias("suspect"))
    day = since("at", 1)
    fetched = results.agg(n(day).alias("fetches_24h"), n(day & (F.col("status") == "blocked")).alias("blocked_24h"), n(day & (F.col("status") == "error")).alias("errors_24h"))
    changed = events.agg(F.count("*").alias("changes"), n(since("at", 7)).alias("changes_7d"), n(since("at", 30)).alias("changes_30d"))
    return seen.crossJoin(F.broadcast(fetched)).crossJoin(F.broadcast(changed))


def facts(companies: DataFrame, ai: DataFrame, free: DataFrame, company: str) -> DataFrame:
    """The published facts of each company: three-valued answers stay null where nothing was read."""
    return companies.join(ai, company, "left").join(free, company, "left")


def peer_blocks(rows: DataFrame, group: str, name: str, most: int = MOST_PEERS) -> DataFrame:
    """``(group, n, shown, omitted, names, note)``: the first names of each group in order, and in
    words how many are left out."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.collate(F.col(name), COLLATION), name))
    listed = rows.select(group, name, place.alias("place")).groupBy(group)
    blocks = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", name)))).alias("first"))
    names = F.transform("first", lambda x: x[name])
    shown = F.size("first").cast("long")
    note = F.when(F.col("n") > shown, F.concat(F.lit("and "), (F.col("n") - shown).cast("string"), F.lit(" more")))
    return blocks.select(group, "n", shown.alias("shown"), (F.col("n") - shown).alias("omitted"), F.array_join(names, ", ").alias("names"), note.alias("note"))


def carried_good(states: DataFrame, results: DataFrame, keys: list[str], good_at: str, at: str) -> DataFrame:
    """States whose time of the last good read moves on to the page's last ok read up to ``at``:
    an unchanged page has confirmed what it said."""
    ok = results.where(F.col("status").isin(*series.OK_STATUSES)).select(*keys, F.col("at").alias("__ok"))
    joined = ordering.as_of(states, ok, keys, at, "__ok")
    return joined.withColumn(good_at, F.when(F.col(good_at).isNotNull(), F.greatest(good_at, "found.__ok"))).select(states.columns)


def staleness(last_ok_at: Column, as_of: Column, counts: dict[str, Column], hours: int = 36) -> Column:
    """A banner's text: how long nothing was read, then what else is wrong; null if all is well."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last_ok_at)) / 3600)
    late = F.when(last_ok_at.isNull(), F.lit("nothing has been read yet")).when(age > hours, F.concat(F.lit("last read "), age.cast("string"), F.lit(" hours ago")))
    wrong = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in counts.items()]
    return F.nullif(F.concat_ws("; ", late, *wrong), F.lit(""))


def carriers_and_absent(items: DataFrame, pages: DataFrame, page: str, name: str, symbol: str, vocabulary: list[str], most: int = MOST_PEERS) -> DataFrame:
    """``(symbol, carriers, absent, missing)``: pages with and without each symbol of a vocabulary,
    and the first names of those without. A page's missing symbols are a difference of two small
    arrays; no task sends more than ``most`` names of a symbol, and counts are complements of the carriers'."""
    spark = items.sparkSession
    known = spark.createDataFrame([(v,) for v in vocabulary], f"`{symbol}` string")
    has = items.where(F.col(symbol).isin(*vocabulary)).groupBy(page).agg(F.collect_set(symbol).alias("__has"))
    each = pages.select(page, name).distinct().join(has, page, "left")
    lacking = each.select(page, name, F.explode(F.array_except(F.array(*map(F.lit, vocabulary)), F.coalesce("__has", F.array().cast("array<string>")))).alias(symbol))
    first = ordering.first_of(lacking, [symbol], name, [F.collate(F.col(name), COLLATION), F.col(page)], most)
    counted = each.select(F.explode("__has").alias(symbol)).groupBy(symbol).agg(F.count("*").alias("carriers"))
    joined = known.join(counted, symbol, "left").join(first, symbol, "left").crossJoin(F.broadcast(each.agg(F.count("*").alias("__pages"))))
    carriers = F.coalesce("carriers", F.lit(0))
    return joined.select(symbol, carriers.alias("carriers"), (F.col("__pages") - carriers).alias("absent"), F.coalesce(F.array_join("first", ", "), F.lit("")).alias("missing"))
