"""Folds over append-only logs: latest state, queue, changes, feed, health, schedule.

An order column (a sequence number) says which line is last; it need not be the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering

OK_STATUSES = ("ok", "unchanged")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; partial maxima are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.select(*keys, "last.*")


def queue(results: DataFrame, keys: list[str], order: str, at: str, status: str, version: str) -> DataFrame:
    """Per key: last attempt and status, last time ok, last known version, and failures since ok.

    The last time ok and the version stick: later failures and nulls leave them.
    """
    ok = F.col(status).isin(*OK_STATUSES)
    last_ok = F.max(F.when(ok, F.col(order)))
    folded = results.groupBy(*keys).agg(
        F.max_by(at, order).alias("last_attempted_at"),
        F.max_by(status, order).alias("last_status"),
        F.max_by(at, F.when(ok, F.col(order))).alias("last_ok_at"),
        F.max_by(version, F.when(F.col(version).isNotNull(), F.col(order))).alias("extractor_version"),
        last_ok.alias("__ok"),
    )
    failed = results.where(~ok).join(folded.select(*keys, "__ok"), keys).where(F.col("__ok").isNull() | (F.col(order) > F.col("__ok")))
    failures = failed.groupBy(*keys).agg(F.count("*").alias("consecutive_failures"))
    return folded.drop("__ok").join(failures, keys, "left").fillna(0, ["consecutive_failures"])


def changed_only(rows: DataFrame, keys: list[str], order: str, fingerprint: Column) -> DataFrame:
    """Rows whose fingerprint differs from the row before of the same key; first rows stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__f", F.xxhash64(fingerprint)).withColumn("__before", F.lag("__f").over(w))
    return marked.where(~F.col("__f").eqNullSafe(F.col("__before"))).drop("__f", "__before")


def null_streaks(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``streak``: how many rows up to this one, without a break, have no value (0 with one)."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__island", island)
    within = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(order))
    # the row that has the value begins its island, but for the one before any value
    streak = F.when(F.col(value).isNotNull(), 0).otherwise(within - F.when(F.col("__island") > 0, 1).otherwise(0))
    return marked.withColumn("streak", streak.cast("long")).drop("__island")


def value_changes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows with a value other than the last one before, as ``before`` and ``after``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("before", F.last(value, ignorenulls=True).over(w))
    return marked.where(F.col(value).isNotNull() & F.col("before").isNotNull() & (F.col(value) != F.col("before"))).withColumn("after", F.col(value))


def published(events: DataFrame, retractions: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(retractions.select(*keys).distinct(), keys, "left_anti").select(events.columns)


def retracted(events: DataFrame, retractions: DataFrame, keys: list[str], order: str, extra: list[str]) -> DataFrame:
    """Events that are retracted, with ``extra`` of the last retraction of each."""
    last = retractions.groupBy(*keys).agg(F.max_by(F.struct(*extra), F.col(order)).alias("why"))
    return events.join(last, keys).select(*(events[c] for c in events.columns), *(F.col(f"why.{c}") for c in extra))


def append_new(log: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key the log doesn't have, one a key: the first by ``order``, or
    without one the least by all columns."""
    rest = [c for c in incoming.columns if c not in keys]
    row = F.struct(*rest)
    first = incoming.groupBy(*keys).agg(F.min_by(row, F.struct(F.col(order), row) if order else row).alias("first")) if rest else incoming.distinct()
    new = first.join(log.select(*keys).distinct(), keys, "left_anti")
    return new.select(*keys, "first.*").select(incoming.columns) if rest else new


def confirmed(last_ok_at: Column, detected_at: Column) -> Column:
    """A change counts as confirmed once the page was read again after it."""
    return F.coalesce(last_ok_at > detected_at, F.lit(False))


def health(last_attempt: Column, last_ok: Column, status: Column, suspect: Column, shifted: Column, cutoff: Column) -> Column:
    """State of a company's reads; the first that applies."""
    return (
        F.when(last_attempt.isNull(), "pending")
        .when(status == "blocked", "blocked")
        .when(last_ok.isNull() | (last_ok < cutoff), "stale")
        .when(status == "changed-structure", "structure-changed")
        .when(status == "error", "error")
        .when((status == "origin-shift") | shifted, "origin-shift")
        .when(suspect > 0, "degraded")
        .otherwise("ok")
    )


def response_status(http: Column, length: Column, same_hash: Column) -> Column:
    return (
        F.when(http == 304, "unchanged")
        .when(http.isin(401, 403, 429, 451), "blocked")
        .when((http >= 400) | (http < 200) | (http >= 300), "error")
        .when(F.coalesce(length, F.lit(0)) == 0, "error")
        .when(same_hash, "unchanged")
        .otherwise("ok")
    )


def due_seconds(status: Column, failures: Column, retry_after: Column, crawl_delay: Column, seed: Column) -> Column:
    """Seconds to the next read. After a good one a day less half an hour, and up to an hour more
    by a hash of ``seed``, so that reads spread; blocked and failed ones back off by doubling."""
    day = 86_400
    n = F.least(F.greatest(failures, F.lit(1)), F.lit(40)) - 1
    doubled = F.pow(F.lit(2.0), n)
    blocked = F.when(retry_after > 0, F.greatest(retry_after, F.lit(3600)).cast("double")).otherwise(F.least(day * doubled, F.lit(30.0 * day)))
    failed = F.greatest(F.least(900 * doubled, F.lit(float(day))), F.lit(60.0), F.coalesce(crawl_delay, F.lit(0)).cast("double"))
    spread = F.pmod(F.xxhash64(seed), F.lit(3600)).cast("double")
    return F.when(status.isin(*OK_STATUSES), day - 1800 + spread).when(status == "blocked", blocked).otherwise(failed)


def due(targets: DataFrame, queue_: DataFrame, keys: list[str], now: Column, limit: int, order: str) -> DataFrame:
    """Targets due by ``now``, never read ones first, then the longest due."""
    joined = targets.join(queue_, keys, "left")
    return joined.where(F.col("next_due_at").isNull() | (F.col("next_due_at") <= now)).orderBy(F.col("next_due_at").asc_nulls_first(), order).limit(limit)


def interleaved(targets: DataFrame, host: str, order: str) -> DataFrame:
    """``turn`` and ``host_first``: sorted by these, hosts take turns in the order first seen."""
    w = Window.partitionBy(host)
    return targets.withColumn("turn", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("host_first", F.min(order).over(w))


def run_messages(results: DataFrame, movers: DataFrame, run: str, status: str, name: str, counted: tuple[str, ...], prefix: str = "") -> DataFrame:
    """``(run, message)``: a line on each run: its targets, the first three that moved and how many
    more, and how many had each of the counted statuses."""
    counts = results.groupBy(run).agg(F.count("*").alias("__n"), *(F.count(F.when(F.col(status) == s, 1)).alias(f"__{s}") for s in counted))
    moved = movers.groupBy(run).agg(F.count(name).alias("__m")).join(ordering.first_of(movers.where(F.col(name).isNotNull()), [run], name, [name], 3), run, "left")
    more = F.when(F.col("__m") > 3, F.concat(F.lit(" +"), (F.col("__m") - 3).cast("string"), F.lit(" more"))).otherwise("")
    listed = F.concat(F.array_join(F.transform("first", lambda x: F.concat(F.lit(prefix), x.cast("string"))), ", "), more)
    parts = [F.when(F.col(f"__{s}") > 0, F.concat(F.col(f"__{s}").cast("string"), F.lit(f" {s}"))) for s in counted]
    message = F.concat_ws("; ", F.concat(F.col("__n").cast("string"), F.lit(" targets")), listed, *parts)
    return counts.join(moved, run, "left").select(run, message.alias("message"))


def select_targets(targets: DataFrame, queue_: DataFrame, keys: list[str], mode: str, now: Column | None = None, limit: int | None = None, company: str | None = None, order: str = "slug") -> DataFrame:
    """Targets of a run: of ``batch`` those due by ``now``, the longest due first and ``limit`` of them;
    of ``company`` all pages of one, which must be known; of ``all`` every one."""
    if mode == "batch":
        if limit is None or limit < 0:
            raise ValueError("a batch needs a limit of 0 or more")
        return due(targets, queue_, keys, now, limit, order)
    if mode == "company":
        mine = targets.where(F.col("slug") == company)
        if mine.isEmpty():
            raise ValueError(f"no company {company!r}")
        return mine.join(queue_, keys, "left")
    if mode != "all":
        raise ValueError(f"no mode {mode!r}")
    return targets.join(queue_, keys, "left")


def skipped_unchanged(fetched: DataFrame, known: DataFrame, keys: list[str], content: str = "content_hash") -> DataFrame:
    """Fetches whose content differs from the last one known of the page; the others need no reading."""
    return fetched.join(known.select(*keys, F.col(content).alias("__known")), keys, "left").where(~F.col(content).eqNullSafe(F.col("__known"))).drop("__known")
