"""Queries over ``events`` as a log of observations: user is the page, event_type its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import series
from ..registry import query, table

_OBS_SQL = """obs AS (
  SELECT event_id, user_id, event_type, ts, value, CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unchanged' ELSE 'ok' END AS status,
    CASE WHEN event_id % 3 = 0 THEN '1.' || (event_id % 5) END AS version,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 3 END AS seen FROM events
)"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, extractor version and a value with gaps are made up from event_id."""
    k = F.col("event_id")
    status = F.when(k % 7 == 0, "error").when(k % 7 == 1, "blocked").when(k % 7 == 2, "unchanged").otherwise("ok")
    version = F.when(k % 3 == 0, F.concat(F.lit("1."), (k % 5).cast("string")))
    seen = F.when(k % 4 != 0, F.floor("value").cast("long") % 3)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", status.alias("status"), version.alias("version"), seen.alias("seen"))


KEYS = ["user_id", "event_type"]


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return series.latest(events.select(*KEYS, "event_id", "value", "seq"), KEYS, "seq").drop("seq")


@query(
    f"""WITH {_OBS_SQL}, ok AS (SELECT user_id, event_type, max(event_id) AS k, arg_max(ts, event_id) AS at FROM obs WHERE status IN ('ok', 'unchanged') GROUP BY ALL)
SELECT o.user_id, o.event_type, arg_max(o.ts, o.event_id) AS last_attempted_at, arg_max(o.status, o.event_id) AS last_status, max(ok.at) AS last_ok_at,
  arg_max(o.version, o.event_id) FILTER (WHERE o.version IS NOT NULL) AS extractor_version,
  count(*) FILTER (WHERE o.status NOT IN ('ok', 'unchanged') AND (ok.k IS NULL OR o.event_id > ok.k)) AS consecutive_failures
FROM obs o LEFT JOIN ok ON o.user_id = ok.user_id AND o.event_type = ok.event_type GROUP BY ALL"""
)
def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.queue(_observations(spark, sf_dir), KEYS, "event_id", "ts", "status", "version")


@query(f"WITH {_OBS_SQL} SELECT event_id FROM (SELECT *, lag(event_id) OVER w AS p, lag(status) OVER w AS s, lag(seen) OVER w AS v FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)) WHERE p IS NULL OR s IS DISTINCT FROM status OR v IS DISTINCT FROM seen")
def dedupe_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    return series.changed_only(rows, KEYS, "event_id", F.to_json(F.struct("status", "seen"), {"ignoreNullFields": "false"})).select("event_id")


@query(
    f"""WITH {_OBS_SQL}, islands AS (SELECT *, count(seen) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM obs)
SELECT event_id, count(*) FILTER (WHERE seen IS NULL) OVER (PARTITION BY user_id, event_type, island ORDER BY event_id) * CASE WHEN seen IS NULL THEN 1 ELSE 0 END AS streak FROM islands"""
)
def null_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.null_streaks(_observations(spark, sf_dir), KEYS, "event_id", "seen").select("event_id", "streak")


@query(
    f"""WITH {_OBS_SQL}, before AS (
  SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM obs
) SELECT event_id, b AS before, seen AS after FROM before WHERE seen IS NOT NULL AND b IS NOT NULL AND b <> seen"""
)
def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.value_changes(_observations(spark, sf_dir), KEYS, "event_id", "seen").select("event_id", "before", "after")


def _retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh event of the first types is retracted, some twice."""
    marked = _observations(spark, sf_dir).where("event_id % 11 = 0").select("event_id", F.col("event_id").alias("seq"), F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("reason"))
    return marked.union(marked.where("event_id % 2 = 0").withColumn("seq", F.col("seq") + 1).withColumn("reason", F.lit("again")))


@query("SELECT event_id, ts FROM events WHERE event_id % 11 <> 0 ORDER BY ts DESC, event_id LIMIT 200")
def feed_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = series.published(table(spark, sf_dir, "events"), _retractions(spark, sf_dir), ["event_id"])
    return feed.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(200)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'again' ELSE 'r' || (event_id % 4) END AS reason FROM events WHERE event_id % 11 = 0")
def feed_retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.retracted(table(spark, sf_dir, "events").select("event_id"), _retractions(spark, sf_dir), ["event_id"], "seq", ["reason"])


@query(
    f"""WITH {_OBS_SQL}, ok AS (SELECT user_id, event_type, arg_max(ts, event_id) AS ok_at FROM obs WHERE status IN ('ok', 'unchanged') GROUP BY ALL)
SELECT event_id, coalesce(ok_at > ts, false) AS confirmed FROM obs LEFT JOIN ok ON obs.user_id = ok.user_id AND obs.event_type = ok.event_type"""
)
def feed_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    queue = series.queue(rows, KEYS, "event_id", "ts", "status", "version")
    return rows.join(queue, KEYS, "left").select("event_id", series.confirmed(F.col("last_ok_at"), F.col("ts")).alias("confirmed"))


@query(
    f"""WITH {_OBS_SQL}, q AS (
  SELECT user_id, max(ts) AS attempt, arg_max(status, event_id) AS status, max(ts) FILTER (WHERE status IN ('ok', 'unchanged')) AS ok_at, count(*) FILTER (WHERE seen IS NULL) AS suspect FROM obs GROUP BY user_id
), bound AS (SELECT max(ts) - INTERVAL 48 HOUR AS cutoff FROM obs)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN status = 'blocked' THEN 'blocked' WHEN ok_at IS NULL OR ok_at < cutoff THEN 'stale' WHEN status = 'error' THEN 'error' WHEN suspect > 0 THEN 'degraded' ELSE 'ok' END AS state FROM q, bound) GROUP BY state"""
)
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    ok = F.col("status").isin(*series.OK_STATUSES)
    folded = rows.groupBy("user_id").agg(
        F.max("ts").alias("attempt"), F.max_by("status", "event_id").alias("last_status"), F.max(F.when(ok, F.col("ts"))).alias("ok_at"), F.count(F.when(F.col("seen").isNull(), 1)).alias("suspect")
    )
    bound = rows.agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("cutoff"))
    state = series.health(F.col("attempt"), F.col("ok_at"), F.col("last_status"), F.col("suspect"), F.lit(False), F.col("cutoff"))
    return folded.crossJoin(F.broadcast(bound)).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_OBS_SQL}, bound AS (SELECT max(ts) AS now FROM obs)
SELECT count(*) AS observations, count(DISTINCT user_id) AS companies, count(*) FILTER (WHERE ts > now - INTERVAL 24 HOUR) AS fetches_24h,
  count(*) FILTER (WHERE ts > now - INTERVAL 24 HOUR AND status = 'blocked') AS blocked_24h, count(*) FILTER (WHERE ts > now - INTERVAL 7 DAY) AS seen_7d, count(*) FILTER (WHERE ts > now - INTERVAL 30 DAY) AS seen_30d,
  min(ts) AS first_at, max(ts) AS last_at FROM obs, bound"""
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    since = lambda hours: F.col("ts") > F.col("now") - F.expr(f"INTERVAL {hours} HOURS")
    n = lambda c: F.count(F.when(c, 1))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now")))).agg(
        F.count("*").alias("observations"),
        F.countDistinct("user_id").alias("companies"),
        n(since(24)).alias("fetches_24h"),
        n(since(24) & (F.col("status") == "blocked")).alias("blocked_24h"),
        n(since(168)).alias("seen_7d"),
        n(since(720)).alias("seen_30d"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
    )


@query(
    f"""WITH {_OBS_SQL}, q AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN max(ts) END AS next_due_at FROM obs GROUP BY user_id), bound AS (SELECT max(ts) - INTERVAL 6 HOUR AS now FROM obs)
SELECT user_id, next_due_at FROM q, bound WHERE next_due_at IS NULL OR next_due_at <= now ORDER BY next_due_at NULLS FIRST, user_id LIMIT 40"""
)
def due_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page was never read; the limit is the batch."""
    rows = table(spark, sf_dir, "events")
    targets = rows.select("user_id").distinct()
    queue = rows.where("user_id % 5 <> 0").groupBy("user_id").agg(F.max("ts").alias("next_due_at"))
    now = rows.agg((F.max("ts") - F.expr("INTERVAL 6 HOURS")).alias("__now"))
    return series.due(targets.crossJoin(F.broadcast(now)), queue, ["user_id"], F.col("__now"), 40, "user_id").drop("__now")


@query(
    """WITH a AS (SELECT l_orderkey, list(DISTINCT l_shipmode_) AS s FROM (SELECT l_orderkey, 'P' || (l_partkey % 9) AS l_shipmode_ FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1),
b AS (SELECT l_orderkey, list(DISTINCT x) AS s FROM (SELECT l_orderkey, 'p' || (l_partkey % 9) AS x FROM lineitem WHERE l_linenumber >= 2) GROUP BY 1)
SELECT a.l_orderkey, len(list_filter(b.s, lambda x: NOT list_contains(list_transform(a.s, lambda y: lower(y)), x))) AS n_added, len(list_filter(a.s, lambda x: NOT list_contains(b.s, lower(x)))) AS n_removed,
  round(1 - len(list_intersect(list_transform(a.s, lambda y: lower(y)), b.s)) / greatest(1, len(list_distinct(list_concat(list_transform(a.s, lambda y: lower(y)), b.s)))), 3) AS magnitude
FROM a JOIN b ON a.l_orderkey = b.l_orderkey"""
)
def list_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    of = lambda rows, letter: rows.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit(letter), (F.col("l_partkey") % 9).cast("string"))).alias(letter + "_items"))
    both = of(lines.where("l_linenumber <= 3"), "P").join(of(lines.where("l_linenumber >= 2").withColumn("l_partkey", F.col("l_partkey")), "p").withColumnRenamed("p_items", "after_items"), "l_orderkey")
    delta = T.list_delta(F.col("P_items"), F.col("after_items"))
    return both.select("l_orderkey", delta.alias("d")).select("l_orderkey", F.size("d.added").cast("long").alias("n_added"), F.size("d.removed").cast("long").alias("n_removed"), F.round("d.magnitude", 3).alias("magnitude"))


@query("SELECT n_nationkey, printf('%08x', list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(n_name, ''), lambda c: ord(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS hash FROM nation")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.fnv1a(F.col("n_name")).alias("hash"))
