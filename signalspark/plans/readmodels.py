"""Queries of the read models: customers are companies, events their observations and fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insights, readmodels, series
from ..registry import ORACLES, query, table
from .insights import _FIELDS, _FIELDS_SQL, _HITS_SQL, _PLANS_SQL, _TERMS_SQL, fields_of, plans_of
from .series import KEYS, _OBS_SQL, _observations, _retractions

_CUSTOMERS_SQL = "companies AS (SELECT c_custkey AS slug, c_name AS name, c_mktsegment AS segment FROM customer)"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation's signals: its type's reading, null on every fourth, and its count."""
    k = F.col("event_id")
    value = F.when(k % 4 > 0, F.struct(F.col("value").cast("decimal(12,2)").cast("string").alias("value"), F.lit(None).cast("string").alias("json")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), "event_id", F.create_map(F.col("event_type"), value).alias("signals"))


@query(
    f"""WITH {_CUSTOMERS_SQL}, last AS (SELECT user_id AS slug, event_type, max(event_id) AS id FROM events GROUP BY ALL),
v AS (SELECT l.slug, l.event_type, CASE WHEN id % 4 > 0 THEN value::DECIMAL(12,2)::VARCHAR END AS value FROM last l JOIN events e ON e.event_id = id),
s AS (SELECT slug, count(*) AS signals, count(value) AS readable, max(value) FILTER (WHERE event_type = 'click') AS click FROM v GROUP BY slug)
SELECT c.slug, name, segment, coalesce(signals, 0) AS signals, coalesce(readable, 0) AS readable, click, click::DOUBLE AS click_number FROM companies c LEFT JOIN s ON c.slug = s.slug"""
)
def latest_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = readmodels.latest_signals(_signals(spark, sf_dir), "slug", "event_id")
    joined = readmodels.latest_by_company(_companies(spark, sf_dir), latest, "slug", "name")
    click = readmodels.signal_value(F.col("signals"), "click")
    values = F.filter(F.map_values("signals"), lambda v: v["value"].isNotNull())
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    return joined.select("slug", "name", "segment", size(F.col("signals")).alias("signals"), size(values).alias("readable"), click.alias("click"), readmodels.number_of(click).alias("click_number"))


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 11 <> 0 ORDER BY ts DESC, user_id, event_id LIMIT 200")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    retracted = _retractions(spark, sf_dir).join(events.select("event_id", "user_id"), "event_id")
    return readmodels.recent_changes(events, retracted, ["user_id", "event_id"], "ts").select("event_id", "user_id", "event_type", "ts")


@query("SELECT event_id, user_id, ts FROM (SELECT * FROM events WHERE event_type = 'click' AND user_id % 3 = 1 ORDER BY ts DESC, event_id LIMIT 80)")
def filtered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("signal"), (F.col("user_id") % 3).cast("string").alias("segment")).orderBy(F.desc("ts"), "event_id")
    return readmodels.filtered_feed(events, signal="click", segment="1").select("event_id", "user_id", "ts")


@query(
    f"""WITH {_OBS_SQL}, ok AS (SELECT user_id, arg_max(ts, event_id) AS last_ok_at FROM obs WHERE status IN ('ok', 'unchanged') GROUP BY user_id),
r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events)
SELECT r.user_id, event_id, place, coalesce(last_ok_at > ts, false) AS confirmed FROM r LEFT JOIN ok ON r.user_id = ok.user_id WHERE place <= 5"""
)
def company_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = series.queue(_observations(spark, sf_dir), ["user_id"], "event_id", "ts", "status", "version")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return readmodels.company_events(events, queue, "user_id", ["event_id"], "ts", 5).drop("ts")


@query(f"WITH {_OBS_SQL} SELECT user_id, event_id, status, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM obs) WHERE place <= 20")
def company_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.company_fetches(_observations(spark, sf_dir).select("user_id", "event_id", "status"), "user_id", "event_id")


_QUEUE_SQL = f"""{_OBS_SQL}, q AS (SELECT user_id AS slug, event_type, max(ts) AS attempt, arg_max(status, event_id) AS status, arg_max(ts, event_id) FILTER (WHERE status IN ('ok', 'unchanged')) AS ok_at FROM obs GROUP BY ALL),
p AS (SELECT slug, max(attempt) AS attempt, max(ok_at) AS ok_at, max(status) FILTER (WHERE event_type = 'view') AS status FROM q GROUP BY slug),
s AS (SELECT user_id AS slug, count(*) AS suspect FROM obs WHERE seen IS NULL AND event_id % 8 = 0 GROUP BY user_id), c AS (SELECT user_id AS slug, count(*) AS changes FROM events WHERE event_type = 'purchase' GROUP BY user_id)"""


@query(
    f"""WITH {_CUSTOMERS_SQL}, {_QUEUE_SQL}, bound AS (SELECT max(ts) - INTERVAL 48 HOUR AS cutoff FROM obs)
SELECT m.slug, coalesce(suspect, 0) AS suspect, coalesce(changes, 0) AS changes, CASE WHEN p.attempt IS NULL THEN 'pending' WHEN p.status = 'blocked' THEN 'blocked' WHEN p.ok_at IS NULL OR p.ok_at < cutoff THEN 'stale'
  WHEN p.status = 'error' THEN 'error' WHEN coalesce(suspect, 0) > 0 THEN 'degraded' ELSE 'ok' END AS state
FROM companies m LEFT JOIN p ON m.slug = p.slug LEFT JOIN s ON m.slug = s.slug LEFT JOIN c ON m.slug = c.slug, bound"""
)
def company_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("slug", "suspect", "changes", "state")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    queue = series.queue(rows, KEYS, "event_id", "ts", "status", "version").withColumns({"slug": F.col("user_id"), "kind": F.when(F.col("event_type") == "view", "home").otherwise("other")})
    suspects = rows.where("seen IS NULL AND event_id % 8 = 0").groupBy(F.col("user_id").alias("slug")).agg(F.count("*").alias("suspect"))
    changes = rows.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("slug")).agg(F.count("*").alias("changes"))
    bound = rows.agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("cutoff"))
    companies = _companies(spark, sf_dir).crossJoin(F.broadcast(bound))
    return readmodels.company_health(companies, queue, suspects, changes, "slug", F.col("cutoff"))


@query(
    f"""WITH places(state, place) AS (VALUES ('blocked', 1), ('stale', 2), ('structure-changed', 3), ('error', 4), ('origin-shift', 5), ('degraded', 6), ('pending', 7), ('ok', 8))
SELECT h.slug, h.state, p.place FROM ({ORACLES["company_health"]}) h LEFT JOIN places p ON h.state = p.state"""
)
def health_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's place among the worst first."""
    return _health(spark, sf_dir).select("slug", "state", readmodels.health_order(F.col("state")).cast("int").alias("place"))


@query(
    f"""WITH {_OBS_SQL}, b AS (SELECT max(ts) AS now FROM obs)
SELECT count(*) AS observations, count(DISTINCT user_id) AS companies, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (WHERE event_id % 8 = 0) AS suspect,
  count(*) FILTER (WHERE ts > now - INTERVAL 1 DAY) AS fetches_24h, count(*) FILTER (WHERE ts > now - INTERVAL 1 DAY AND status = 'blocked') AS blocked_24h, count(*) FILTER (WHERE ts > now - INTERVAL 1 DAY AND status = 'error') AS errors_24h,
  count(*) FILTER (WHERE event_type = 'purchase') AS changes, count(*) FILTER (WHERE event_type = 'purchase' AND ts > now - INTERVAL 7 DAY) AS changes_7d, count(*) FILTER (WHERE event_type = 'purchase' AND ts > now - INTERVAL 30 DAY) AS changes_30d
FROM obs, b"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumns({"at": F.col("ts"), "suspect": (F.col("event_id") % 8 == 0).cast("int")})
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))
    dated = rows.crossJoin(now)
    return readmodels.index_stats(dated, dated, dated.where("event_type = 'purchase'"), "user_id", F.col("now"))


@query(
    f"""WITH {_CUSTOMERS_SQL}, {_FIELDS_SQL}, {_TERMS_SQL}, {_PLANS_SQL}, said AS (SELECT *, {_HITS_SQL} FROM fields),
a AS (SELECT slug, CASE WHEN coalesce(headline, subhead, label) IS NOT NULL THEN headline_hit OR subhead_hit OR label_hit END AS ai FROM said WHERE slug % 7 > 0)
SELECT m.slug, m.segment, a.ai::VARCHAR AS ai, p.free::VARCHAR AS free FROM companies m LEFT JOIN a ON m.slug = a.slug LEFT JOIN company p ON m.slug = p.slug"""
)
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai = fields_of(spark, sf_dir).where("slug % 7 > 0").select("slug", insights.mentions(_FIELDS).alias("ai"))
    found = readmodels.facts(_companies(spark, sf_dir).drop("name"), ai, plans_of(spark, sf_dir).select("slug", "free"), "slug")
    return found.withColumns({c: F.col(c).cast("string") for c in ("ai", "free")})


@query(
    """WITH r AS (SELECT c_mktsegment AS segment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS k FROM customer)
SELECT segment, count(*) AS n, least(count(*), 8) AS shown, greatest(count(*) - 8, 0) AS omitted, string_agg(c_name, ', ' ORDER BY k) FILTER (WHERE k <= 8) AS names,
  CASE WHEN count(*) > 8 THEN 'and ' || (count(*) - 8) || ' more' END AS note FROM r GROUP BY segment"""
)
def peer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.peer_blocks(_companies(spark, sf_dir), "segment", "name")


@query(
    f"""WITH {_OBS_SQL}, st AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 5 > 0 THEN ts - INTERVAL 10 DAY END AS good FROM events WHERE event_id % 20 = 0)
SELECT st.event_id, CASE WHEN good IS NOT NULL THEN greatest(good, max(o.ts)) END AS good FROM st LEFT JOIN obs o ON o.user_id = st.user_id AND o.event_type = st.event_type AND o.ts <= st.ts AND o.status IN ('ok', 'unchanged') GROUP BY st.event_id, good"""
)
def carried_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    states = rows.where("event_id % 20 = 0").select("event_id", *KEYS, "ts", F.when(F.col("event_id") % 5 > 0, F.col("ts") - F.expr("INTERVAL 10 DAYS")).alias("good"))
    results = rows.select(*KEYS, F.col("ts").alias("at"), "status")
    return readmodels.carried_good(states, results, KEYS, "good", "ts").select("event_id", "good")


@query(
    f"""WITH {_OBS_SQL}, b AS (SELECT user_id, max(ts) FILTER (WHERE status IN ('ok', 'unchanged')) AS last_ok_at, count(*) FILTER (WHERE event_id % 8 = 0) AS suspect, count(*) FILTER (WHERE status = 'blocked') AS blocked,
  count(*) FILTER (WHERE status = 'error' AND event_id % 3 = 0) AS errors FROM obs GROUP BY user_id), n AS (SELECT max(ts) AS now FROM obs), h AS (SELECT *, floor((floor(epoch(now)) - floor(epoch(last_ok_at))) / 3600)::BIGINT AS age FROM b, n)
SELECT user_id, nullif(concat_ws('; ', CASE WHEN last_ok_at IS NULL THEN 'nothing has been read yet' WHEN age > 36 THEN 'last read ' || age || ' hours ago' END,
  CASE WHEN suspect > 0 THEN suspect || ' suspect' END, CASE WHEN blocked > 0 THEN blocked || ' blocked' END, CASE WHEN errors > 0 THEN errors || ' errors' END), '') AS banner FROM h"""
)
def staleness_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    n = lambda c: F.count(F.when(c, 1))
    k, status = F.col("event_id"), F.col("status")
    stats = rows.groupBy("user_id").agg(F.max(F.when(status.isin(*series.OK_STATUSES), F.col("ts"))).alias("last_ok_at"), n(k % 8 == 0).alias("suspect"), n(status == "blocked").alias("blocked"), n((status == "error") & (k % 3 == 0)).alias("errors"))
    dated = stats.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))
    banner = readmodels.staleness(F.col("last_ok_at"), F.col("now"), {c: F.col(c) for c in ("suspect", "blocked", "errors")})
    return dated.select("user_id", banner.alias("banner"))


@query(
    """WITH types(role) AS (VALUES ('system'), ('user'), ('assistant'), ('tool')), p AS (SELECT DISTINCT conv_id FROM conversations), has AS (SELECT DISTINCT conv_id, role FROM conversations),
l AS (SELECT t.role, p.conv_id, row_number() OVER (PARTITION BY t.role ORDER BY printf('c%08d', p.conv_id)) AS k FROM types t, p WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.conv_id = p.conv_id AND h.role = t.role))
SELECT t.role, (SELECT count(*) FROM has h WHERE h.role = t.role) AS carriers, (SELECT count(*) FROM l WHERE l.role = t.role) AS absent,
  coalesce((SELECT string_agg(printf('c%08d', conv_id), ', ' ORDER BY k) FROM l WHERE l.role = t.role AND k <= 8), '') AS missing FROM types t"""
)
def carriers_and_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role")
    pages = rows.select("conv_id").distinct().withColumn("name", F.format_string("c%08d", "conv_id"))
    return readmodels.carriers_and_absent(rows, pages, "conv_id", "name", "role", ["system", "user", "assistant", "tool"])
