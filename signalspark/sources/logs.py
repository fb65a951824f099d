"""Append-only logs as lines of JSON: observations, events with retractions, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "struct<environment:string,country:string,region:string,method:string,id:string>"
SIGNAL = "struct<value:string,hash:string,method:string,confidence:double,json:string>"
OBSERVATION = f"observed_at string, slug string, kind string, url string, status string, reason string, http_status int, bytes long, signals_found int, signals_expected int, origin {ORIGIN}, doc struct<lang:string,canonical:string,variant:string,extractorVersion:string>, signals map<string,{SIGNAL}>"
EVENT = "record string, detected_at string, slug string, name string, segment string, kind string, origin string, signal string, change_type string, before_value string, after_value string, before_json string, after_json string, previous_seen_at string, magnitude double, oscillating int, summary string, retracted_at string, reason string, correction string"
RESULT = "slug:string,kind:string,url:string,at:string,status:string,reason:string,origin:string,http:int,bytes:long,duration_ms:long,yield:string,events:int,etag:string,last_modified:string,content_hash:string,extractor_version:string,failures:int,next_due_at:string"
RUN = f"run string, trigger string, mode string, started_at string, finished_at string, targets int, results array<struct<{RESULT}>>"
EVENT_KEY = ["slug", "signal", "detected_at"]


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's whole lines; a broken one, as a write cut short leaves at the end, is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def split_events(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and retractions of an event log."""
    is_retraction = F.coalesce(F.col("record") == "retraction", F.lit(False))
    return log.where(~is_retraction), log.where(is_retraction)


def results(runs: DataFrame) -> DataFrame:
    """A row for each target of each run, with the fetched share of ``yield`` as numbers."""
    part = lambda k: F.coalesce(F.expr(f"try_cast(get(split(r.yield, '/'), {k}) AS int)"), F.lit(0))
    return runs.select("run", F.posexplode("results").alias("place", "r")).select("run", "place", "r.*", part(0).alias("found"), part(1).alias("expected"))


def retraction(log: DataFrame, slug: str, signal: str, detected_at: str, reason: str, at: str) -> DataFrame | None:
    """The row that retracts an event; null if it is retracted already. A missing event or an
    empty reason is an error."""
    if not reason.strip():
        raise ValueError("a retraction needs a reason")
    mine = log.where((F.col("slug") == slug) & (F.col("signal") == signal) & (F.col("detected_at") == detected_at))
    events, retractions = split_events(mine)
    if events.isEmpty():
        raise ValueError(f"no event {slug} {signal} {detected_at}")
    if not retractions.isEmpty():
        return None
    row = events.limit(1).withColumns({"record": F.lit("retraction"), "retracted_at": F.lit(at), "reason": F.lit(reason)})
    return row.select(log.columns)
