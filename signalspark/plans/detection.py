"""Queries that run the extraction and the change detector, and aggregates over what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.extract import extraction_column
from ..operators import insights, positioning, readmodels
from ..operators.comparison import signal_status
from ..operators.detect import detect
from ..registry import query, table
from .pages import _STOP_SQL, _STRIP_SQL, _TITLE


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores where a small file would leave them to fewer tasks; a large table
    has more splits than that and is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def extracted_pages(spark: SparkSession, sf_dir: str, kind: str = "home") -> DataFrame:
    """``(page_id, url, variant, lang, signals)`` of every page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    done = pages.select("page_id", "url", extraction_column(F.col("html"), kind, url=F.col("url")).alias("e"))
    return done.select("page_id", "url", "e.variant", "e.lang", "e.signals")


@query()
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each signal of each page, null where it can't be read."""
    done = extracted_pages(spark, sf_dir)
    return done.select("page_id", "variant", "lang", F.explode("signals").alias("signal", "v")).select("page_id", "variant", "lang", "signal", "v.value", "v.hash", "v.method", "v.confidence")


@query()
def pricing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the pages as price pages."""
    done = extracted_pages(spark, sf_dir, "pricing")
    return done.select("page_id", F.explode("signals").alias("signal", "v")).select("page_id", "signal", "v.value", "v.method")


_CLIPPED = "CASE WHEN length({t}) <= 300 THEN {t} ELSE left({t}, 299) || '…' END"


@query(f"WITH {_STRIP_SQL}, t AS (SELECT page_id, nullif({_TITLE}, '') AS title FROM stripped) SELECT page_id, {_CLIPPED.format(t='title')} AS title FROM t")
def extracted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_pages(spark, sf_dir).select("page_id", readmodels.signal_value(F.col("signals"), "meta_title").alias("title"))


@query(
    f"""WITH {_STRIP_SQL}, t AS (SELECT page_id, nullif({_TITLE}, '') AS title FROM stripped), votes AS (
  SELECT DISTINCT page_id, unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]'))) AS word FROM t
), n AS (SELECT word, count(*) AS n FROM votes WHERE word NOT IN ({_STOP_SQL}) GROUP BY word) SELECT word, n, (SELECT count(*) FROM n) AS distinct_words FROM n ORDER BY n DESC, word LIMIT 12"""
)
def extracted_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to signals to counted words."""
    titles = extracted_pages(spark, sf_dir).select(readmodels.signal_value(F.col("signals"), "meta_title").alias("title"))
    return insights.headline_words(titles, "title")


@query(f"WITH {_STRIP_SQL} SELECT page_id, 'html' AS variant, nullif(lower(regexp_extract(h, '(?is)<html[^>]*lang=.([a-zA-Z]+)', 1)), '') AS lang FROM stripped")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_pages(spark, sf_dir).select("page_id", "variant", "lang")


@query()
def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each signal can be read on, and in words how common that is."""
    rows = page_signals(spark, sf_dir)
    counted = positioning.coverage(rows, F.col("value"), "signal")
    return counted.withColumn("text", formats.share_text(F.col("readable"), F.col("tracked")))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as readings of a page a user: the value's whole part is the headline, missing on
    every fourth read; the type is the second line."""
    k = F.col("event_id")
    read = lambda value, missing: F.when(~missing, F.struct(value.alias("value"), F.lit("h1").alias("method"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("json")))
    signals = F.struct(read(F.concat(F.lit("Plan "), F.floor(F.col("value") / 50).cast("string")), k % 4 == 0).alias("headline"), read(F.col("event_type"), F.lit(False)).alias("subhead"), read(F.lit("title"), F.lit(False)).alias("meta_title"))
    page = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit(True).alias("fetch_ok"), F.lit(True).alias("extractable"), F.lit("html").alias("variant"), F.lit("1").alias("extractor_version"), signals.alias("signals"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("slug"), F.lit("home").alias("kind"), k.alias("seq"), F.to_json(page, {"ignoreNullFields": "false"}).alias("observation"))


@query()
def detected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_observed(spark, sf_dir))


_LAST_SQL = "last AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"


@query(
    f"""WITH {_LAST_SQL} SELECT user_id::VARCHAR AS slug, event_id AS seq, 'modified' AS change_type, before AS before_value, event_type AS after_value,
  floor(levenshtein(before, event_type) / greatest(length(before), length(event_type)) * 1000 + 0.5) / 1000 AS magnitude, 'subhead changed from "' || before || '" to "' || event_type || '"' AS summary FROM last WHERE before <> event_type"""
)
def subhead_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the signal that can always be read: each change from the value before."""
    found = detect(_observed(spark, sf_dir)).where("signal = 'subhead' AND change_type IS NOT NULL")
    plain = F.regexp_replace("summary", ", a value that it had before$", "")
    return found.select("slug", "seq", "change_type", "before_value", "after_value", "magnitude", plain.alias("summary"))


@query(
    f"""WITH {_LAST_SQL} SELECT CASE WHEN before IS NULL THEN 'baseline' WHEN before = event_type THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS n FROM last GROUP BY 1"""
)
def subhead_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_observed(spark, sf_dir)).where("signal = 'subhead'").groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def extracted_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the worst status of the signals that could be read."""
    rows = page_signals(spark, sf_dir)
    weak = (F.col("confidence") < 0.5).cast("int")
    return insights.tally(rows.select("page_id", signal_status(F.col("value"), F.lit(0), weak).alias("status")), "page_id", F.col("status"))
