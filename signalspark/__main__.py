"""Commands: ``extract`` pages to signals, ``build`` the published documents, ``retract`` an event."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.extract import extraction_column
from .operators import readmodels, series
from .sources import logs, seeds
from .streaming.detect import read_log, write_batch


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="signalspark", description=__doc__)
    todo = parser.add_subparsers(dest="command", required=True)
    extract = todo.add_parser("extract", help="signals of a Parquet table of pages")
    extract.add_argument("--pages", required=True)
    extract.add_argument("--out", required=True)
    extract.add_argument("--kind", choices=("home", "pricing"), default="home")
    extract.add_argument("--limit", type=int)
    build = todo.add_parser("build", help="JSON documents from logs and a seed")
    build.add_argument("--seed", required=True)
    build.add_argument("--events", required=True)
    build.add_argument("--runs", required=True)
    build.add_argument("--out", required=True)
    retract = todo.add_parser("retract", help="withdraw a published event")
    for name in ("--events", "--slug", "--signal", "--detected-at", "--reason", "--at"):
        retract.add_argument(name, required=True)
    retract.add_argument("--dry-run", action="store_true")
    return parser.parse_args(given)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = spark.read.parquet(a.pages)
    pages = pages if a.limit is None else pages.limit(a.limit)
    pages.select("page_id", extraction_column(F.col("html"), a.kind, url=F.col("url")).alias("e")).select("page_id", "e.*").write.mode("overwrite").parquet(a.out)


def build(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Companies, changes, retractions and fetches as documents."""
    companies = seeds.read_seed(spark, a.seed)
    events, retractions = logs.split_events(logs.read_lines(spark, a.events, logs.EVENT))
    results = logs.results(logs.read_lines(spark, a.runs, logs.RUN))
    changes = readmodels.recent_changes(events, retractions, logs.EVENT_KEY, "detected_at", 500)
    withdrawn = series.retracted(events.select(*logs.EVENT_KEY, "summary"), retractions.withColumn("seq", F.col("retracted_at")), logs.EVENT_KEY, "seq", ["reason", "correction"])
    fetches = readmodels.company_fetches(results.select("run", "slug", "kind", "at", "status", "http", "found", "expected"), "slug", "at")
    return sinks.write_documents(spark, a.out, {"companies": (companies, ["slug"]), "changes": (changes, ["detected_at", "slug", "signal"]), "retractions": (withdrawn, logs.EVENT_KEY), "fetches": (fetches, ["slug", "place"])})


def retract(spark: SparkSession, a: argparse.Namespace) -> int:
    log = read_log(spark, a.events)
    if log is None:
        raise SystemExit(f"no events at {a.events}")
    row = logs.retraction(log, a.slug, a.signal, a.detected_at, a.reason, a.at)
    return 0 if row is None or a.dry_run else write_batch(row, a.events)


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    spark = SparkSession.builder.appName("signalspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"extract": extract, "build": build, "retract": retract}[a.command](spark, a)


if __name__ == "__main__":
    main()
