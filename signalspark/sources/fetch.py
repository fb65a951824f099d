"""Pages over HTTP as a table: one polite request a target, conditional, capped and never failing.

A task takes a host's targets one after another, so a host is never asked twice at a time.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fetching import MOST_BODY
from ..operators.series import response_status

AGENT = "signalspark/1"
FETCHED = "url string, http int, body string, bytes long, truncated boolean, etag string, last_modified string, retry_after string, content_type string, duration_ms long, error string"
_COLUMNS = [c.split()[0] for c in FETCHED.split(", ")]


def get(url: str, etag: str | None = None, last_modified: str | None = None, most: int = MOST_BODY, timeout: float = 12.0) -> tuple:
    """One conditional GET: status, at most ``most`` bytes of the body, and headers; an error in words."""
    headers = {"User-Agent": AGENT} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    began = time.monotonic()
    try:
        try:
            answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            raw = answer.read(most + 1) if answer.status not in (204, 304) else b""
            h = answer.headers
            body = raw[:most].decode(h.get_content_charset() or "utf-8", "replace")
            took = int((time.monotonic() - began) * 1000)
            return (url, answer.status, body, min(len(raw), most), len(raw) > most, h.get("ETag"), h.get("Last-Modified"), h.get("Retry-After"), h.get("Content-Type"), took, None)
    except (OSError, ValueError, LookupError) as e:
        return (url, None, None, 0, False, None, None, None, None, int((time.monotonic() - began) * 1000), f"{type(e).__name__}: {e}")


def fetched(targets: DataFrame, delay: float = 60.0, most: int = MOST_BODY, timeout: float = 12.0) -> DataFrame:
    """What each of ``targets(host, url, etag, last_modified)`` answers, with ``status``: ok, unchanged,
    blocked or error. Hosts are dealt to tasks; of one host a task waits ``delay`` seconds between
    requests. A refused, broken or slow answer is a row with an error, never a failed task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in batches:
            rows = []
            for host, url, etag, modified in frame[["host", "url", "etag", "last_modified"]].itertuples(index=False):
                time.sleep(max(0.0, last.get(host, -1e9) + delay - time.monotonic()))
                rows.append(get(url, etag, modified, most, timeout))
                last[host] = time.monotonic()
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    dealt = targets.select("host", "url", "etag", "last_modified").repartition("host").sortWithinPartitions("host", "url")
    answers = dealt.mapInPandas(work, FETCHED)
    status = F.when(F.col("http").isNull(), "error").otherwise(response_status(F.col("http"), F.length("body"), F.lit(False)))
    return answers.withColumn("status", status)


def robots_cache(known: DataFrame, loaded: DataFrame, now, hours: int = 24) -> DataFrame:
    """``(host, body, rule, loaded_at)``: what is known of each host's robots.txt and not too old, else
    what was loaded now, capped; a host whose file couldn't be loaded is denied."""
    from ..functions.fetching import MOST_ROBOTS, fresh_until
    from .robots import status_rule

    fresh = known.where(fresh_until(F.col("loaded_at"), hours) > now)
    rule = F.when(F.col("http").isNull(), "deny").otherwise(status_rule(F.col("http")))
    new = loaded.select("host", F.substring("body", 1, MOST_ROBOTS).alias("body"), rule.alias("rule"), now.alias("loaded_at"))
    return fresh.select("host", "body", "rule", "loaded_at").unionByName(new.join(fresh.select("host"), "host", "left_anti"))
