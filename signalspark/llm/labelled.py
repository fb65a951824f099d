"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ``ids(doc_id, ...)``: those with the smallest hash of doc_id.

    All rows are counted first, and a share of the hash range that holds about ``most`` of them
    is sorted, so that tasks send few rows each whatever the number of rows and tasks.
    """
    total = ids.count()
    hashed = ids.withColumn("__h", F.xxhash64("doc_id", F.lit(seed)))
    share = min(1.0, 1.5 * most / max(total, 1))
    return hashed.where(F.col("__h") <= F.lit(min(2**63 - 1, int((share - 0.5) * 2**64)))).orderBy("__h").limit(most).drop("__h")


def texts_of(docs: DataFrame, ids: DataFrame) -> list[str]:
    """Texts of the documents of a ``sample``, whose bound makes the broadcast and this list small."""
    return [r["text"] or "" for r in docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("text").collect()]
