"""The change detector as a stream: the batch fold's step with a page's state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import OUTCOME_SCHEMA, outcome_rows
from .commitlog import CommitLog

_COLUMNS = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]


def detect_stream(observations: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``(slug, kind, seq, observation)``; rows of a micro-batch are taken
    in the order of ``seq``, later batches after earlier ones, whatever their ``seq``."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page = json.loads(state.get[0]) if state.exists else None
        frames = list(batches)
        if frames:
            rows, page = outcome_rows(tuple(key), pd.concat(frames).sort_values("seq").to_dict("records"), page)
            state.update((json.dumps(page),))
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return observations.select("slug", "kind", "seq", "observation").groupBy("slug", "kind").applyInPandasWithState(fold, OUTCOME_SCHEMA, "page string", "append", GroupStateTimeout.NoTimeout)


def append_once(incoming: DataFrame, log_path: str, keys: list[str], order: str | None = None, writer: str | None = None, batch: str | int | None = None) -> int:
    """Append the rows whose key the log doesn't have, one a key (the first by ``order``); how many.
    For ``foreachBatch``, with the query's name and the batch's number: several writers, each batch once."""
    return CommitLog(incoming.sparkSession, log_path).append(incoming, keys, order, writer, batch)


def read_log(spark: SparkSession, log_path: str) -> DataFrame | None:
    """All rows of a log; null where there are none yet."""
    return CommitLog(spark, log_path).read()


def write_batch(rows: DataFrame, log_path: str) -> int:
    """Append rows to a log, whatever it has; how many."""
    return CommitLog(rows.sparkSession, log_path).append(rows)
