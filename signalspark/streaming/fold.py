"""The detector over an append-only log: a snapshot of the pages' states, and what came after it.

A run reads the observations that were appended since the last one, and the states of the pages
that these are of; it appends outcomes, and a state for each of these pages. So it reads and writes
as much as is new. States are a log too: the last row of a page holds, until ``compact`` leaves only that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import OUTCOME_SCHEMA, outcome_rows
from .commitlog import CommitLog

PAGE = ["slug", "kind"]
OUTCOME_KEY = [*PAGE, "seq", "signal"]
_COLUMNS = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]


def fold(observations: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Outcomes of ``observations(slug, kind, seq, observation)`` as ``detect`` gives them, going on from
    ``states(slug, kind, page)``; and, with a ``page`` and no outcome, the state that each page with an observation is left in.

    A page's state comes before its observations in one sorted run, so a task holds one page's state at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, page, moved = None, None, False
        ended = lambda: [(*key, None, None, None, None, None, None, None, None, None, None, None, json.dumps(page))] if moved else []
        for frame in batches:
            out: list[tuple] = []
            for slug, kind, seq, observation, held in frame[[*PAGE, "seq", "observation", "page"]].itertuples(index=False):
                if (slug, kind) != key:
                    out += ended()
                    key, page, moved = (slug, kind), None, False
                if isinstance(held, str):
                    page = json.loads(held)
                    continue
                rows, page = outcome_rows(key, [{"seq": int(seq), "observation": observation}], page)
                out += [(*r, None) for r in rows]
                moved = True
            yield pd.DataFrame(out, columns=[*_COLUMNS, "page"], dtype=object)
        yield pd.DataFrame(ended(), columns=[*_COLUMNS, "page"], dtype=object)

    none = F.lit(None).cast("string")
    rows = observations.select(*PAGE, F.lit(1).alias("part"), "seq", "observation", none.alias("page"))
    if states is not None:
        rows = rows.union(states.select(*PAGE, F.lit(0), F.lit(None).cast("long"), none, "page").where("page is not null"))
    dealt = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "part", "seq")
    return dealt.mapInPandas(run, OUTCOME_SCHEMA + ", page string")


def latest(states: DataFrame) -> DataFrame:
    """The last row of each page."""
    return states.groupBy(*PAGE).agg(F.max("upto").alias("upto"), F.max_by("page", "upto").alias("page"))


class DetectorLog:
    """The detector's outcomes and states in a folder, as of the versions of a log of observations."""

    def __init__(self, spark: SparkSession, observations: str, folder: str):
        self.spark = spark
        self.observations = CommitLog(spark, observations)
        self.outcomes, self.states = CommitLog(spark, f"{folder}/outcomes"), CommitLog(spark, f"{folder}/states")

    @staticmethod
    def _folded(log: CommitLog) -> int:
        return max((e["meta"]["upto"] for e in log.entries() if e["meta"]), default=-1)

    def advance(self, upto: int | None = None) -> int:
        """Fold the versions after the last one folded, to ``upto`` (else the last there is); the number of outcomes appended.

        Outcomes are committed first, then states. Where a run broke off in between, the next one
        folds to the same version again, finds its outcomes there, and adds the states. Of two runs at once one fails or adds nothing.
        """
        done, begun = self._folded(self.states), self._folded(self.outcomes)
        upto = begun if begun > done else self.observations.version() if upto is None else upto
        tail = self.observations.read(after=done, upto=upto) if upto > done else None
        if tail is None:
            return 0
        known = self.states.read()
        if known is not None:
            known = latest(known.join(tail.select(*PAGE).distinct(), PAGE, "left_semi"))
        folder = self.outcomes._stage(fold(tail, known))  # both kinds of rows come from one fold
        rows = self.outcomes._staged(folder)
        n = self.outcomes.append(rows.where("page is null").drop("page"), OUTCOME_KEY, writer="fold", batch=upto, meta={"upto": upto})
        states = rows.where("page is not null").select(*PAGE, F.lit(upto).cast("long").alias("upto"), "page")
        self.states.append(states, writer="fold", batch=upto, meta={"upto": upto})
        self.outcomes._drop(folder)
        return n

    def compact(self, most: int = 8) -> int:
        """Leave one row a page of the states where more than ``most`` appends hold them; the number of folders replaced."""
        entries = self.states.live(self.states.entries())
        return self.states.compact(change=latest) if len(entries) > most else 0
