"""The detector as a stream with a state a signal: an unchanged page writes one value.

A page has one value of its own (what is known of it, and a digest of what was read last) and a map from
its signals to theirs. A reading with the digest of the one before it, after which nothing was
pending, is known to repeat each outcome; only how often and when that last happened is written, and it is
added to the signals' states when they are next needed. Of other readings the signals that moved are written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import OUTCOME_SCHEMA, outcome_rows, readable

_COLUMNS = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Outcomes that a second reading like the first follows with the named one, and with no other change than times and counts.
SETTLED = {**dict.fromkeys(("baseline", "unchanged", "changed", "acquisition-adopted", "currency-rebaselined"), "unchanged"), **dict.fromkeys(("baseline-empty", "no-data"), "no-data")}


def content(observed: dict) -> str:
    """Digest of a reading without its time."""
    return hashlib.sha256(json.dumps({k: v for k, v in observed.items() if k != "at"}, sort_keys=True).encode()).hexdigest()


class Page:
    """One page's state over the stores of a handle: ``own`` a value, ``signals`` a map."""

    def __init__(self, own, signals):
        self.own, self.signals = own, signals
        known = own.get()
        self.head = json.loads(known[0]) if known is not None else None
        self.stored: dict[str, str] | None = None
        self.page: dict | None = None

    def load(self) -> dict | None:
        """The page as the batch fold has it; reads all its signals."""
        if self.page is None and self.head is not None:
            self.stored = {name[0]: state[0] for name, state in self.signals.iterator()}
            state = {name: json.loads(s) for name, s in self.stored.items()}
            for name, outcome in (self.head["steady"] or {}).items() if self.head["repeats"] else ():
                state[name]["observed_at"] = self.head["seen"]
                if outcome == "unchanged":
                    state[name]["good_at"] = self.head["seen"]
                else:
                    state[name]["nulls"] += self.head["repeats"]
            self.page = self.head["facts"] | {"state": state}
        return self.page

    def read(self, key: tuple, seq: int, observation: str | None) -> list[tuple]:
        """Outcomes of one observation."""
        observed = readable(observation)
        if observed is not None and self.head is not None and self.head["steady"] is not None and self.head["content"] == content(observed):
            self.page = None
            self.head |= {"repeats": self.head["repeats"] + 1, "seen": observed["at"]}
            return [(*key, seq, observed["at"], "ok", name, outcome, None, None, None, None, None, None) for name, outcome in self.head["steady"].items()]
        rows, page = outcome_rows(key, [{"seq": seq, "observation": observation}], self.load())
        if observed is None or page is None:
            return rows
        stored = self.stored or {}
        for name, state in page["state"].items():
            text = json.dumps(state)
            if stored.get(name) != text:
                self.signals.updateValue((name,), (text,))
                stored[name] = text
        outcomes = {r[5]: r[6] for r in rows}
        settled = observed.get("status") != "unchanged" and {r[4] for r in rows} == {"ok"} and all(o in SETTLED for o in outcomes.values())
        self.stored, self.page = stored, page
        self.head = {"facts": {k: v for k, v in page.items() if k != "state"}, "content": content(observed), "steady": {n: SETTLED[o] for n, o in outcomes.items()} if settled else None, "repeats": 0, "seen": None}
        return rows

    def save(self) -> None:
        if self.head is not None:
            self.own.update((json.dumps(self.head),))


class Detector(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("page", "page string")
        self.signals = handle.getMapState("signals", "name string", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        page, out = Page(self.own, self.signals), []
        for seq, observation in pd.concat(frames).sort_values("seq")[["seq", "observation"]].itertuples(index=False):
            out += page.read(tuple(key), int(seq), observation)
        page.save()
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        page = json.loads(initialState["page"].iloc[0])
        for name, state in page["state"].items():
            self.signals.updateValue((name,), (json.dumps(state),))
        self.own.update((json.dumps({"facts": {k: v for k, v in page.items() if k != "state"}, "content": None, "steady": None, "repeats": 0, "seen": None}),))

    def close(self) -> None:
        pass


def detect_keyed(observations: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Outcomes of a stream of ``(slug, kind, seq, observation)``, going on from ``states(slug, kind, page)``
    of a batch fold when the stream first starts. Rows of a micro-batch are taken in the order of ``seq``,
    later batches after earlier ones. Needs the state store ``PROVIDER`` in ``spark.sql.streaming.stateStore.providerClass``.
    """
    initial = None if states is None else states.select("slug", "kind", "page").where("page is not null").groupBy("slug", "kind")
    rows = observations.select("slug", "kind", "seq", "observation")
    return rows.groupBy("slug", "kind").transformWithStateInPandas(statefulProcessor=Detector(), outputStructType=OUTCOME_SCHEMA, outputMode="append", timeMode="None", initialState=initial)
