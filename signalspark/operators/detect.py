"""The change detector: a pure step from a page's state and one observation to its next state.

``gate`` decides whether a page's reading can be compared at all; ``step`` runs each signal's
rules. Both work on plain dicts, so the batch fold and the stream share them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of the rules.
SUSPECT_AFTER = 2
REMOVAL_READS = 5
YIELD_RATIO = 0.5
LIST_RATIO = 0.4
CONFIDENCE_DROP = 0.3
MEMORY = 6
RATIO_LOW, RATIO_HIGH, RATIO_SPREAD = 0.5, 2.0, 1.35
CURRENCY_READS = 3
ACQUISITION_READS = 3

# The signals; kind of comparison, family, and whether the place of reading matters.
SIGNALS = {
    **{f"anatomy_{n}": ("text", "anatomy", False) for n in ("sections", "section_count", "cta_count", "nav_links", "footer_links", "word_count", "form_fields")},
    "anatomy_elements": ("list", "anatomy", False),
    **{n: ("text", "hero", False) for n in ("headline", "subhead", "category_label", "meta_title", "meta_description")},
    **{n: ("list", "proof", False) for n in ("customer_logos", "proof_points")},
    "pricing_tiers": ("list", "pricing", True),
    "pricing_entry_price": ("text", "pricing", True),
    "pricing_seat_minimum": ("text", "pricing", True),
    "pricing_free_tier": ("enum", "pricing", True),
    "pricing_meta_title": ("text", "pricing", False),
}
_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
_MONEY = re.compile(r"\b([A-Z]{3})\s*(\d[\d.,]*)|([$€£¥₹])\s*(\d[\d.,]*)|(\d[\d.,]*)\s*([$€£¥₹])", re.ASCII)
_FOLDS = str.maketrans({**dict.fromkeys("‘’ʼ′", "'"), **dict.fromkeys("“”″", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("     ", " "), **dict.fromkeys("​‌‍﻿", None)})


def canonical(text: str | None) -> str | None:
    return None if text is None else " ".join(str(text).translate(_FOLDS).split())


def fnv1a(text: str) -> str:
    h = 0x811C9DC5
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] << 8 | raw[i + 1])) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def _loaded(value):
    try:
        return json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return None


def items(value: str | None, raw) -> list[str]:
    """Items of a list signal: of its JSON, else of the text by bars and commas."""
    data = _loaded(raw)
    if isinstance(data, dict):
        for key, name in (("names", None), ("items", "claim"), ("tiers", "name")):
            if isinstance(data.get(key), list):
                return [str(x.get(name, x)) if isinstance(x, dict) else str(x) for x in data[key]]
    return [x for x in (p.strip() for p in re.split(r"[|,]", value or "")) if x]


def list_delta(before: list[str], after: list[str]) -> tuple[list[str], list[str], float]:
    a, b = ({x.lower(): x for x in reversed(side)} for side in (before, after))
    added, removed = [x for k, x in b.items() if k not in a], [x for k, x in a.items() if k not in b]
    return sorted(added), sorted(removed), 1 - len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))


def edit_distance(a, b) -> int:
    """Levenshtein distance, a column of the table at a time: the bits of two whole numbers say
    where the column rises and falls (the bit-vector method of Myers and Hyyrö)."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, distance = every, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diagonal = ((same & rises) + rises ^ rises) | same | falls
        up, down = falls | ~(diagonal | rises) & every, rises & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls = down | ~(same | falls | up) & every, up & (same | falls)
    return distance


def magnitude(a: str, b: str) -> float:
    x, y = canonical(a) or "", canonical(b) or ""
    return min(1.0, edit_distance(x[:200], y[:200]) / min(max(len(x), len(y), 1), 200))


def prices(value: str | None, raw) -> tuple[set[str], dict[str, float]]:
    """Currencies that a value quotes, and amounts by tier name, else by place in the text."""
    data = _loaded(raw)
    if isinstance(data, dict):
        rows = data["tiers"] if isinstance(data.get("tiers"), list) else [data | {"name": data.get("tier", "value")}]
        rows = [r for r in rows if isinstance(r, dict)]
        found = {str(r["currency"]).upper() for r in rows if r.get("currency")}
        if found:
            return found, {str(r.get("name") or i): float(r["amount"]) for i, r in enumerate(rows) if isinstance(r.get("amount"), (int, float)) and not isinstance(r.get("amount"), bool)}
    found, amounts = set(), {}
    for m in _MONEY.finditer(str(value or "")):
        found.add(m[1] or _SYMBOLS[m[3] or m[6]])
        number = re.sub(r",(?=\d{3}\b)", "", m[2] or m[4] or m[5]).replace(",", ".")
        if n := re.match(r"\d+(?:\.\d+)?", number):
            amounts[f"#{len(amounts)}"] = float(n[0])
    return found, amounts


def currency_shift(before: tuple, after: tuple) -> tuple[str, bool] | None:
    """The new currencies, and whether the amounts moved in proportion; null if none moved."""
    (was, old), (now, new) = prices(*before), prices(*after)
    if not was or not now or was == now:
        return None
    pairs = [(a, new[k]) for k, a in old.items() if k in new and (a or new[k])]
    ratios = [b / a for a, b in pairs if a and b]
    fits = len(ratios) == len(pairs) > 0 and min(ratios) >= RATIO_LOW and max(ratios) <= RATIO_HIGH and max(ratios) / min(ratios) <= RATIO_SPREAD
    return ",".join(sorted(now)), fits


def origins_differ(before: dict | None, after: dict | None) -> str:
    """same, different or indeterminate; an unknown place is never taken for another."""
    a, b = before or {}, after or {}
    places = [x.get("environment") or "unknown" for x in (a, b)]
    if "unknown" not in places and places[0] != places[1]:
        return "different"
    if a.get("country") and b.get("country"):
        return "same" if a["country"] == b["country"] else "different"
    return "indeterminate"


def gate(observed: dict, previous: dict) -> dict:
    """Whether a reading can be compared: open, rebaseline, shifted, status, reason."""
    out = lambda status, reason=None, open_=False, rebaseline=False, shifted=False: {"status": status, "reason": reason, "open": open_, "rebaseline": rebaseline, "shifted": shifted}
    if not observed.get("fetch_ok", True):
        return out("error", observed.get("reason") or "fetch failed")
    if not observed.get("extractable", True):
        return out("blocked", f"variant {observed.get('variant')} can't be read")
    moved = lambda key, both: previous.get(key) and (observed.get(key) or not both) and previous[key] != observed.get(key)
    for key, status, both in (("extractor_version", "ok", False), ("variant", "changed-structure", False), ("lang", "ok", True), ("canonical", "ok", True)):
        if moved(key, both):
            return out(status, f"{key} {previous[key]} -> {observed.get(key)}", rebaseline=True)
    yields = family_yields(observed.get("signals", {}), previous.get("state", {}))
    large = {f: y for f, y in yields.items() if y[0] >= 3}
    if not large:  # no family is large enough to judge by: the page as a whole is
        large = {"page": y for y in [tuple(map(sum, zip(*yields.values(), strict=True)))] if y[0] >= 3} if yields else {}
    fallen = [f"{f} {was} -> {now}" for f, (was, now) in large.items() if now < was * YIELD_RATIO]
    if fallen:
        return out("changed-structure", "yield fell: " + ", ".join(fallen))
    if origins_differ(previous.get("origin"), observed.get("origin")) == "different":
        return out("origin-shift", "read from another place", open_=True, shifted=True)
    return out("ok", open_=True)


def family_yields(signals: dict, state: dict) -> dict[str, tuple[int, int]]:
    """Values held before and read now, by family."""
    out: dict[str, tuple[int, int]] = {}
    for name, current in signals.items():
        was, now = out.get(SIGNALS[name][1], (0, 0))
        out[SIGNALS[name][1]] = (was + bool((state.get(name) or {}).get("value")), now + bool((current or {}).get("value")))
    return out


EMPTY = {
    "observed_at": None, "good_at": None, "value": None, "json": None, "hash": None, "method": None, "confidence": None, "nulls": 0, "suspect": 0, "changes": 0,
    "recent": [], "currency_runs": 0, "currency_key": None, "acquisition_runs": 0, "acquisition_hash": None,
}


def _adopted(state: dict, current: dict, now: str) -> dict:
    digest = fnv1a(canonical(current["value"]))
    return state | {
        "observed_at": now, "good_at": now, "value": current["value"], "json": current.get("json"), "hash": digest, "method": current.get("method"), "confidence": current.get("confidence"),
        "nulls": 0, "suspect": 0, "recent": [digest, *(h for h in state["recent"] if h != digest)][:MEMORY], "currency_runs": 0, "currency_key": None, "acquisition_runs": 0, "acquisition_hash": None,
    }


def step_signal(name: str, current: dict | None, state: dict | None, now: str, healthy: bool = True, shifted: bool = False, origin: str = "unknown") -> tuple[dict, str, dict | None]:
    """Next state, outcome and event (or null) of one signal on a page whose gate is open."""
    kind, _, local = SIGNALS[name]
    value = (current or {}).get("value") or None
    if state is None:
        fresh = EMPTY | {"observed_at": now}
        return (_adopted(fresh, current, now), "baseline", None) if value else (fresh | {"nulls": 1}, "baseline-empty", None)
    new = state | {"observed_at": now}
    before = state["value"]
    event = lambda kind_, after, size, oscillating=0, added=(), removed=(): {
        "signal": name, "change_type": kind_, "before_value": before, "after_value": after, "before_json": state["json"], "after_json": (current or {}).get("json") if after else None,
        "previous_seen_at": state["good_at"], "magnitude": round(size, 3), "oscillating": oscillating, "added": list(added), "removed": list(removed),
    }
    if not value:
        new["nulls"] += 1
        if not before:
            return new, "no-data", None
        if healthy and new["nulls"] >= REMOVAL_READS:
            gone = {"value": None, "json": None, "hash": None, "good_at": None, "nulls": 0, "suspect": 0, "changes": state["changes"] + 1}
            return new | gone, "confirmed-removal", event("removed", None, 1.0)
        return new | {"suspect": int(new["nulls"] >= SUSPECT_AFTER)}, "parser-fault", None
    digest = fnv1a(canonical(value))
    if not before:
        runs = 0 if not healthy else state["acquisition_runs"] + 1 if state["acquisition_hash"] == digest else 1
        new |= {"nulls": 0, "suspect": 0, "acquisition_hash": digest, "acquisition_runs": runs}
        return (_adopted(new, current, now), "acquisition-adopted", None) if runs >= ACQUISITION_READS else (new, "acquisition", None)
    if canonical(before) == canonical(value):
        return _adopted(new, current, now), "unchanged", None
    weaker = state["confidence"] is not None and current.get("confidence") is not None and state["confidence"] - current["confidence"] >= CONFIDENCE_DROP
    if weaker and state["method"] != current.get("method"):
        return new | {"suspect": 1}, "suppressed", None
    old, read = (before, state["json"]), (value, current.get("json"))
    if shifted and (local or prices(*old)[0] or prices(*read)[0]):
        return new | {"suspect": 1, "currency_runs": 0, "currency_key": None}, "origin-shift", None
    shift = currency_shift(old, read)
    if shift and shift[1]:
        key = f"{shift[0]}@{origin}"
        new |= {"currency_key": key, "currency_runs": state["currency_runs"] + 1 if state["currency_key"] == key else 1}
        if new["currency_runs"] >= CURRENCY_READS:
            return _adopted(new, current, now), "currency-rebaselined", None
        return new | {"suspect": 1}, "currency-shift", None
    oscillating = int(digest in state["recent"])
    added, removed = (), ()
    if kind == "list":
        was, is_ = items(*old), items(*read)
        if len(was) >= 4 and len(is_) < len(was) * LIST_RATIO:
            return new | {"suspect": 1}, "suppressed", None
        added, removed, size = list_delta(was, is_)
    else:
        size = magnitude(before, value)
    done = _adopted(new, current, now)
    return done | {"changes": state["changes"] + 1}, "changed", event("modified", value, size, oscillating, added, removed)


def step(page: dict | None, observed: dict) -> tuple[dict, dict[str, str], list[dict], dict]:
    """Next state of a page, outcomes by signal, events, and the gate.

    ``page`` holds state by signal and what was last known of the page; ``observed`` has
    ``at``, ``signals`` (name: null or value, method, confidence, json), and the page's facts.
    A closed gate carries the state, and a rebaseline overwrites the last good values without
    touching suspicion, memory or currency counters.
    """
    page = page or {"state": {}}
    g, now, signals = gate(observed, page), observed["at"], observed.get("signals", {})
    read = sum(bool((v or {}).get("value")) for v in signals.values())
    healthy = g["open"] and read >= max(1, -(-len(signals) // 2))
    state, outcomes, events = dict(page["state"]), {}, []
    for name, current in signals.items():
        if g["open"]:
            state[name], outcomes[name], event = step_signal(name, current, state.get(name), now, healthy, g["shifted"], (observed.get("origin") or {}).get("id") or "unknown")
            events += [event] if event else []
            continue
        carried = (state.get(name) or EMPTY) | {"observed_at": now}
        if g["rebaseline"] and (current or {}).get("value"):
            good = _adopted(carried, current, now)
            carried |= {k: good[k] for k in ("good_at", "value", "json", "hash", "method", "confidence", "nulls", "acquisition_runs", "acquisition_hash")}
        state[name], outcomes[name] = carried, "suppressed"
    kept = page if not observed.get("fetch_ok", True) or not observed.get("extractable", True) else observed
    facts = {k: kept.get(k) for k in ("extractor_version", "variant", "lang", "canonical", "origin")}
    g["evidence"] = recovery(page, observed, read)
    facts |= {"last_status": g["status"], "last_read": page.get("last_read") if g["status"] in ("error", "blocked") else read}
    return facts | {"state": state}, outcomes, events, g


def corroborated(page: dict, signals: dict, now: str) -> dict | None:
    """The page after an unchanged fetch, which repeats every reading: pending acquisitions move
    on by one; null if none is pending."""
    out = dict(page["state"])
    moved = False
    for name, s in page["state"].items():
        current = signals.get(name) or {}
        if s["value"] is None and s["acquisition_runs"] > 0 and current.get("value") and fnv1a(canonical(current["value"])) == s["acquisition_hash"]:
            runs, moved = s["acquisition_runs"] + 1, True
            out[name] = _adopted(s, current, now) if runs >= ACQUISITION_READS else s | {"observed_at": now, "acquisition_runs": runs}
    return page | {"state": out} if moved else None


def quoted(text: str | None, most: int = 90) -> str:
    """A value in quotation marks, cut to ``most`` characters; *nothing* for none."""
    if text in (None, ""):
        return "nothing"
    text = " ".join(str(text).split())
    return f'"{text if len(text) <= most else text[: most - 3] + "\u2026"}"'


def summary(name: str, event: dict) -> str:
    """One sentence on an event: what was read before, what is read now, or what came and went."""
    label = name.replace("_", " ")
    if event["change_type"] == "removed":
        return f"{label} is gone; it was {quoted(event['before_value'])}"
    parts = [f"{word} {', '.join(event[word][:3])}" + (f" and {len(event[word]) - 3} more" if len(event[word]) > 3 else "") for word in ("added", "removed") if event.get(word)]
    text = f"{label} {'; '.join(parts)}" if parts else f"{label} changed from {quoted(event['before_value'])} to {quoted(event['after_value'])}"
    return text + (", a value that it had before" if event.get("oscillating") else "")


def recovery(before: dict, observed: dict, read: int) -> list[str]:
    """What speaks for it that a value which appears was there all along, and the reading before was broken:
    the page's structure had changed then, other rules read it, fewer signals could be read by
    far, or another signal of the page was missing that has a value."""
    found = []
    if before.get("last_status") == "changed-structure":
        found.append("the page's structure had changed at the last read")
    if before.get("extractor_version") and observed.get("extractor_version") and before["extractor_version"] != observed["extractor_version"]:
        found.append(f"the page was last read by version {before['extractor_version']}")
    was = before.get("last_read")
    if was is not None and read >= 3 and was < read * YIELD_RATIO:
        found.append(f"the last read found {was} signals, this one {read}")
    if any(s["nulls"] > 0 and s["value"] is not None for s in before.get("state", {}).values()):
        found.append("another signal was missing at the last read")
    return found


OUTCOME_SCHEMA = "slug string, kind string, seq long, at string, status string, signal string, outcome string, change_type string, before_value string, after_value string, magnitude double, oscillating int, summary string"


def _is(kind: type | tuple[type, ...]):
    return lambda v: v is None or isinstance(v, kind) and not isinstance(v, bool)


_FIELDS = {"at": _is(str), "status": _is(str), "reason": _is(str), "variant": _is(str), "lang": _is(str), "canonical": _is(str), "extractor_version": _is((str, int, float)), "origin": _is(dict), "signals": _is(dict)}
_SIGNAL_FIELDS = {"value": _is(str), "method": _is(str), "confidence": _is((int, float)), "json": _is((str, dict, list))}


def readable(observation: str | None) -> dict | None:
    """An observation as ``step`` takes it; null if it is no JSON object, has no time, or has a field of
    another kind than that field's. Fields that ``step`` doesn't know are let pass."""
    try:
        observed = json.loads(observation)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(observed, dict) or not isinstance(observed.get("at"), str) or not all(fits(observed.get(k)) for k, fits in _FIELDS.items()):
        return None
    signals = observed["signals"] = observed.get("signals") or {}
    if not all(isinstance(v, dict | None) and all(fits((v or {}).get(k)) for k, fits in _SIGNAL_FIELDS.items()) for v in signals.values()):
        return None
    origin = observed.get("origin") or {}
    return observed if all(isinstance(origin.get(k), str | None) for k in ("environment", "country", "id")) else None


def outcome_rows(key: tuple, rows: list[dict], page: dict | None) -> tuple[list[tuple], dict | None]:
    """Outcomes of a page's observations in their order, and its state after them.

    An observation whose ``status`` is unchanged repeats the readings before it: it only moves
    pending acquisitions on, and gives an outcome for those. One that can't be read gives the outcome
    *unreadable* and no signal, one signal that isn't known the same for that signal; both leave the state as it is.
    """
    out = []
    for row in rows:
        observed = readable(row["observation"])
        if observed is None:
            out.append((*key, row["seq"], None, "unreadable", None, "unreadable", None, None, None, None, None, None))
            continue
        for name in [n for n in observed["signals"] if n not in SIGNALS]:
            del observed["signals"][name]
            out.append((*key, row["seq"], observed["at"], "unreadable", name, "unreadable", None, None, None, None, None, None))
        if observed.get("status") == "unchanged":
            signals = observed.get("signals") or (page or {}).get("pending", {})
            after = corroborated(page, signals, observed["at"]) if page else None
            if after:
                for name, s in after["state"].items():
                    if s != page["state"][name]:
                        outcome = "acquisition-adopted" if s["value"] else "acquisition"
                        out.append((*key, row["seq"], observed["at"], "unchanged", name, outcome, None, None, None, None, None, None))
                page = after
            continue
        page, outcomes, events, g = step(page, observed)
        evidence = "; ".join(g["evidence"]) or None
        page["pending"] = {n: observed["signals"][n] for n, o in outcomes.items() if o == "acquisition"}
        by_signal = {e["signal"]: e for e in events}
        for name, outcome in outcomes.items():
            e = by_signal.get(name, {})
            out.append((*key, row["seq"], observed["at"], g["status"], name, outcome, e.get("change_type"), e.get("before_value"), e.get("after_value"), e.get("magnitude"), e.get("oscillating"), summary(name, e) if e else evidence if outcome.startswith("acquisition") else None))
    return out, page


def detect(observations: DataFrame) -> DataFrame:
    """Outcomes of all ``observations(slug, kind, seq, observation)``, the last a JSON object as
    ``step`` takes it, folded page by page in the order of ``seq``.

    Rows are dealt by page and sorted, and a task folds them as they come: it holds one page's
    state and one batch of rows, however long a page's history is.
    """
    columns = [c.split()[0] for c in OUTCOME_SCHEMA.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, page = None, None
        for frame in batches:
            out: list[tuple] = []
            for slug, kind, seq, observation in frame.itertuples(index=False):
                if (slug, kind) != key:
                    key, page = (slug, kind), None
                rows, page = outcome_rows(key, [{"seq": seq, "observation": observation}], page)
                out += rows
            yield pd.DataFrame(out, columns=columns, dtype=object)

    dealt = observations.select("slug", "kind", "seq", "observation").repartition("slug", "kind").sortWithinPartitions("slug", "kind", "seq")
    return dealt.mapInPandas(fold, OUTCOME_SCHEMA)
