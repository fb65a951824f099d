"""robots.txt: parsing, group choice, and the longest matching rule."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Group:
    """Rules for an agent: (allow, pattern) pairs, a delay in seconds, and declared uses."""

    rules: list[tuple[bool, str]] = field(default_factory=list)
    crawl_delay: float | None = None
    signals: dict[str, bool] = field(default_factory=dict)


def parsed(body: str | None) -> dict[str, Group]:
    """Groups by agent in lower case. Agents named one after another share a group's lines."""
    groups: dict[str, Group] = {}
    agents: list[str] = []
    open_ = True  # whether a further agent line joins the ones before it
    for line in (body or "").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), Group())
        elif name in ("allow", "disallow", "crawl-delay"):
            open_ = not agents
            for group in map(groups.get, agents):
                if name != "crawl-delay":
                    group.rules += [(name == "allow", value)] if value else []
                elif (m := re.match(r"\d+(?:\.\d*)?", value.replace(",", "."))) and float(m[0]) < 3600:
                    group.crawl_delay = float(m[0])
        elif name == "content-signal":
            for use, _, word in (part.lower().partition("=") for part in value.split(",")):
                if word.strip() in ("yes", "no"):
                    for group in map(groups.get, agents):
                        group.signals[use.strip()] = word.strip() == "yes"
    return groups


def group_for(groups: dict[str, Group], agent: str) -> Group | None:
    """The group of the agent's name, else of its longest prefix, else of ``*``."""
    agent = agent.lower()
    if agent in groups:
        return groups[agent]
    prefixes = [g for g in groups if g != "*" and agent.startswith(g)]
    return groups[max(prefixes, key=len)] if prefixes else groups.get("*")


def pattern_regex(pattern: str) -> str:
    """A rule's pattern as a regular expression: ``*`` is any text, a final ``$`` the end."""
    end = r"\z" if pattern.endswith("$") else ""
    body = pattern[:-1] if end else pattern
    return "(?s)^" + ".*".join("".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in part) for part in re.sub(r"\*+", "*", body).split("*")) + end


def allowed(path: Column, rules: list[tuple[bool, str]], use_declined: bool = False) -> Column:
    """Whether the longest pattern that fits allows the path; an allow of the same length wins.
    A declined use forbids all."""
    best = {}
    for kind in (True, False):
        lengths = [F.when(path.rlike(pattern_regex(p)), len(p)).otherwise(-1) for allow, p in rules if allow is kind]
        best[kind] = F.greatest(F.lit(-1), F.lit(-1), *lengths)
    return F.lit(False) if use_declined else (best[False] < 0) | (best[True] >= best[False])


def status_rule(http: Column) -> Column:
    """What the answer for robots.txt means: its rules hold, or all is denied or allowed."""
    return F.when((http >= 200) & (http < 300), "rules").when(http.isin(401, 403), "deny").when((http >= 400) & (http < 500), "allow").otherwise("deny")
