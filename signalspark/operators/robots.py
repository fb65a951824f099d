"""robots.txt of many hosts as tables: lines, the agents' groups, and the rule that decides a path.

Nothing is read on the driver: a file's lines are rows, what a line belongs to is a window over its
host's lines, and a path meets only those rules whose literal beginning it has. That is a join on
host and prefix, the prefixes being cut to the lengths that the host's rules have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import checkpointed

#: Rule tables of more rows than this are joined by a shuffle instead of a broadcast (some 100 bytes a row).
BROADCAST_ROWS = 200_000
#: What is done with a page's content, in the words of content signals.
USE = "search"
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def lines(files: DataFrame) -> DataFrame:
    """``(host, line, name, value, kind, group)`` of ``files(host, body)``: the lines that say something.

    ``group`` counts the host's groups: an agent's line that follows a rule or a delay begins the next
    one, an agent's line that follows another joins it. Lines before the first agent have group 0.
    A null body has no lines. A host with several files has the lines of all, by their text's order.
    """
    order = F.rank().over(Window.partitionBy("host").orderBy("body"))  # the texts themselves stay out of the lines' rows
    rows = files.where("body is not null").select("host", "body", order.alias("file")).select("host", "file", F.posexplode(F.split("body", r"\r?\n")).alias("place", "raw"))
    said = F.trim(F.regexp_replace("raw", "(?s)#.*", ""))
    at = F.locate(":", said)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = rows.where(at > 0).select("host", "file", "place", F.lower(strip(F.substring(said, F.lit(1), at - 1))).alias("name"), strip(F.substring(said, at + 1, F.length(said))).alias("value"))
    rows = rows.where(F.col("name").isin("user-agent", "allow", "disallow", "crawl-delay", "content-signal", "sitemap"))
    w = Window.partitionBy("host").orderBy("file", "place")
    kind = F.when(F.col("name") == "user-agent", "agent").when(F.col("name").isin("allow", "disallow", "crawl-delay"), "rule")
    rows = rows.withColumn("kind", kind).withColumn("line", F.row_number().over(w))
    before = F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("kind") == "agent") & F.coalesce(before == "rule", F.lit(True))
    return rows.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int")).select("host", "line", "name", "value", "kind", F.sum("begins").over(w).alias("group"))


def held(lines: DataFrame, agent: str) -> DataFrame:
    """``lines`` of the groups that hold for ``agent``, which are all those that name it, else those of
    the longest name that it begins with, else those for ``*``; with ``matched``, that name, and
    ``since``, the line that names it first in the group. A null host has none.

    All is told by windows over a host's lines, so the lines are dealt out once and never joined.
    """
    agent = agent.lower()
    named = F.when(F.col("name") == "user-agent", F.lower("value"))
    weight = F.when(named == agent, 1 << 30).when(named == "*", 0).when(F.startswith(F.lit(agent), named), F.length(named) + 1)
    best = F.max(F.when(weight.isNotNull(), F.struct(weight.alias("weight"), named.alias("agent")))).over(Window.partitionBy("host"))
    rows = lines.where("host is not null").withColumn("matched", best["agent"])
    since = F.min(F.when(named == F.col("matched"), F.col("line"))).over(Window.partitionBy("host", "group"))
    return rows.withColumn("since", since).where("since is not null")


def rules_for(lines: DataFrame, agent: str) -> DataFrame:
    """``(host, matched, allow, pattern)`` of the rules that hold for ``agent``; an empty one is no rule."""
    mine = held(lines, agent).where("name in ('allow', 'disallow') and value <> ''")
    return mine.select("host", "matched", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def policies(lines: DataFrame, agent: str) -> DataFrame:
    """``(host, matched, crawl_delay, signals)`` of each host that has a group for ``agent``: the last
    delay between 0 and an hour, and the last word on each use of the content."""
    later = lambda name: (F.col("name") == name) & (F.col("line") > F.col("since"))
    number = F.regexp_extract(F.replace("value", F.lit(","), F.lit(".")), _NUMBER, 1).try_cast("double")
    delay = F.when(later("crawl-delay") & (number >= 0) & (number < 3600), number)
    word = lambda part, k: F.lower(F.trim(F.get(F.split(part, "="), F.lit(k))))
    told = F.when(later("content-signal"), F.transform(F.split("value", ","), lambda part: F.struct(word(part, 0).alias("use"), word(part, 1).alias("answer"))))
    rows = held(lines, agent).select("host", "matched", F.col("line").cast("long").alias("line"), delay.alias("n"), F.posexplode_outer(told).alias("place", "told"))
    fits = F.expr("told.use <> '' and told.answer in ('yes', 'no')")
    rows = rows.select("host", "matched", "n", F.when(F.col("n").isNotNull(), F.col("line")).alias("at"), F.when(fits, F.col("told.use")).alias("use"), (F.col("told.answer") == "yes").alias("yes"), F.when(fits, F.shiftleft("line", 32) + F.col("place")).alias("said"))
    uses = rows.groupBy("host", "matched", "use").agg(F.max_by("n", "at").alias("n"), F.max("at").alias("at"), F.max_by("yes", "said").alias("yes"))
    signals = F.sort_array(F.collect_list(F.when(F.col("use").isNotNull(), F.struct("use", "yes"))))
    found = uses.groupBy("host", "matched").agg(F.max_by("n", "at").alias("crawl_delay"), signals.alias("told"))
    return found.select("host", "matched", "crawl_delay", F.when(F.size("told") > 0, F.map_from_entries("told")).alias("signals"))


def normal_path(url: Column) -> Column:
    """Path and query of an address as rules are held against it: slashes and tildes in one form."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*", ""), r"(?s)^[^:/?#]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(F.coalesce(rest, F.lit("")), "%2f", "%2F"), "%7[eE]", "~")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def segments(pattern: str) -> Column:
    """What stands between the stars of the pattern in a column."""
    return F.expr(f"split(if(endswith({pattern}, '$'), substring({pattern}, 1, length({pattern}) - 1), {pattern}), '\\\\*+')")


def fits(pattern: str, parts: str, path: str) -> Column:
    """Whether the pattern in one column, of ``segments`` in another, fits the path in a third, from its first
    segment on: each segment is looked for behind the one before it, so the work is linear in the path whatever
    the pattern; the last of an anchored pattern must be the path's end."""
    walk = "aggregate({some}, length({parts}[0]), (c, s) -> CASE WHEN c < 0 OR s = '' THEN c WHEN locate(s, {path}, c + 1) = 0 THEN -1 ELSE locate(s, {path}, c + 1) - 1 + length(s) END)"
    free = walk.format(some=f"slice({parts}, 2, size({parts}))", parts=parts, path=path)
    inner = walk.format(some=f"slice({parts}, 2, greatest(size({parts}) - 2, 0))", parts=parts, path=path)
    last = f"element_at({parts}, -1)"
    anchored = f"if(size({parts}) = 1, {path} = {parts}[0], {inner} >= 0 AND endswith({path}, {last}) AND length({path}) - length({last}) >= {inner})"
    return F.expr(f"startswith({path}, {parts}[0]) AND if(endswith({pattern}, '$'), {anchored}, {free} >= 0)")


def decisions(urls: DataFrame, rules: DataFrame, policies: DataFrame | None = None, use: str = USE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``urls(host, path, ...)`` with ``allowed`` and ``rule``, the longest of ``rules(host, allow, pattern)``
    that fits; of an allowing and a forbidding one of the same length the allowing one decides.

    No rule allows, and a declared *no* to ``use`` in ``policies`` forbids. Each host and path is
    decided once, however many rows have it. A null host or path has no rules.
    """
    literal = F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"(?s)\*.*", "")
    kept = checkpointed(rules.select("host", "allow", "pattern").distinct().withColumns({"literal": literal, "parts": segments("pattern")}))
    small = (lambda frame: F.broadcast(frame)) if kept.count() <= broadcast_rows else lambda frame: frame
    lengths = kept.groupBy("host").agg(F.collect_set(F.length("literal")).alias("lengths"))
    asked = urls.select("host", "path").where("host is not null and path is not null").distinct()
    starts = asked.join(small(lengths), "host").select("host", "path", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n"))
    met = starts.select("host", "path", F.expr("substring(path, 1, n)").alias("literal")).join(small(kept), ["host", "literal"])
    found = met.where(fits("pattern", "parts", "path")).groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("best"))
    out = urls.join(found.withColumnsRenamed({"host": "__host", "path": "__path"}), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    allowed = F.coalesce(F.col("best.allow"), F.lit(True))
    rule = F.col("best.pattern")
    if policies is not None:
        declined = policies.where(F.expr(f"not signals['{use}']")).select(F.col("host").alias("__declined")).distinct()
        out = out.join(declined, F.col("host") == F.col("__declined"), "left")
        allowed, rule = allowed & F.col("__declined").isNull(), F.when(F.col("__declined").isNull(), rule).otherwise(f"Content-Signal: {use}=no")
    return out.select(*urls.columns, allowed.alias("allowed"), rule.alias("rule"))
