"""URL rules, and block decisions that follow redirects and canonical links.

Pages that redirect to, or name as canonical, the same place are one resource under several
addresses. Addresses are nodes, redirect and canonical links are edges, and connected components
are found with joins and grouped minima only. A rule that fits an address decides it. Any other
address takes its component's decision: allow if a rule allows an alias of it (an explicit allow
goes before any block), else block if a rule blocks an alias, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, read_table
from .components import connected_components

#: Aliases of more rows than this are joined by a shuffle instead of a broadcast (some 200 bytes a row).
BROADCAST_ROWS = 200_000
#: Keys that pages without an address are dealt by.
ODD_KEYS = 1024

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(`__url`, instr(`__url`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _placed(urls: DataFrame) -> DataFrame:
    """``urls(__url)`` with ``host`` and ``path``."""
    host, path = host_and_path(F.col("__url"))
    return urls.withColumns({"host": host, "path": path})


def _fitting(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as struct(rule, verdict); null for none."""
    host, path = F.col("host"), F.col("path")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _tags(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)))


def linked_urls(html: Column) -> Column:
    """Array of the addresses that a page's canonical links and refresh redirects name."""
    text = F.coalesce(html, F.lit(""))
    canonical = F.transform(F.filter(_tags(text, "link"), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")), lambda t: F.trim(_attribute(t, "href")))
    refresh = F.filter(_tags(text, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    target = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    links = F.filter(F.concat(canonical, target), lambda u: u != "")
    return F.when(text.rlike("(?i)canonical|http-equiv"), links).otherwise(F.array().cast("array<string>"))


def _absolute(target: Column, host: Column, path: Column) -> Column:
    """An address in full; relative ones are resolved against the page's host and folder."""
    folder = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    base = F.concat(F.lit("http://"), host)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` for every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)``, where given, adds edges between urls to those of the pages'
    html. Urls of one host and path are one address: scheme, query and fragment make no
    difference to a rule. ``component`` is the smallest address reachable by edges, the own one
    included. Of rules of one length the one listed last wins. Null or odd urls are the address of empty host and
    path, which takes part in no edge; null html has no links; relative links are resolved
    against the page; no rows give none; other columns are ignored. ``broadcast_rows`` changes the plan only.
    """
    placed = _placed(pages.select("page_id", F.col("url").alias("__url"), "html"))
    address = F.concat("host", "path")
    edges = placed.select("host", "path", F.explode(linked_urls(F.col("html"))).alias("to")).where("host <> ''").select(address.alias("a"), _absolute(F.col("to"), F.col("host"), F.col("path")).alias("__url"))
    edges = _placed(edges).where("host <> ''").select("a", F.col("host").alias("to_host"), F.col("path").alias("to_path"), F.concat("host", "path").alias("b"))
    if redirects is not None:
        left = _placed(redirects.select(F.col("source").alias("__url"), "target")).where("host <> ''").select(address.alias("a"), F.col("target").alias("__url"), F.struct("host", "path").alias("from"))
        both = _placed(left).where("host <> ''")
        edges = edges.unionByName(both.select("a", F.col("host").alias("to_host"), F.col("path").alias("to_path"), address.alias("b")))
        sources = both.select("from.host", "from.path")
    else:
        sources = None
    edges = checkpointed(edges)
    components = connected_components(edges.select("a", "b"))
    known = placed.select("host", "path").union(edges.select(F.col("to_host"), F.col("to_path")))
    known = (known if sources is None else known.union(sources)).distinct().select(address.alias("node"), _fitting(rules).alias("fit"))
    decided = (
        components.join(known.where("fit is not null"), "node")
        .groupBy("component")
        .agg(F.max(F.col("fit.verdict") == "allow").alias("allowed"))
        .select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("inherited"))
    )
    aliases = checkpointed(components.join(decided, "component", "left"))
    aliases = F.broadcast(aliases) if aliases.count() <= broadcast_rows else aliases
    # odd urls have no alias; were their empty address a key, they would all meet in one task
    key = F.when(F.col("host") == "", F.concat(F.lit("?"), F.pmod(F.xxhash64("page_id"), F.lit(ODD_KEYS)).cast("string"))).otherwise(address)
    own = placed.select("page_id", "host", "path", _fitting(rules).alias("fit"), key.alias("__key"))
    judged = own.join(aliases, (F.col("__key") == F.col("node")) & (F.col("host") != ""), "left")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "inherited", F.lit("allow")).alias("verdict"), F.coalesce("component", address).alias("component")
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_attribute(name: str) -> str:
    pattern = rf"""'(?is)[\s"\x27]{name}\s*=\s*(?:"([^"]*)"|\x27([^\x27]*)\x27|([^\s"\x27>]+))'"""
    return "(" + " || ".join(f"regexp_extract(tag, {pattern}, {k})" for k in (1, 2, 3)) + ")"


# Edges and components are written out too, though the pages of the given tables have no canonical
# link or refresh tag; tests hold it against generated pages that have.
OP5_SQL = rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), placed AS (
  SELECT page_id, html,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM cut
), tags AS (
  SELECT host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM placed WHERE host <> ''
), named AS (
  SELECT host, path, CASE
    WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(lower({_sql_attribute("rel")}), '(^|\s)canonical(\s|$)') THEN trim({_sql_attribute("href")})
    WHEN regexp_matches(tag, '(?is)^<meta') AND lower({_sql_attribute("http-equiv")}) = 'refresh' THEN regexp_extract({_sql_attribute("content")}, '(?i)url\s*=\s*[\x27"]?([^\x27"\s]+)', 1)
    ELSE '' END AS target FROM tags
), full_targets AS (
  SELECT host || path AS a, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || host || target
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || target END AS target FROM named WHERE target <> ''
), pointed AS (
  SELECT a, substr(target, strpos(target, '://') + 3) AS rest FROM full_targets
), ends AS (
  SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM pointed
), edges AS (
  SELECT a, host || path AS b FROM ends WHERE host <> '' UNION SELECT host || path, a FROM ends WHERE host <> ''
), reached(node, other) AS (
  SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reached r JOIN edges e ON r.other = e.a
), known AS (
  SELECT host, path FROM placed UNION SELECT host, path FROM ends WHERE host <> ''
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC) AS n
  FROM known, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), inherited AS (
  SELECT r.node, CASE WHEN bool_or(f.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reached r JOIN fits f ON r.other = f.host || f.path AND f.n = 1 GROUP BY r.node
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, i.verdict, 'allow') AS verdict
FROM placed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path AND f.n = 1 LEFT JOIN inherited i ON i.node = p.host || p.path
"""
