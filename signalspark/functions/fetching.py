"""What a fetch gives, as columns: how long to wait, whether to read again, hashes of content, origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fnv1a

DAY = 86_400
#: Bytes of a body that are read, and of a robots.txt; characters of a body that are hashed.
MOST_BODY, MOST_ROBOTS, MOST_HASHED = 1_500_000, 512_000, 400_000
# What differs between two reads of one page: scripts, quoted tokens of one request or build, UTC times.
TOKENS = ("nonce", "csrf[-_]?token", "build[-_]?id", "deployment[-_]?id", "request[-_]?id", "trace[-_]?id")
VOLATILE = (r"(?is)<script\b[^>]*>.*?</script\s*>", rf"(?i)\b(?:{'|'.join(TOKENS)})\s*=\s*[\"'][^\"']*[\"']", r"\b\d{4}-\d{2}-\d{2}T[\d:.]+Z\b")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, which are told as a number or as a date, at most a day;
    null if it tells neither."""
    seconds = F.trim(value).try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^\w{3},\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    found = F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(found.isNotNull(), F.least(F.greatest(F.floor(found), F.lit(0)), F.lit(DAY)).cast("long"))


def stale_extractor(read_by: Column, current: Column | str) -> Column:
    """Whether a page was last read by other rules than the current ones, or by unknown ones."""
    return ~read_by.eqNullSafe(F.lit(current) if isinstance(current, str) else current)


def capped(body: Column, most: int = MOST_BODY) -> Column:
    """The first characters of a body; what is beyond is never read."""
    return F.substring(body, 1, most)


def normalised(body: Column) -> Column:
    """A body without what changes from one read to the next, white space collapsed, and capped."""
    for pattern in VOLATILE:
        body = F.regexp_replace(body, pattern, " ")
    return F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, MOST_HASHED)


def content_hash(body: Column) -> Column:
    """A hash that two reads of an unchanged page share; for equality only."""
    return F.lower(F.hex(F.xxhash64(normalised(body))))


def hash_json(value: Column) -> Column:
    """FNV-1a of a value as JSON, nulls written out."""
    return fnv1a(F.to_json(value, {"ignoreNullFields": "false"}))


def _followed(path: Column) -> Column:
    """A path, which begins with a slash, without dot segments."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/")
    here, up = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))
    step = lambda a, s: F.when(here(s), a).when(up(s), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(F.when(here(last) | up(last), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def _tidy(url: Column) -> Column:
    """A full http address in the form that equal addresses share."""
    place = F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#@]*)", 1))
    place = F.regexp_replace(F.regexp_replace(place, "^(http://[^:]*):80$", "$1"), "^(https://[^:]*):443$", "$1")
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/[^?#]*)", 1)
    followed = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), _followed(path)).when(path == "", F.lit("/")).otherwise(path)
    tidy = F.concat(place, followed, F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(url.rlike(r"^[^:/?#]+://[^/?#]*@"), url).otherwise(tidy)  # with a name or password: as it is


def absolute_url(link: Column, base: Column) -> Column:
    """A link as a full http address, resolved against its page's; null for another scheme or none.

    Scheme and host are in lower case, the scheme's own port is left out, dot segments are followed and
    an empty path is ``/``.
    """
    link = F.trim(link)
    scheme = F.lower(F.regexp_extract(base, r"(?i)^(https?):", 1))
    host = F.regexp_extract(base, r"(?i)^https?://([^/?#]+)", 1)
    path = F.regexp_extract(base, r"(?i)^https?://[^/?#]+(/[^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    root = F.concat(scheme, F.lit("://"), host)
    full = (
        F.when(link.isNull() | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike(r"(?i)^https?://[^/?#]+"), link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (host == ""), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), link))
        .otherwise(F.concat(root, folder, link))
    )
    return _tidy(full)


def traced_origin(body: Column, environment: Column) -> Column:
    """Struct of the place that a trace of ``key=value`` lines tells: environment, country, region
    and an id of the first two; what it doesn't tell is null."""
    pairs = F.str_to_map(F.coalesce(body, F.lit("")), F.lit("\n"), F.lit("="))
    country = F.try_element_at(pairs, F.lit("loc"))
    country = F.when(country.rlike("^[A-Z]{2}$"), country)
    region = F.try_element_at(pairs, F.lit("colo"))
    region = F.when(region.rlike("^[A-Z]{3}$"), region)
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.struct(environment.alias("environment"), country.alias("country"), region.alias("region"), F.concat_ws(":", known(environment), known(country)).alias("id"))


def fresh_until(loaded_at: Column, hours: int = 24) -> Column:
    """Until when what was loaded may be used again."""
    return loaded_at + F.make_interval(hours=F.lit(hours))
