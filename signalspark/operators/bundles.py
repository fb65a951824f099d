"""Everything that a view shows, from one scan: a dict of small frames over one checkpointed table of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import measures as M
from ..functions import text as T
from ..sources.tables import checkpointed
from . import insights, ordering, positioning, sequences, structure

_VOTE = "array<struct<part:string,key:string,sub:string,n:long,m:long>>"


def _vote(part: str, key: Column | str | None, sub: Column | str | None = None, n: Column | int = 1, m: Column | int = 0) -> Column:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    number = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    return F.struct(F.lit(part).alias("part"), text(key).alias("key"), text(sub).alias("sub"), number(n).alias("n"), number(m).alias("m"))


def _if(condition: Column, *votes: Column) -> Column:
    return F.when(condition, F.array(*votes)).otherwise(F.array().cast(_VOTE))


def _yes(answer: Column, other: str = "unreadable") -> Column:
    return F.when(answer, "yes").when(~answer, "no").otherwise(other)


def state_of_positioning(
    companies: DataFrame, headline: str, fields: list[str], tiers: str, free: str, said: str, logos: str, segment: str, cuts: dict[str, Column], words: int = 12
) -> dict[str, DataFrame]:
    """The positioning view of ``companies``, one row each: ``headline_words, category_nouns, ai_answers,
    ai_by_field, ai_by_term, pricing, entry_buckets, currency_mix, proof_claims, logo_mentions, segments``.

    Each company gives all its votes at once; these are added up before and after one shuffle, and every
    frame is read from the sums, of which there are as many as there are different words, names, prices and groups.
    ``logos`` is an array of names, ``tiers`` as ``insights.pricing_shape`` takes it. Each frame is what its own function gives.
    """
    col = F.col
    stop = F.array(*map(F.lit, T.STOPWORDS))
    none = F.array().cast("array<string>")
    terms = T.forms(T.AI_TERMS)
    mention = insights.mentions(fields)
    every = reduce(F.array_union, (F.coalesce(T.families(col(c), terms), none) for c in fields))
    amounts = F.transform(tiers, lambda t: t["amount"])
    quoted = F.array_distinct(F.filter(F.transform(tiers, lambda t: t["currency"]), lambda c: c.isNotNull()))
    entry = F.array_min(F.filter(amounts, lambda a: a > 0))
    spelt = F.array_distinct(F.filter(F.coalesce(logos, none), lambda x: x.isNotNull()))
    kinds = list(dict.fromkeys(insights.CLAIM_KINDS.values()))
    claim = lambda k: F.size(F.filter("__claims", lambda x: x["kind"].isin(*[f for f, p in insights.CLAIM_KINDS.items() if p == k])))
    rows = companies.withColumn("__claims", F.coalesce(positioning.claims(col(said)), F.array().cast("array<struct<kind:string,claim:string>>")))
    votes = [
        F.transform(F.array_except(F.coalesce(T.tokens(col(headline)), none), stop), lambda w: _vote("word", w)),
        _if(col(headline).isNotNull(), _vote("noun", T.first_family(col(headline), T.forms(T.CATEGORY_NOUNS)))),
        F.array(_vote("ai", _yes(mention)), *(_vote("ai_field", c, n=F.coalesce(insights.mentions([c]).cast("int"), F.lit(0)), m=col(c).isNotNull().cast("int")) for c in fields)),
        F.transform(every, lambda f: _vote("ai_term", f)),
        F.array(_vote("free", _yes(col(free)))),
        _if(col(tiers).isNotNull(), _vote("tiers", "readable"), _vote("tiers", "sales", n=F.coalesce(F.exists(tiers, lambda t: t["amount"].isNull()).cast("int"), F.lit(0)))),
        _if(entry.isNotNull(), _vote("entry", entry)),
        F.transform(F.coalesce(quoted, none), lambda c: _vote("currency", c)),
        F.filter(F.array(*(_vote("claim", k, n=(claim(k) > 0).cast("int"), m=claim(k)) for k in kinds), _vote("claims", None, m=F.size("__claims"))), lambda v: v["n"] > 0),
        F.transform(spelt, lambda x: _vote("spelling", F.lower(x), x)),
        F.transform(F.array_distinct(F.transform(spelt, lambda x: F.lower(x))), lambda k: _vote("logo", k)),
        _if(col(segment).isNotNull(), *(_vote("cell", col(segment), F.concat(F.lit(f"{name}:"), _yes(answer))) for name, answer in cuts.items())),
    ]
    each = rows.select(F.explode(F.concat(*(v.cast(_VOTE) for v in votes))).alias("v")).select("v.*")
    sums = checkpointed(each.groupBy("part", "key", "sub").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    return _frames(sums, fields, kinds, list(cuts), words)


def _frames(sums: DataFrame, fields: list[str], kinds: list[str], cuts: list[str], words: int) -> dict[str, DataFrame]:
    of = lambda part, key, *more: sums.where(F.col("part") == part).select(F.col("key").alias(key), *(F.col(a).alias(b) for a, b in more))
    known = lambda name, values: sums.sparkSession.createDataFrame([(v,) for v in values], f"`{name}` string")
    n = lambda part, key=None: F.coalesce(F.sum(F.when((F.col("part") == part) & (F.lit(True) if key is None else F.col("key") == key), F.col("n"))), F.lit(0))
    votes = of("word", "word", ("n", "n"))
    entries = of("entry", "amount", ("n", "n")).select(F.col("amount").cast("double").alias("amount"), "n")
    middle = F.floor((F.col("total") - 1) / 2)
    median = ordering.positions_of(entries, "amount").agg(F.max(F.when((F.col("before") <= middle) & (middle < F.col("before") + F.col("n")), F.col("amount"))).alias("median_entry"))
    prices = sums.agg(
        n("free", "yes").alias("free_yes"), n("free", "no").alias("free_no"), n("free", "unreadable").alias("free_unreadable"), n("tiers", "readable").alias("tiers_readable"), n("tiers", "sales").alias("contact_sales")
    )
    buckets = entries.groupBy(M.bucket(F.col("amount")).alias("bucket")).agg(F.sum("n").alias("n"))
    total = sums.agg(F.coalesce(F.sum(F.when(F.col("part") == "claims", F.col("m"))), F.lit(0)).alias("total_claims"))
    spelling = of("spelling", "key", ("sub", "spelling"), ("n", "votes")).groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("votes"), "spelling")).alias("spelling"))
    answer = lambda a: F.coalesce(F.sum(F.when(F.col("answer") == a, F.col("n"))), F.lit(0)).alias(a)
    parted = of("cell", "group", ("sub", "sub"), ("n", "n")).select("group", F.regexp_extract("sub", r"(?s)^(.*):", 1).alias("cut"), F.regexp_extract("sub", r"([a-z]+)$", 1).alias("answer"), "n")
    cells = parted.groupBy("group", "cut").agg(answer("yes"), answer("no"), answer("unreadable")).withColumn("readable", F.col("yes") + F.col("no"))
    fill = lambda frame, *cs: frame.fillna(0, list(cs))
    return {
        "headline_words": insights.most_first(votes, "n", "word", words).crossJoin(F.broadcast(votes.agg(F.count("*").alias("distinct_words")))),
        "category_nouns": of("noun", "noun", ("n", "n")),
        "ai_answers": sums.agg(n("ai", "yes").alias("mention"), n("ai", "no").alias("quiet"), n("ai", "unreadable").alias("unreadable")),
        "ai_by_field": fill(known("field", fields).join(of("ai_field", "field", ("n", "mention"), ("m", "readable")), "field", "left"), "mention", "readable"),
        "ai_by_term": fill(known("family", list(T.AI_TERMS)).join(of("ai_term", "family", ("n", "n")), "family", "left"), "n"),
        "pricing": prices.crossJoin(F.broadcast(median)),
        "entry_buckets": fill(known("bucket", [k for k, _, _ in M.PRICE_BUCKETS]).join(buckets, "bucket", "left"), "n"),
        "currency_mix": of("currency", "currency", ("n", "n")),
        "proof_claims": of("claim", "kind", ("n", "n"), ("m", "claims")).where("n > 0").crossJoin(F.broadcast(total)),
        "logo_mentions": of("logo", "key", ("n", "n")).join(spelling, "key"),
        "segments": cells.withColumn("share", M.share(F.col("yes"), F.col("readable"))),
    }


def page_anatomy(items: DataFrame, page: str, position: str, symbol: str, size: str, vocabulary: list[str], other: str = "other") -> dict[str, DataFrame]:
    """The anatomy view of ``items``, a row a section: ``quality, worst_pages, positions, elements, scales, strips, vocabulary``.

    Sections are gathered by page once, a page having few; every frame is read from that table.
    """
    section = F.struct(F.col(position).alias("p"), F.col(symbol).alias("s"), F.col(size).alias("w"))
    pages = checkpointed(items.groupBy(page).agg(F.array_sort(F.collect_list(section)).alias("sections")))
    again = pages.select(page, F.explode("sections").alias("x")).select(page, F.col("x.p").alias(position), F.col("x.s").alias(symbol), F.col("x.w").alias(size))
    total = F.broadcast(pages.agg(F.count("*").alias("pages")))
    has = pages.select(F.explode(F.array_distinct(F.transform("sections", lambda x: x["s"]))).alias(symbol)).groupBy(symbol).agg(F.count("*").alias("n"))
    known = items.sparkSession.createDataFrame(list(enumerate(vocabulary)), f"place int, `{symbol}` string")
    strips = pages.select(page, F.array_join(F.transform("sections", lambda x: x["s"]), " > ").alias("sequence"), F.size("sections").cast("long").alias("sections"), F.aggregate("sections", F.lit(0.0), lambda a, x: a + F.coalesce(x["w"].cast("double"), F.lit(0.0))).alias("words"))
    lacking = F.size(F.filter("sections", lambda x: x["s"] == other)).cast("long")
    counted = pages.select(page, F.size("sections").cast("long").alias("sections"), lacking.alias("other"))
    share = F.when(F.col("sections") > 0, formats.rounded(F.col("other") / F.col("sections"), 3))
    quality = counted.agg(F.coalesce(F.sum("sections"), F.lit(0)).alias("sections"), F.coalesce(F.sum("other"), F.lit(0)).alias("other")).withColumn("share", share)
    return {
        "quality": quality,
        "worst_pages": counted.where("other > 0").withColumn("share", share).orderBy(F.desc("share"), F.desc("sections"), page).limit(20),
        "positions": sequences.position_profile(again, position, symbol),
        "elements": known.drop("place").join(has, symbol, "left").crossJoin(total).select(symbol, F.coalesce("n", F.lit(0)).alias("n"), "pages"),
        "scales": structure.page_scales(strips),
        "strips": strips,
        "vocabulary": known,
    }


def company_documents(companies: DataFrame, queue: DataFrame, signals: DataFrame, events: DataFrame, fetches: DataFrame, company: str, most_events: int = 200, most_fetches: int = 20) -> DataFrame:
    """One row a company: all its columns, and ``queue``, ``signals``, ``events`` and ``fetches`` as arrays.

    ``queue(company, kind, ...)`` has a row a page, the home page first; ``signals(company, signals)`` a map, whose
    entries come by name; ``events(company, place, ...)`` and ``fetches(company, place, ...)`` have the place of each row, and only
    the first ones stay. So no company's row grows with its history.
    """

    def listed(rows: DataFrame, name: str, *order: Column) -> DataFrame:
        fields = [c for c in rows.columns if c != company]
        item = F.struct(*(o.alias(f"__{i}") for i, o in enumerate(order)), F.struct(*fields).alias("x"))
        return rows.groupBy(company).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias(name))

    place = F.col("place")
    parts = [
        listed(queue, "queue", (F.col("kind") != "home").cast("int"), F.col("kind")),
        signals.select(company, F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.struct(e["key"].alias("signal"), e["value"].alias("state"))).alias("signals")),
        listed(events.where(place <= most_events), "events", place),
        listed(fetches.where(place <= most_fetches), "fetches", place),
    ]
    out = reduce(lambda a, b: a.join(b, company, "left"), parts, companies)
    empty = {name: F.coalesce(name, F.array().cast(out.schema[name].dataType)) for name in ("queue", "signals", "events", "fetches")}
    return out.withColumns(empty)
