"""Counts over what companies say: words, category nouns, claims, spellings, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# Families of claims as one expression each: kind, pattern, and its two parts where they are told the other way round.
CLAIMS = tuple((kind, rf"{'' if kind in ('money', 'rank') else chr(92) + 'b'}(?:{first})(?:{second})", (first, second) if swapped else None) for kind, first, second, swapped in V.CLAIM_FAMILIES)


def coverage(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """tracked, readable and unreadable of a value whose null is *not readable*."""
    return rows.groupBy(*by).agg(F.count("*").alias("tracked"), F.count(value).alias("readable"), (F.count("*") - F.count(value)).alias("unreadable"))


def word_votes(rows: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """``(word, n)``: one vote a row for each of its words but stop words; most votes first."""
    stop = F.array(*map(F.lit, T.STOPWORDS))
    voted = rows.select(F.explode(F.array_except(T.tokens(F.col(text)), stop)).alias("word"))
    return voted.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def category_groups(rows: DataFrame, text: str) -> DataFrame:
    """``(noun, n)`` by the first category noun of a text; a null noun is *unmatched*."""
    noun = T.first_family(F.col(text), T.forms(T.CATEGORY_NOUNS))
    return rows.where(F.col(text).isNotNull()).groupBy(noun.alias("noun")).agg(F.count("*").alias("n"))


def ai_mentions(rows: DataFrame, text: str) -> DataFrame:
    """``(family, n)``: rows with a word of the family."""
    table = {form: name for name, all_forms in T.AI_TERMS.items() for form in all_forms}
    return rows.select(F.explode(T.families(F.col(text), table)).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


def claims(text: Column) -> Column:
    """Array of struct(kind, claim): claims of each family in lower case, once, kind first found.
    A claim whose number comes last is told with it first."""

    def told(kind: str, parts: tuple[str, str] | None):
        def one(c: Column) -> Column:
            if parts:
                number = F.regexp_extract(c, rf"(?i)({parts[1]})$", 1)
                c = F.concat(number, F.lit(" "), F.regexp_replace(c, rf"(?i)\s+by\s+(?:{parts[1]})$", ""))
            return F.struct(F.lit(kind).alias("kind"), F.lower(F.rtrim(T.collapse(c), F.lit(".,;:!?"))).alias("claim"))

        return one

    found = [F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0)), told(kind, parts)) for kind, pattern, parts in CLAIMS]
    dated = r"^(?:1[89]|20|21)\d\d(?![\d,.+])"
    every = F.filter(F.concat(*found), lambda c: F.length(c["claim"]).between(4, 60) & ~c["claim"].rlike(dated) & ~c["claim"].rlike("|".join(V.NO_CLAIM)))
    once = lambda all_: F.filter(all_, lambda c, i: F.array_position(F.transform(all_, lambda x: x["claim"]), c["claim"]) == i + 1)
    return F.transform(F.array(every), once)[0]


def claim_kinds(rows: DataFrame, text: str) -> DataFrame:
    """``(kind, n, claims)``: rows with a claim of each family, and claims of it; counted by row, so
    that a lost task counts the same when it is done again."""
    by_row = F.transform(F.array_distinct(F.transform("c", lambda x: x["kind"])), lambda k: F.struct(k.alias("kind"), F.size(F.filter("c", lambda x: x["kind"] == k)).alias("claims")))
    return rows.select(claims(F.col(text)).alias("c")).select(F.explode(by_row).alias("k")).groupBy("k.kind").agg(F.count("*").alias("n"), F.sum("k.claims").cast("long").alias("claims"))


def modal_spelling(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """``(key, n, spelling)``: owners that use a name in any case, and its commonest spelling
    (ties: the one that sorts first)."""
    key = F.lower(name).alias("key")
    each = rows.select(key, F.col(name).alias("spelling"), owner).distinct()
    owners = each.groupBy("key").agg(F.countDistinct(owner).alias("n"))
    spelt = each.groupBy("key", "spelling").agg(F.count("*").alias("votes"))
    best = spelt.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("votes"), "spelling")).alias("spelling"))
    return owners.join(best, "key")
