"""Text functions as columns: words, markup, canonical form, hashes, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import ENTITIES

# Words that headline counts leave out.
STOPWORDS = (
    "about above after again against ain all and any are aren been before being below between both but can couldn did "
    "didn doesn doing don down during each few for from further had hadn has hasn have haven having her here hers herself "
    "him himself his how into isn its itself just mightn more most mustn myself needn nor not now off once only other our "
    "ours ourselves out over own same shan she should shouldn some such than that the their theirs them themselves then "
    "there these they this those through too under until very was wasn were weren what when where which while who whom why "
    "will with won wouldn you your yours yourself yourselves"
).split()
# Nouns that name a category, with their other forms.
CATEGORY_NOUNS = {
    "platform": ["platforms"], "system": ["systems"], "os": [], "infrastructure": [], "crm": [], "software": [], "workspace": ["workspaces"],
    "agent": ["agents"], "tool": ["tools", "toolkit"], "layer": ["layers"], "app": ["apps", "application", "applications"], "cloud": [], "canvas": [],
    "network": ["networks"], "service": ["services"], "helpdesk": [], "runtime": [], "database": ["databases"], "suite": [], "engine": [], "hub": [],
    "workflow": ["workflows"], "assistant": ["assistants"], "copilot": ["copilots"], "api": ["apis"], "marketplace": [], "standard": [], "stack": [],
    "model": ["models"], "cdp": [], "solution": ["solutions"],
}
# Families of words about machine intelligence.
AI_TERMS = {"ai": ["ai"], "agent": ["agent", "agents", "agentic"], "copilot": ["copilot", "copilots"], "autonomous": ["autonomous", "autonomy"]}


def forms(families: dict[str, list[str]]) -> dict[str, str]:
    """Each form of a family's word, its name included, to the name."""
    return {form: name for name, others in families.items() for form in (name, *others)}


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that begin with a letter; other letters part words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.rlike("^[a-z]"))


def tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: F.length(w) >= 3)


def family_of(word: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(lookup, word)


def first_family(text: Column, table: dict[str, str]) -> Column:
    """The family of the first word that has one; null for none."""
    return F.get(F.filter(F.transform(words(text), lambda w: family_of(w, table)), lambda f: f.isNotNull()), F.lit(0))


def families(text: Column, table: dict[str, str]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(words(text), lambda w: family_of(w, table)), lambda f: f.isNotNull())))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once: it stands in a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def _closed(html: Column, pattern: str, close: str) -> Column:
    """Matches of ``pattern`` as spaces. Only the markup up to the last ``close`` is searched: behind it
    nothing can end, and every opening would be followed to the end of the page in vain."""

    def cut(h: Column) -> Column:
        return _let(F.regexp_extract(h, rf"(?is)^.*{close}", 0), lambda head: F.concat(F.regexp_replace(head, pattern, " "), F.substring(h, F.length(head) + 1, F.length(h))))

    return _let(html, cut)


def strip_code(html: Column) -> Column:
    """Markup without comments, scripts, styles, noscript and templates; each leaves a space."""
    out = _closed(html, r"(?s)<!--.*?-->", "-->")
    for tag in ("script", "style", "noscript", "template"):
        out = _closed(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", rf"</{tag}\s*>")
    return out


def strip_svg(html: Column) -> Column:
    """Markup without drawings; each leaves a space."""
    return _closed(html, r"(?is)<svg\b[^>]*>.*?</svg\s*>", r"</svg\s*>")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}\x{2007}\x{202f}\x{2009}\x{200a}\x{200b}\x{200c}\x{200d}\x{feff}]+", " "))


def decode_entities(text: Column) -> Column:
    """``text`` with the named entities of ``ENTITIES`` and numeric ones as characters, each decoded once.

    Case of a name is free; what is no entity, has another name or a number beyond U+10FFFF stays.
    The number of half a surrogate pair gives U+FFFD. Null stays null.
    """
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def code(body: Column) -> Column:
        # digits after leading zeros: six hexadecimal or seven decimal ones at most are a code point
        hexed, decimal = F.regexp_extract(body, "^#x0*([0-9a-fA-F]*)$", 1), F.regexp_extract(body, "^#0*([0-9]*)", 1)
        number = F.when(body.startswith("#x") & (F.length(hexed) <= 6), F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("long"))
        return number.when(body.rlike("^#[0-9]") & (F.length(decimal) <= 7), F.concat(F.lit("0"), decimal).cast("long"))

    def character(number: Column) -> Column:
        known = F.when(number.between(0xD800, 0xDFFF), F.lit(0xFFFD)).when(number <= 0x10FFFF, number)
        return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")

    def decoded(part: Column) -> Column:
        """A part that stood behind an ampersand."""

        def of(body: Column) -> Column:
            char = F.when(body.startswith("#"), character(code(body))).when(body != "", F.try_element_at(names, F.lower(body)))
            return _let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(c, F.substring(part, F.length(body) + 2, F.length(part)))))

        return _let(F.regexp_extract(part, "^(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,10});", 1), of)

    whole = lambda t: F.array_join(F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")
    return _let(text, lambda t: F.when(t.contains("&"), whole(t)).otherwise(t))


def plain_text(html: Column) -> Column:
    """Text of markup: code and tags out, entities decoded, white space collapsed."""
    return text_of(strip_code(html))


def text_of(stripped: Column) -> Column:
    """The same of markup whose code is out already. Where a row's stripped markup is used more than
    once, it should be a column of its own, which is then made once."""
    return collapse(decode_entities(F.regexp_replace(stripped, r"<[^>]*>", " ")))


def canonical(text: Column) -> Column:
    """Quotes, dashes and spaces folded, zero-width characters out, white space collapsed; case kept."""
    old = "‘’ʼ′“”″‐‑‒–—―−     ​‌‍﻿"
    new = "''''" + '"""' + "-------" + "     "
    return F.trim(F.regexp_replace(F.translate(text, old, new), r"\s+", " "))


def text_magnitude(a: Column, b: Column) -> Column:
    """Edit distance of the canonical forms' first 200 characters, as a share of the longer; 1 at most."""
    x, y = (F.coalesce(canonical(t), F.lit("")) for t in (a, b))
    span = F.least(F.greatest(F.length(x), F.length(y), F.lit(1)), F.lit(200))
    return F.least(F.lit(1.0), F.levenshtein(F.substring(x, 1, 200), F.substring(y, 1, 200)) / span)


def list_delta(a: Column, b: Column) -> Column:
    """Struct of the items added and removed, case aside, and the Jaccard distance of the two."""
    x, y = (F.array_distinct(F.transform(t, lambda i: F.lower(i))) for t in (a, b))
    union = F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.struct(F.array_except(y, x).alias("added"), F.array_except(x, y).alias("removed"), (1 - F.size(F.array_intersect(x, y)) / union).alias("magnitude"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: ((h.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step))), 8, "0")
