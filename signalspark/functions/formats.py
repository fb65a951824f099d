"""Numbers and names as text: a percentage is never written without what it is of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How common something is, from which share on it is said so.
PREVALENCE_WORDS = ((0.90, "nearly every page"), (0.66, "most pages"), (0.45, "about half of pages"), (0.30, "about a third of pages"), (0.0, "a minority of pages"))
#: Heights of a drawn block, in pixels.
LEAST_HEIGHT, MOST_HEIGHT = 26, 90


def rounded(value: Column, places: int = 0) -> Column:
    """Half up, also below zero: floor(x + 0.5) at the last place."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale


def num(value: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(value.cast("long"), 0)


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent; null without a denominator."""
    return F.when(whole > 0, F.concat(F.floor(part * 100 / whole + 0.5).cast("string"), F.lit("%")))


def share_text(part: Column, whole: Column) -> Column:
    """``42% (5 of 12)``; *no readable page* without a denominator."""
    return F.coalesce(F.concat(percent(part, whole), F.lit(" ("), num(part), F.lit(" of "), num(whole), F.lit(")")), F.lit("no readable page"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, and the teens with th."""
    ten, last = n % 100, n % 10
    end = F.when(ten.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def title_case(text: Column) -> Column:
    """Each word's first letter in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def block_height(words: Column, most: Column) -> Column:
    """Height of a section's block by its words, within bounds."""
    return F.least(F.lit(MOST_HEIGHT), F.greatest(F.lit(LEAST_HEIGHT), F.floor(words * MOST_HEIGHT / most + 0.5))).cast("long")


def prevalence_words(share: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, words in reversed(PREVALENCE_WORDS):
        out = F.when(share >= least, words).otherwise(out)
    return out


def width(part: Column, whole: Column) -> Column:
    """Width of a bar in percent of the whole, to two places; 0 without one."""
    return F.when(whole > 0, rounded(part * 100 / whole, 2)).otherwise(F.lit(0.0))


def clipped(text: Column, most: int = 90) -> Column:
    """``text`` in at most ``most`` characters, three of which are an ellipsis's place where it was longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("…")))
