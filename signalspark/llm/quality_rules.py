"""Line-first cleaning and document rules, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_spread

_WORD = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# Phrases that mark a line as navigation or boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "privacy policy", "read more", "share this", "sign in", "sign up", "subscribe", "terms of use",
)


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Up to so many different repeated windows are looked up one by one; more are found by sorting places.
FEW = 32


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once: it stands in a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column, width: int) -> Column:
    """Number of words under windows at ascending places: each covers those up to the next, ``width`` at most."""
    reach = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
    return _let(places, lambda p: F.aggregate(reach(p), F.lit(0).cast("long"), lambda a, x: a + x))


def _repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words in windows of ``width`` words that the array holds twice or more.

    The windows' hashes are sorted, so equal ones stand side by side. Most texts repeat few
    windows: their places are looked up. Else hashes are sorted with their places, so that the
    places of the repeated ones can be read off. Both ways give the same number.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(words[i + k] for k in range(width))))

    def of(h: Column) -> Column:
        twice = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))))
        return _let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d) <= FEW, _covered(looked_up(h, d), width)).otherwise(_covered(sorted_out(h), width)))

    def looked_up(h: Column, d: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())

    def sorted_out(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return _let(at, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k)), lambda x: x["i"])))

    return F.when(n < width, F.lit(0).cast("long")).otherwise(_let(hashes, of))


def _line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule.

    Punctuation: no letter or digit, or a tenth or more of its characters are symbols, or it has
    four or more ``!!`` runs. Navigation: three or more separators ``|`` or ``>`` standing alone.
    Boilerplate: it holds one of ``BOILERPLATE``.
    """
    solid = F.length(_removed(line, _SPACES))
    symbols = F.length(line) - F.length(_removed(line, _SYMBOLS))
    separators = F.size(F.split(F.concat(F.lit(" "), line, F.lit(" ")), r"(?<=[\x20\x09])[|>](?=[\x20\x09])")) - 1
    shouts = F.size(F.split(line, "!!+")) - 1
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    return ~line.rlike(r"[\p{L}\p{N}]") | (symbols * 10 >= solid) | (shouts >= 4) | (separators >= 3) | phrase


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_failed_lines, failed_words, cleaned_text``; any of that name are replaced."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "failed_words", "cleaned_text"]
    docs = docs.drop(*own)
    text = F.coalesce(F.col("text"), F.lit(""))
    # every line once: its text, whether it has a word, and whether it fails a rule
    solid = lambda s: s.rlike(_WORD)
    lines = F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("s"), F.when(solid(s), _line_fails(s)).alias("fails")))
    words = _let(_split(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_window_words(w).alias("repeated")))
    full = lambda a: F.filter(a, lambda x: x["fails"].isNotNull())
    texts = lambda a: F.transform(a, lambda x: x["s"])
    counts = _let(lines, lambda a: _let(full(a), lambda f: F.struct(
        F.size(f).cast("long").alias("n"), F.size(F.array_distinct(texts(f))).cast("long").alias("different"), texts(F.filter(f, lambda x: x["fails"])).alias("failed")
    )))
    kept = _let(lines, lambda a: F.array_join(texts(F.filter(a, lambda x: F.coalesce(~x["fails"], F.lit(True)))), "\n"))
    with_parts = docs.select("*", words.alias("__w"), counts.alias("__l"), kept.alias("cleaned_text"))
    n = lambda c: c.cast("long")
    return with_parts.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col("__w.n").alias("n_words"),
        n(F.length(_removed(text, _SPACES))).alias("word_chars"),
        n(F.length(text) - F.length(_removed(text, _SYMBOLS))).alias("n_symbols"),
        (F.col("__l.n") - F.col("__l.different")).alias("n_dup_lines"),
        F.col("__w.repeated").alias("n_repeat_words"),
        F.col("__l.n").alias("n_lines"),
        n(F.size("__l.failed")).alias("n_failed_lines"),
        F.aggregate("__l.failed", F.lit(0).cast("long"), lambda a, s: a + F.size(_split(s))).alias("failed_words"),
        "cleaned_text",
    )


def clean_and_judge(docs: DataFrame, most_lost: float = 0.3) -> DataFrame:
    """``measured(docs)`` with ``base_failed`` and ``kept``.

    base_failed: under 50 words, or over half the words in repeated three-word windows. kept:
    not base_failed, and the lines that fail a rule hold at most ``most_lost`` of the words.
    Null text is empty; an empty text, like any under 50 words, is base_failed. Rows that repeat
    are judged each for itself; no rows give none; other columns stay.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("failed_words") * 100 > round(100 * most_lost) * F.col("n_words")
    return measured(docs.drop("base_failed", "kept")).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~lost)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_and_judge(read_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "failed_words")


_SQL_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
OP2_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), judged AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    NOT regexp_matches(line, '[\p{{L}}\p{{N}}]')
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 >= len(regexp_extract_all(line, '{_WORD}'))
    OR len(regexp_extract_all(line, '!!+')) >= 4
    OR len(list_filter(string_split_regex(line, '[\x20\x09]'), lambda x: x IN ('|', '>'))) >= 3
    OR {_SQL_PHRASES} AS fails
  FROM lines WHERE regexp_matches(line, '{_WORD}')
), by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE fails) AS failed, coalesce(sum(n) FILTER (WHERE fails), 0) AS failed_words
  FROM judged GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_extract_all(d.text, '{_WORD}')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(failed_words, 0) AS BIGINT) AS failed_words
  FROM words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN by_doc l ON d.doc_id = l.doc_id
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND NOT (failed_words * 100 > 30 * n_words) AS kept FROM base
"""
