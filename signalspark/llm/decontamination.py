"""Search for short test items inside long documents, in built-in functions only.

Items are partitioned by size, into classes of at most u = 2, 4, 8, ... distinct shingles. With a
containment of ``t`` an item of the class misses M = floor((1 - t) * u) shingles at most, so a
MinHash sketch of its 2 * M + 1 smallest shingle hashes has M + 1 at least in any document that
contains it: a document that has fewer of a sketch's values is no candidate, and none that
contains the item is lost. A class also sets the fewest words that a document needs to be looked
up in it. Sketches, not items, are looked up for every shingle of every document. Candidates are
then verified by the exact containment of the items' shingles; only their texts are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_spread, read_table

SHINGLE = 5
CONTAINMENT = 0.8
#: Indexes of more rows than this are joined by a shuffle instead of a broadcast (32 bytes a row),
#: and so are ids of candidates (8 bytes) of ten times as many rows.
BROADCAST_ROWS = 200_000


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(frame: DataFrame, keep: list[str], width: int, value) -> DataFrame:
    """``keep``, ``n_words`` and ``shingle``: a row for each window of ``width`` words.

    The windows' places are exploded and ``value`` of the words there is computed on the row, so
    the array of all shingles is never made.
    """
    places = F.when(F.size("words") >= width, F.sequence(F.lit(1), F.size("words") - (width - 1)))
    return frame.select(*keep, "words", F.explode(places).alias("at")).select(*keep, F.size("words").alias("n_words"), value(F.col("words"), F.col("at"), width).alias("shingle"))


def _hash(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(words, at + (k - 1)) for k in range(width)))


def _string(words: Column, at: Column, width: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, at + (k - 1)) for k in range(width)))


def _of_items(items: DataFrame, value) -> DataFrame:
    """``(item_id, shingle)``: windows of five words, or of all words of a shorter item."""
    parts = [_windows(items.where(F.size("words") == k), ["item_id"], k, value) for k in range(1, SHINGLE)]
    return reduce(DataFrame.union, parts, _windows(items, ["item_id"], SHINGLE, value)).select("item_id", "shingle")


def _of_documents(docs: DataFrame, widths: list[int], value) -> DataFrame:
    """``(doc_id, n_words, shingle)``: windows of five words, and of as many as the short items have."""
    return reduce(DataFrame.union, [_windows(docs, ["doc_id"], k, value) for k in [SHINGLE, *widths]])


def _sketches(items: DataFrame) -> DataFrame:
    """``(item_id, shingle, needed, least_words)``: the sketch of each item, how many of it a
    document needs, and how many words a document of that size class needs."""
    hashed = _of_items(items, _hash).groupBy("item_id").agg(F.array_sort(F.collect_set("shingle")).alias("all"))
    n = F.size("all")
    upper = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")
    missed = lambda size: size - F.ceil(F.round(size * CONTAINMENT, 6)).cast("int")
    # u - ceil(t * u) can be under n - ceil(t * n) by rounding; the larger of the two holds for both
    most = F.greatest(missed(upper), missed(n))
    sketch = F.slice("all", F.lit(1), F.least(n, 2 * most + 1))
    # the smallest item of the class has over upper / 2 shingles; so many windows need a word each
    least = F.ceil(F.round((F.floor(upper / 2) + 1) * CONTAINMENT, 6)).cast("int")
    return hashed.select("item_id", F.explode(sketch).alias("shingle"), F.greatest(F.lit(1), F.least(n, 2 * most + 1) - missed(n)).alias("needed"), least.alias("least_words"))


def contained_items(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared)`` of ``docs(doc_id, text)`` that contain at least
    0.8 of the distinct five-word shingles of an item of ``items(item_id, text)``.

    Words are runs of letters and digits in lower case. An item of fewer words is one shingle, all
    of it, and is found wherever these words follow each other. Null and empty texts contain
    nothing and are contained nowhere; rows with a null id are left out; rows that repeat an id
    are one document or item with the shingles of all its rows, a short row of an item being one
    shingle, but a document's row with fewer words than its size class needs adds nothing to the
    search in it. Other columns are ignored. No rows on either side give none. ``broadcast_rows``
    changes the plan only.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    split = lambda frame: frame.select("doc_id", normal_words(F.col("text")).alias("words"))
    items = checkpointed(items.where("item_id is not null").select("item_id", normal_words(F.col("text")).alias("words")))
    widths = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n").between(1, SHINGLE - 1)).distinct().collect()]
    small = lambda frame, most: F.broadcast(frame) if frame.count() <= most else frame

    sketches = checkpointed(_sketches(items))
    found = _of_documents(split(texts), widths, _hash).join(small(sketches, broadcast_rows), "shingle").where("n_words >= least_words")
    found = found.groupBy("doc_id", "item_id", "shingle").agg(F.first("needed").alias("needed")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    candidates = checkpointed(found.where("n >= needed").select("doc_id", "item_id"))

    exact = checkpointed(_of_items(items, _string).distinct())
    sizes = exact.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    ids = checkpointed(candidates.select("doc_id").distinct())
    named = split(texts.join(small(ids, 10 * broadcast_rows), "doc_id", "left_semi"))
    shared = _of_documents(named, widths, _string).join(small(exact, broadcast_rows), "shingle").select("doc_id", "item_id", "shingle").distinct()
    shared = shared.join(candidates, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    return shared.join(sizes, "item_id").where(F.col("n_shared") * 10 >= F.col("n_shingles") * round(CONTAINMENT * 10)).select("doc_id", "item_id", "n_shingles", "n_shared")


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that contain no item, as they are; rows with a null doc_id stay."""
    return docs.join(contained_items(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_spread(spark, sf_dir, "documents", "doc_id"), read_table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), widths AS (
  SELECT 5 AS k UNION SELECT len(w) FROM words WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, widths WHERE kind = 'd' OR k = least(len(w), 5))
), sizes AS (
  SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared FROM shared JOIN sizes ON item_id = sizes.id WHERE n_shared * 10 >= n_shingles * 8
"""
