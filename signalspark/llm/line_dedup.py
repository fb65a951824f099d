"""Removal of line runs that an earlier place in the corpus also has, by prefix doubling.

Every document is a sequence of line ids (128-bit hashes of the stripped lines; blank lines are
not part of it). A sequence that equals an earlier document's is one whole run; the others make the
suffix array. Round k of the doubling ranks the suffixes by their first ``2**k`` lines: a rank is made
from the two ranks of half its length, and named by the first place that has it, so equal ranks are one
interval of the suffix array. Only suffixes in an interval of two or more go on to the next round; most
lines are unique and leave at once, and rounds are as many as the longest repeat has binary digits.

Longest common prefixes come from the same ranks, from the highest power down: an interval of common
prefix L is cut by the rank of ``2**j`` lines behind these L into intervals of ``L + 2**j``, and of each
of these the first place also stays behind, for the shorter powers. So every suffix ends in the deepest
interval that begins at an earlier place: its L lines are the longest run from there that stands
earlier. The runs that the line before doesn't belong to as well are maximal; those of ``min_words``
words are what is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXTS, Scratch, checkpointed, join_counted, read_spread

_AT = ["doc_id", "version", "i"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word: place, 128-bit id, how many lines on from it have ``min_words``
    words (0: there are too few), and the number of the document's lines; a document's first line has the
    128-bit id of the whole sequence too."""
    fields = [("doc_id", pa.int64()), ("version", pa.int64()), ("i", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("ahead", pa.int32()), ("lines", pa.int32()), ("all_h", pa.int64()), ("all_g", pa.int64())]
    schema = pa.schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [s for s in map(bytes.strip, text.encode().split(b"\n")) if s]
                words = np.cumsum([0, *(len(s.split()) for s in lines)])
                n = len(lines)
                if not n:
                    continue
                ahead = np.searchsorted(words, words[:-1] + min_words) - np.arange(n)
                ahead[ahead > n - np.arange(n)] = 0
                ids = [xxhash.xxh3_128_intdigest(s) for s in lines]
                whole, none = xxhash.xxh3_128_intdigest(b"\n".join(lines)), [None] * (n - 1)
                high, low = ([_signed(x >> 64) for x in ids], [_signed(x & (1 << 64) - 1) for x in ids])
                cells = ([doc_id] * n, [version] * n, range(n), high, low, ahead, [n] * n, [_signed(whole >> 64), *none], [_signed(whole & (1 << 64) - 1), *none])
                for column, values in zip(out, cells, strict=True):
                    column.extend(values)
                if len(out[0]) > 100_000:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)
                    out = [[] for _ in fields]
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)

    return docs.mapInArrow(rows, "doc_id long, version long, i int, h long, g long, ahead int, lines int, all_h long, all_g long")


def _copies(lines: DataFrame) -> DataFrame:
    """``(doc_id, version, lines, ahead, first)``: documents of the same sequence as an earlier one, the
    first such place, and whether it has words enough (``ahead``)."""
    whole = lines.where("i = 0").select("doc_id", "version", "all_h", "all_g", "lines", "ahead").distinct()
    first = whole.groupBy("all_h", "all_g").agg(F.min(F.struct("doc_id", "version")).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    place = F.struct("earliest.doc_id", "earliest.version", F.lit(0).alias("i")).alias("first")
    found = join_counted(whole, first, ["all_h", "all_g"])
    return found.where(F.col("earliest") != F.struct("doc_id", "version")).select("doc_id", "version", "lines", "ahead", place)


def _levels(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """``(doc_id, version, i, rank, next)`` by level: places whose first ``2**level`` lines recur, the first
    place of these, and that of twice as many lines, where these recur too."""
    first = scratch.write(lines.groupBy("h", "g").agg(F.min(F.struct(_AT)).alias("rank"), F.count("*").alias("n")).where("n > 1"))
    current = scratch.write(join_counted(lines, first, ["h", "g"]).select(*_AT, "rank").distinct())
    levels: list[DataFrame] = []
    while True:
        size = 1 << len(levels)
        behind = Window.partitionBy("doc_id", "version").orderBy("i").rangeBetween(size, size)
        pairs = scratch.write(current.select(*_AT, "rank", F.first("rank").over(behind).alias("tail")))
        ended, paired = pairs.where("tail is null"), pairs.where("tail is not null")
        groups = scratch.write(paired.groupBy("rank", "tail").agg(F.min(F.struct(_AT)).alias("next"), F.count("*").alias("n")).where("n > 1"))
        none = F.lit(None).cast(groups.schema["next"].dataType).alias("next")
        if groups.isEmpty():
            return [*levels, current.select(*_AT, "rank", none)]
        longer = join_counted(paired, groups, ["rank", "tail"], how="left").select(*_AT, "rank", "next")
        levels.append(scratch.write(longer.unionByName(ended.select(*_AT, "rank", none))))
        current = levels[-1].where("next is not null").select(*_AT, F.col("next").alias("rank"))


def _begun(levels: list[DataFrame], level: int) -> DataFrame:
    """``(doc_id, version, i, length, first)``: the intervals of ``2**level`` lines, of each longer interval
    inside one only the first place."""
    stays = F.col("next").isNull() | (F.col("next") == F.struct(_AT))
    return levels[level].where(stays).select(*_AT, F.lit(1 << level).alias("length"), F.col("rank").alias("first"))


def _longest_repeats(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``(doc_id, version, i, length, first)``: for each place whose line also stands earlier the longest
    run from it on that does, and that run's first place."""
    open_ = _begun(levels, len(levels) - 1)
    for level in range(len(levels) - 2, -1, -1):
        behind = levels[level].select("doc_id", "version", F.col("i").alias("at"), F.col("rank").alias("behind"))
        cut = scratch.write(open_.withColumn("at", F.col("i") + F.col("length")).join(behind, ["doc_id", "version", "at"], "left").drop("at"))
        ended, going = cut.where("behind is null"), cut.where("behind is not null")
        key = ["length", "first", "behind"]
        groups = scratch.write(going.groupBy(key).agg(F.min(F.struct(_AT)).alias("least"), F.count("*").alias("n")).where("n > 1"))
        # a place that isn't the first of its longer interval goes on in that only, the first in both
        stays = F.when(F.col("least").isNull() | (F.col("least") == F.struct(_AT)), F.struct("length", "first"))
        goes = F.when(F.col("least").isNotNull(), F.struct((F.col("length") + (1 << level)).alias("length"), F.col("least").alias("first")))
        gone_on = join_counted(going, groups, key, how="left").select(*_AT, F.explode(F.array_compact(F.array(stays, goes))).alias("to")).select(*_AT, "to.length", "to.first")
        open_ = scratch.write(gone_on.unionByName(ended.drop("behind"))).unionByName(_begun(levels, level))
    return open_.where(F.col("first") != F.struct(_AT)).groupBy(*_AT).agg(F.max("length").alias("length"), F.max_by("first", "length").alias("first"))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """``(doc_id, version, i, length, first)``: maximal runs of ``length`` lines from line ``i`` on that also
    stand earlier and have words enough, ``first`` being the first place that the whole run stands at.

    A run is maximal if neither it with the line before nor it with the line after stands earlier as
    one. No lines give no runs.
    """
    with Scratch(lines.sparkSession) as scratch:
        lines = scratch.write(lines)
        copies = scratch.write(_copies(lines))
        own = scratch.write(lines.join(copies.select("doc_id", "version"), ["doc_id", "version"], "left_anti").select(*_AT, "h", "g", "ahead"))
        runs = _longest_repeats(_levels(own, scratch), scratch)
        order = Window.partitionBy("doc_id", "version").orderBy("i")
        before = F.when(F.lag("i").over(order) == F.col("i") - 1, F.lag("length").over(order))
        maximal = runs.withColumn("maximal", F.coalesce(before <= F.col("length"), F.lit(True))).where("maximal").drop("maximal")
        enough = own.where("ahead > 0").select(*_AT, "ahead").distinct()
        found = maximal.join(enough, _AT).where("length >= ahead").drop("ahead")
        whole = copies.where("ahead > 0").select("doc_id", "version", F.lit(0).alias("i"), F.col("lines").alias("length"), "first")
        return checkpointed(found.unionByName(whole))


def _kept(text: Column, windows: Column) -> Column:
    """Struct of the numbers of lines, the removed lines' numbers, and the text that is left."""

    kinds = {"n_lines": pa.int64(), "removed_lines": pa.list_(pa.int32()), "text": pa.string()}

    def one(text: str | None, spans: list[dict] | None) -> tuple[int, list[int], str | None]:
        lines = text.split("\n") if text is not None else []
        full = [k for k, s in enumerate(lines) if s.strip(" \t\n\x0b\x0c\r")]
        gone: set[int] = set()
        for span in spans or ():
            gone.update(full[span["i"] : span["i"] + span["length"]])
        return len(full), sorted(gone), "\n".join(s for k, s in enumerate(lines) if k not in gone) if gone else text

    @F.arrow_udf("n_lines long, removed_lines array<int>, text string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            parts = []
            for at in range(0, max(len(texts), 1), TEXTS):
                rows = [one(*r) for r in zip(texts.slice(at, TEXTS).to_pylist(), ranges.slice(at, TEXTS).to_pylist(), strict=True)]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                parts.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)))
            yield pa.concat_arrays(parts)

    return cut(text, windows)


def remove_repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` with line runs gone that also stand earlier, and with columns
    ``n_lines`` (with a word) and ``removed_lines`` (0-based numbers), which replace any of that name.

    A run is consecutive lines of one document, blank ones aside, with ``min_words`` words at
    least; lines are compared without surrounding white space. Every copy but the one at the
    smallest (doc_id, line) goes, within a document too. Blank lines, null and empty texts stay
    as they are. Rows that repeat doc_id and text count as one place and keep the same lines;
    a doc_id with several texts orders them by a hash. Rows with a null doc_id stay unchanged.
    """
    docs = docs.drop("n_lines", "removed_lines")
    version = F.xxhash64("text")
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), version.alias("version"), "text")
    spans = repeated_runs(_lines(named, min_words)).groupBy("doc_id", "version").agg(F.collect_set(F.struct("i", "length")).alias("__spans")).withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col("__id")) & (version == F.col("__version")), "left")
    done = joined.withColumn("__cut", _kept(F.col("text"), F.col("__spans")))
    return done.select(*(F.col("__cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), "__cut.n_lines", "__cut.removed_lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_lines(read_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), every AS (
  SELECT doc_id, unnest(range(len(lines))) AS k, unnest(lines) AS raw FROM split
), full_lines AS (
  SELECT doc_id, k, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i
  FROM every WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM full_lines
), equal AS (
  SELECT a.doc_id AS early, b.doc_id, b.i, b.k, b.words, b.i - a.i AS shift
  FROM counted a JOIN counted b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY early, doc_id, shift ORDER BY i) AS run FROM equal
), weighed AS (
  SELECT doc_id, k, sum(words) OVER (PARTITION BY early, doc_id, shift, run) AS total FROM runs
), gone AS (
  SELECT DISTINCT doc_id, k FROM weighed WHERE total >= 5
)
SELECT e.doc_id,
       CAST(count(*) FILTER (WHERE regexp_matches(e.raw, '[^\x20\x09-\x0D]')) AS BIGINT) AS n_lines,
       CAST(count(g.k) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(e.raw, chr(10) ORDER BY e.k) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k
GROUP BY e.doc_id
"""
