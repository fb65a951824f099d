"""Phrase collocation mining with depth-limited count tries.

Every task counts the phrases of up to ``DEPTH`` words of its documents in one trie per language: level k
holds the distinct phrases of k words, each as its parent's number and its last word, in order, with
its count. Nothing is pruned, so counts are exact at any size. Tries are cut by prefix ranges and
serialised sorted; the pieces of one range, one of each shard, are merged k ways into one trie.

Ranges are bounded by phrases and not only by words, so a word that begins a third of all phrases
has many ranges. A piece brings along the counts of its lower bound's own prefixes, which lie in
earlier ranges, so a walk through a merged trie meets the first part of every phrase on its way
down. The rest of a phrase, its suffix link, leads to another range: that is a join, for the few
phrases that are frequent.

Ranges take some ``RANGE_BYTES`` of text each, up to ``MOST_RANGES`` of them; their bounds come from a
sample of phrases, which decides where work is done and changes no count. From
``RANGE_BYTES * MOST_RANGES`` of text on (120 GB) ranges grow with the text instead, and so does what a merging task holds.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, read_spread
from .wordarrays import Words, slices

DEPTH = 4
LEAST = 30
BEST = 2000
#: A longer candidate that stands for so many hundredths of a phrase's occurrences takes its place.
COVERED = 80

RANGE_BYTES = 6_000_000
MOST_RANGES = 20_000
#: Nodes that a task holds before its tries are sent (16 bytes each, and as much again when merged).
SHARD_NODES = 3_000_000
#: Documents and phrases of each that the sample takes for a range.
SAMPLE_DOCUMENTS, SAMPLE_PHRASES = 8, 4

_BYTES = np.arange(256)
BREAKS = np.isin(_BYTES, [*b".,;:!?\n\x0b\x0c\r"])
PHRASE_BYTES = ~(BREAKS | (_BYTES == 0x20) | (_BYTES == 0x09))
LOW = np.int64(0xFFFFFFFF)

PIECE_SCHEMA = "lang string, range int, trie binary"
COUNT_SCHEMA = "lang string, k int, phrase string, a long, lefts array<long>"


class Trie:
    """Counts of phrases: ``words`` in byte order, and for each level the nodes' ``keys`` (the
    parent's number on the level above, shifted by 32 bits, and the last word's) and ``counts``.
    ``path`` has, by level, whether the first node is only a prefix of the range's bound."""

    def __init__(self, words: list[bytes], keys: list[np.ndarray], counts: list[np.ndarray], path: list[bool] | None = None):
        self.words, self.keys, self.counts = words, keys, counts
        self.path = path or [False] * len(keys)

    def __len__(self) -> int:
        return sum(map(len, self.keys))

    @classmethod
    def of_texts(cls, texts: pa.Array) -> Trie:
        words = Words(texts, PHRASE_BYTES, lower=True)
        _, first, ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
        strings = words.strings(first)
        order = sorted(range(len(strings)), key=strings.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = rank[ids]
        breaks = words.before(BREAKS)
        new = np.ones(len(ids), bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (breaks[1:] != breaks[:-1])
        piece = np.cumsum(new)
        keys, counts, node = [np.arange(len(order))], [np.bincount(ids, minlength=len(order))], ids
        for k in range(1, DEPTH):
            at = np.flatnonzero(piece[:-k] == piece[k:])
            key, inverse, count = np.unique(node[at] << 32 | ids[at + k], return_inverse=True, return_counts=True)
            node = np.zeros(len(ids), np.int64)
            node[at] = inverse
            keys.append(key)
            counts.append(count)
        return cls([strings[k] for k in order], keys, counts)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie of many, level by level: equal children of equal parents are one node."""
        if len(tries) == 1:
            return tries[0]
        words = sorted(set().union(*(t.words for t in tries)))
        number = {w: k for k, w in enumerate(words)}
        ranks = [np.fromiter((number[w] for w in t.words), np.int64, len(t.words)) for t in tries]
        nodes, keys, counts = [np.zeros(1, np.int64)] * len(tries), [], []
        for k in range(DEPTH):
            key = np.concatenate([node[t.keys[k] >> 32] << 32 | rank[t.keys[k] & LOW] for t, node, rank in zip(tries, nodes, ranks, strict=True)])
            count = np.concatenate([t.counts[k] for t in tries])
            order = np.argsort(key, kind="stable")  # the runs are sorted, so this merges them
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            keys.append(key[new])
            counts.append(np.add.reduceat(count[order], np.flatnonzero(new)) if len(key) else count)
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            nodes = np.split(inverse, np.cumsum([len(t.keys[k]) for t in tries])[:-1])
        return cls(words, keys, counts, [any(t.path[k] for t in tries) for k in range(DEPTH)])

    def cut(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Trie]]:
        """``(range, trie)`` of the parts between ``bounds``: range r is from bound r - 1 up to, not
        including, bound r. A part also has the nodes that are prefixes of its lower bound."""
        low, high = [], []  # by level, first of the nodes that aren't below each bound; the same without its proper prefixes
        length = np.array([len(b) for b in bounds], np.int64)
        at, exact = np.zeros(len(bounds), np.int64), np.ones(len(bounds), bool)
        for k in range(DEPTH):
            word = np.array([bisect.bisect_left(self.words, b[k]) if len(b) > k else 0 for b in bounds], np.int64)
            known = np.array([len(b) > k and word[i] < len(self.words) and self.words[word[i]] == b[k] for i, b in enumerate(bounds)], bool)
            inside = exact & (length > k)
            key = (at << 32) | np.where(inside, word, 0)
            at = np.searchsorted(self.keys[k], key)
            exact = inside & known & (self.keys[k][np.minimum(at, max(len(self.keys[k]) - 1, 0))] == key if len(self.keys[k]) else False)
            low.append(np.concatenate([[0], at, [len(self.keys[k])]]))
            high.append(np.concatenate([[0], at + (exact & (length > k + 1)), [len(self.keys[k])]]))
        for r in range(len(bounds) + 1):
            spans = [(int(low[k][r]), int(high[k][r + 1])) for k in range(DEPTH)]
            if not any(b > a for a, b in spans):
                continue
            used = np.unique(np.concatenate([self.keys[k][a:b] & LOW for k, (a, b) in enumerate(spans)]))
            keys, before = [], 0
            for k, (a, b) in enumerate(spans):
                keys.append(((self.keys[k][a:b] >> 32) - before) << 32 | np.searchsorted(used, self.keys[k][a:b] & LOW))
                before = a
            path = [bool(high[k][r] > low[k][r]) for k in range(DEPTH)]
            yield r, Trie([self.words[w] for w in used], keys, [self.counts[k][a:b] for k, (a, b) in enumerate(spans)], path)

    def packed(self) -> bytes:
        """Sorted keys as differences; the bytes of equal weight stand together, as most are zero."""
        parts = [np.array([*map(len, self.keys), *self.path], np.int64).tobytes()]
        for key, count in zip(self.keys, self.counts, strict=True):
            for column in (np.diff(key >> 32, prepend=0), key & LOW, count):
                parts.append(np.ascontiguousarray(column, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())
        return zstandard.compress(b"".join([*parts, b"\n".join(self.words)]), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        data = zstandard.decompress(data)
        head = np.frombuffer(data, np.int64, 2 * DEPTH)
        at, keys, counts = head.nbytes, [], []
        for n in head[:DEPTH].tolist():
            parent, word, count = (np.frombuffer(data, np.uint8, 8 * n, at + 8 * n * k).reshape(8, -1).T.copy().view(np.int64).ravel() for k in range(3))
            keys.append(np.cumsum(parent) << 32 | word)
            counts.append(count)
            at += 24 * n
        return cls(data[at:].split(b"\n") if at < len(data) else [], keys, counts, head[DEPTH:].astype(bool).tolist())

    def frequent(self, least: int) -> Iterator[tuple[int, bytes, int, list[int]]]:
        """``(k, phrase, count, counts of its first 1 to k - 1 words)``, walking up from each phrase
        of at least ``least`` occurrences that the range owns."""
        for k in range(DEPTH):
            owned = self.counts[k].copy()
            owned[: self.path[k]] = 0
            for node in np.flatnonzero(owned >= least).tolist():
                words, lefts, at = [], [], node
                for level in range(k, -1, -1):
                    key = int(self.keys[level][at])
                    words.append(self.words[key & 0xFFFFFFFF])
                    if level < k:
                        lefts.append(int(self.counts[level][at]))
                    at = key >> 32
                yield k + 1, b" ".join(reversed(words)), int(owned[node]), lefts[::-1]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Texts of a batch by language, some of them at a time."""
    for lang in pc.unique(batch.column(0)).to_pylist():
        texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
        for at, to in slices(texts):
            yield lang, texts.slice(at, to - at)


def range_bounds(texts: DataFrame, range_bytes: int) -> dict[str, list[tuple[bytes, ...]]]:
    """Bounds of the prefix ranges of each language of ``texts(lang, text)``."""
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).collect()
    range_bytes = max(range_bytes, sum(r["size"] or 0 for r in sizes) // MOST_RANGES)
    ranges = {r["lang"]: -(-(r["size"] or 0) // range_bytes) for r in sizes}
    share = min(1.0, SAMPLE_DOCUMENTS * sum(ranges.values()) / max(1, sum(r["n"] for r in sizes)))
    if all(n < 2 for n in ranges.values()):
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = [], []
            for lang, part in _by_language(batch):
                words = Words(part, PHRASE_BYTES, lower=True)
                breaks = words.before(BREAKS)
                for doc in np.flatnonzero(words.count):
                    for i in range(SAMPLE_PHRASES):
                        at = words.first[doc] + words.count[doc] * (2 * i + 1) // (2 * SAMPLE_PHRASES)
                        to = at
                        while to < min(words.first[doc + 1], at + DEPTH) and breaks[to] == breaks[at]:
                            to += 1
                        langs.append(lang)
                        phrases.append(b"\n".join(words.strings(np.arange(at, to))))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary())})

    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found: dict[str, list[tuple[bytes, ...]]] = {}
    for row in sampled.mapInArrow(run, "lang string, phrase binary").distinct().collect():
        found.setdefault(row["lang"], []).append(tuple(bytes(row["phrase"]).split(b"\n")))
    bounds = {}
    for lang, phrases in found.items():
        phrases.sort()
        n = ranges[lang]
        bounds[lang] = sorted({phrases[len(phrases) * k // n] for k in range(1, n)})
    return bounds


def phrase_counts(texts: DataFrame, least: int = LEAST, range_bytes: int = RANGE_BYTES, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``(lang, k, phrase, a, lefts)``: phrases of k = 1 to 4 words that ``texts(lang, text)`` have
    ``least`` times or more, with the counts of their first 1 to k - 1 words; and rows with k = 0
    and no phrase, whose sum of ``a`` by language is the number of all words."""
    bounds = range_bounds(texts, range_bytes)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Trie]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, tries in held.items():
                for number, part in Trie.merged(tries).cut(bounds.get(lang, [])):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number], pa.int32()), pa.array([part.packed()], pa.binary())], names=["lang", "range", "trie"])
            held.clear()

        for batch in batches:
            for lang, part in _by_language(batch):
                tries = held.setdefault(lang, [])
                tries.append(Trie.of_texts(part))
                while len(tries) > 1 and len(tries[-1]) * 2 > len(tries[-2]):  # tries of like size are merged, as a counter carries
                    tries[-2:] = [Trie.merged(tries[-2:])]
                if sum(len(t) for each in held.values() for t in each) > shard_nodes:
                    yield from sent()
        yield from sent()

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        trie = Trie.merged([Trie.unpacked(p.as_py()) for p in pieces.column("trie")])
        rows = list(trie.frequent(least))
        rows.append((0, None, int(trie.counts[0][trie.path[0] :].sum()), []))
        k, phrase, a, lefts = zip(*rows, strict=True)
        phrase = [None if p is None else p.decode() for p in phrase]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "k": pa.array(k, pa.int32()), "phrase": pa.array(phrase, pa.string()), "a": pa.array(a, pa.int64()), "lefts": pa.array(lefts, pa.list_(pa.int64()))})

    pieces = texts.select("lang", "text").mapInArrow(shards, PIECE_SCHEMA)
    n_ranges = max(1, sum(len(b) + 1 for b in bounds.values()))
    return pieces.repartition(n_ranges, "lang", "range").groupBy("lang", "range").applyInArrow(merge, COUNT_SCHEMA)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, range_bytes: int = RANGE_BYTES, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``best`` phrases of 2 to 4 words of each
    language of ``docs(lang, text)``.

    A null lang is ``und``, a null text empty; rows that repeat count as often as they stand; other
    columns are ignored, and no rows, or no phrase of ``least`` occurrences, give none. A phrase is
    cut where its score 2,000,000 * a / (l + r), rounded down, is least (l and r being counts of its
    parts), at the first such place; phrases inside a longer candidate of four fifths of their
    occurrences are dropped. Equal scores are ordered by a, then by the phrase's bytes.
    ``range_bytes`` and ``shard_nodes`` change the plan only.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = checkpointed(phrase_counts(texts, least, range_bytes, shard_nodes))
    totals = counts.where("k = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = counts.where("k > 0")
    words = F.split("phrase", " ")
    candidates = frequent.where("k > 1").select("lang", "k", "phrase", "a", "lefts", words.alias("words"))

    cuts = candidates.select("lang", "phrase", "a", "words", F.posexplode("lefts").alias("place", "l"))
    cuts = cuts.select("lang", "phrase", "a", "l", (F.col("place") + 1).alias("cut"), F.concat_ws(" ", F.slice("words", F.col("place") + 2, F.size("words"))).alias("rest"))
    scored = cuts.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)"))
    scored = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.concat_ws(" ", F.slice("words", i, n)))))
    inside = candidates.where("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))

    kept = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {COVERED} * x.a")
    kept = kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for group in (["lang", "part"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= best)
    return kept.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_spread(spark, sf_dir, "documents", "doc_id").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*)::BIGINT AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k)) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, ((c.a::HUGEINT * 2000000) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 4) t(m) WHERE m < k) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM scored LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
