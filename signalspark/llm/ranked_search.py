"""Ranked lexical search: the best documents of every query item, by windowed bucket scoring.

Documents are indexed in windows of at most ``WINDOW`` consecutive rows of a task: a window holds
the posting lists (slot in the window, occurrences) of those terms that some item asks for. An
item is scored in one window after the other: its posting lists are traversed, each adds its
scores at its slots into an array of 64-bit sums that fits a core's cache, a bitset tells which
blocks of 64 slots were touched, and only these are harvested into the item's heap of the best.
So no pair of an item and a document is ever a row; a task sends its heaps only.

The index is written to the checkpoint folder and read twice, for the document frequencies and
for the scores. Items are dealt to blocks of a bounded number of terms; each block has an index
of its own terms, so what a task is sent has a bound that no number of items changes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, lower_ascii, read_spread, read_table
from .wordarrays import Words, slices

#: Documents of a window: its sums take 32 kB, which is a core's first cache.
WINDOW = 4096
BLOCK = 64
BEST = 50
#: Terms of items (with repeats) that are searched for at once: about 20 bytes each for every task.
BLOCK_TERMS = 200_000
#: Heaps of tasks are merged in two steps; the first deals an item's over so many tasks.
MERGES = 64

_BYTES = np.arange(256)
#: Bytes of terms: ASCII letters and digits, and all of other characters.
TERM_BYTES = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
TERM_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX_SCHEMA = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, counts binary, slots binary, tfs binary"


def terms_of(text: Column) -> Column:
    """Distinct terms of ``text``; none for a null text."""
    return F.array_distinct(F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), TERM_SEPARATORS), lambda t: t != ""))


class _Terms:
    """The terms of a block of items, found by two hashes of 64 bits each."""

    def __init__(self, terms: list[str]):
        words = Words(pa.array(terms, pa.string()), TERM_BYTES)
        first, second = words.hashes(), words.hashes(1)
        order = np.argsort(first)
        self.first, self.second, self.number = first[order], second[order], order

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the numbers of these terms."""
        if not len(self.first) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(self.first, hashes), len(self.first) - 1)
        found = np.flatnonzero((self.first[place] == hashes) & (self.second[place] == words.hashes(1)))
        return found, self.number[place[found]]


def _indexed(ids: pa.Array, texts: pa.Array, terms: _Terms) -> dict:
    """One window: all documents' ids and lengths, and the posting lists in the order of terms."""
    lengths, keys, tfs = [], [], []
    for at, to in slices(texts):
        words = Words(texts.slice(at, to - at), TERM_BYTES, lower=True)
        lengths.append(words.count)
        found, number = terms.find(words)
        key, tf = np.unique(number << 16 | (words.doc[found] + at), return_counts=True)
        keys.append(key)
        tfs.append(tf)
    length, key, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, keys, tfs))
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    listed, counts = np.unique(key >> 16, return_counts=True)
    return {
        "n_docs": int((length > 0).sum()),
        "n_terms": int(length.sum()),
        "ids": np.asarray(ids, np.int64).tobytes(),
        "lengths": length.astype(np.int64).tobytes(),
        "terms": listed.astype(np.int32).tobytes(),
        "counts": counts.astype(np.int32).tobytes(),
        "slots": (key & 0xFFFF).astype(np.uint16).tobytes(),
        "tfs": tf.astype(np.uint32).tobytes(),
    }


def index_windows(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Windows of the index of ``docs(doc_id, text)`` for ``terms``; rows with a null id are left out."""
    known = _Terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                yield pa.RecordBatch.from_pylist([_indexed(part.column(0), part.column(1), known)])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA)


def document_frequencies(index: DataFrame) -> DataFrame:
    """``(term, df)`` by the terms' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))], names=["term", "df"])

    return index.select("terms", "counts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Heaps:
    """The best documents of each item so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, best: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.best = items, weights, n_docs, n_terms, best
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        self.sums = np.zeros(-(-WINDOW // BLOCK) * BLOCK, np.int64)
        self.touched = np.zeros(len(self.sums) // BLOCK, bool)

    def add(self, row: dict) -> None:
        ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        listed, counts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["counts"], np.int32)
        slots, tf = np.frombuffer(row["slots"], np.uint16).astype(np.int64), np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        if not len(listed):
            return
        m = 100 - 50 + (50 * lengths * self.n_docs) // self.n_terms
        value = np.repeat(self.weights[listed], counts) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[slots]))
        place = np.full(len(self.weights), -1, np.int64)
        place[listed] = np.arange(len(listed))
        ends = np.concatenate([[0], np.cumsum(counts)])
        blocks = slots // BLOCK
        sums, touched = self.sums, self.touched
        for terms, heap in zip(self.items, self.heaps, strict=True):
            lists = place[terms]
            for k in lists[lists >= 0]:
                at, to = ends[k], ends[k + 1]
                sums[slots[at:to]] += value[at:to]
                touched[blocks[at:to]] = True
            used = np.flatnonzero(touched)
            if len(used):
                self._harvest(heap, used, ids)
                sums.reshape(-1, BLOCK)[used] = 0
                touched[used] = False

    def _harvest(self, heap: list[tuple[int, int]], used: np.ndarray, ids: np.ndarray) -> None:
        slots = (used[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        scores = self.sums[slots]
        good = scores >= (heap[0][0] if len(heap) == self.best else 1)
        scores, found = scores[good], ids[slots[good]]
        if len(scores) > self.best:
            order = np.lexsort((found, -scores))[: self.best]
            scores, found = scores[order], found[order]
        for entry in zip(scores.tolist(), (~found).tolist(), strict=True):  # ~id falls as the id grows, and never overflows
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block_scores(docs: DataFrame, pairs: DataFrame, best: int) -> DataFrame:
    """``(item, doc_id, score, item_id)``: the heaps of all tasks for the items of one block."""
    rows = pairs.collect()
    terms = sorted({r["term"] for r in rows})
    number = {t: k for k, t in enumerate(terms)}
    wanted: dict[object, list[int]] = {}
    for r in rows:
        wanted.setdefault(r["item_id"], []).append(number[r["term"]])
    names = sorted(wanted)
    index = checkpointed(index_windows(docs, terms))
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(terms), np.int64)
    for r in document_frequencies(index).collect():
        weights[r["term"]] = _weight(r["df"], n_docs)
    items = [np.array(wanted[name]) for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(items, weights, n_docs, n_terms, best)
        for batch in batches:
            for row in batch.to_pylist():
                heaps.add(row)
        out = [(k, score, ~inverse) for k, heap in enumerate(heaps.heaps) for score, inverse in heap]
        item, score, doc = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc), pa.array(score)], names=["item", "doc_id", "score"])

    found = index.select("ids", "lengths", "terms", "counts", "slots", "tfs").mapInArrow(run, "item int, doc_id long, score long")
    kind = pairs.schema["item_id"].dataType
    ids = docs.sparkSession.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
    return found.join(F.broadcast(ids), "item")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of ``docs(doc_id, text)`` for each
    item of ``items(item_id, text)``, of those with a score above 0, equal scores by doc_id.

    Rows with a null id, on either side, are left out. Rows of items that repeat an id are one item
    with the terms of all; rows of documents that repeat one are a document each, and stand in
    the result as often as they rank. A null text has no terms. No rows on either side, or no term
    that both have, give no rows. Other columns are ignored. ``block_terms`` bounds what a task is
    sent and changes no result: more items than it are searched for in several passes.
    """
    spark = docs.sparkSession
    pairs = items.where("item_id is not null").select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    pairs = checkpointed(pairs)
    blocks = -(-pairs.count() // block_terms)
    best_of = []
    for k in range(blocks):
        found = _block_scores(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), best)
        best_of.append(found.select("item_id", "doc_id", "score", F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")))
    if not best_of:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    found = best_of[0]
    for more in best_of[1:]:
        found = found.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id")]
    for group in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= best)
    return found.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
), sizes AS (
  SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), postings AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
