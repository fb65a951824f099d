"""Removal of word passages that an earlier document also has, by difference-cover anchors.

A window is ``WINDOW`` consecutive words. The residues ``COVER`` modulo ``PERIOD`` are a
difference cover: for any two positions i and j some shift below the period puts both on a
cover position. So two equal windows hold, at the same place inside both, an anchor of
``WINDOW - PERIOD + 1`` words that starts on a cover position of either document. Only anchors
are hashed and exchanged for all text (3 positions in 7); windows are hashed in full, with 96
bits, only around anchors that more than one document has.

Texts are dealt to parts by a hash of doc_id. A part sends each distinct hash once, a
window's with the smallest doc_id that has it, so a passage that a third of all documents share costs one entry
a part, not one a document or a pair. A part's hashes for one bucket are one row, and there are an
eighth as many buckets as parts. Rows are so at most parts times buckets and at most anchors,
whichever is less: with parts of 64 MB, 100 TB of text are 1.6 million parts and 3 * 10^11 rows of
some twenty hashes each, which is what the hashes themselves come to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .wordarrays import Words, slices

PERIOD = 7
COVER = (1, 2, 4)  # fixed value: every residue modulo 7 is a difference of two of these

#: Bytes of text that a part has, about: a task holds one part's text, whatever the size of the corpus.
PART_BYTES = 10_000_000
#: A bucket takes the hashes of so many parts' worth of text: it holds 6 to 20 bytes a hash and no text.
PARTS_A_BUCKET = 8

#: An anchor's hash only has to find candidates; 48 bits of it do.
_ANCHOR, _ANCHOR_BYTES = np.dtype("<u8"), 6
_WINDOW, _WINDOW_BYTES = np.dtype([("a", "<u8"), ("b", "<u8")]), 12
_DOC = np.dtype("<i8")

_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("several", pa.binary())])
_SENT_SQL = "bucket int, part int, n int, keys binary, docs binary, several binary"
_REPLY = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
_REPLY_SQL = "part int, n int, keys binary, docs binary"


def _packed(values: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of each value, all first bytes first: that compresses well."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize)[:, :width].T.tobytes()


def _unpacked(blobs: list[bytes], sizes: list[int], dtype: np.dtype, width: int) -> np.ndarray:
    out = np.zeros((sum(sizes), dtype.itemsize), np.uint8)
    at = 0
    for blob, n in zip(blobs, sizes, strict=True):
        out[at : at + n, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
        at += n
    return out.view(dtype).reshape(-1)


def _anchored(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each anchor of the slice."""
    keys, whole = words.windows(hashes, width - PERIOD + 1)
    at = np.flatnonzero(whole & np.isin(words.at[: len(keys)] % PERIOD, COVER))
    return keys[at] & np.uint64((1 << 8 * _ANCHOR_BYTES) - 1), at


def _window_keys(words: Words, hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    keys = np.zeros(len(at), _WINDOW)
    keys["a"] = words.windows(hashes, width)[0][at]
    keys["b"] = words.windows(words.hashes(1), width, 1)[0][at] & np.uint64(0xFFFFFFFF)
    return keys


def _order(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.lexsort((docs, keys["b"], keys["a"]) if keys.dtype == _WINDOW else (docs, keys))


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def _sent(part: int, buckets: int, found: list[tuple[np.ndarray, np.ndarray]], dtype: np.dtype) -> pa.Table:
    """One row a bucket: distinct hashes, the smallest document of this part that has each, and
    whether several have it. Anchors do without the documents."""
    keys = np.concatenate([np.zeros(0, dtype), *(k for k, _ in found)])
    docs = np.concatenate([np.zeros(0, _DOC), *(d for _, d in found)])
    order = _order(keys, docs)
    keys, docs = keys[order], docs[order]
    heads = _heads(keys)
    several = np.maximum.reduceat(docs, heads) > docs[heads] if len(heads) else np.zeros(0, bool)
    keys, docs = keys[heads], docs[heads]
    bucket = ((keys["a"] if dtype == _WINDOW else keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
    is_window = dtype == _WINDOW
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in rows], pa.int32()),
            "part": pa.array([part] * len(rows), pa.int32()),
            "n": pa.array([len(i) for _, i in rows], pa.int32()),
            "keys": pa.array([_packed(keys[i], _WINDOW_BYTES if is_window else _ANCHOR_BYTES) for _, i in rows], pa.binary()),
            "docs": pa.array([_packed(docs[i], 8) if is_window else b"" for _, i in rows], pa.binary()),
            "several": pa.array([np.packbits(several[i]).tobytes() for _, i in rows], pa.binary()),
        },
        schema=_SENT,
    )


def _several(table: pa.Table) -> np.ndarray:
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table["several"].to_pylist(), table["n"].to_pylist(), strict=True)]
    return np.concatenate(bits).astype(bool)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For a bucket: to each part, those of its anchors that several documents have."""
    parts, sizes = table["part"].to_pylist(), table["n"].to_pylist()
    keys = _unpacked(table["keys"].to_pylist(), sizes, _ANCHOR, _ANCHOR_BYTES)
    order = np.argsort(keys, kind="stable")
    heads = _heads(keys[order])
    counts = np.diff(np.append(heads, len(keys)))
    shared = np.empty(len(keys), bool)
    shared[order] = np.repeat((counts > 1) | np.logical_or.reduceat(_several(table)[order], heads), counts)
    return _replied(parts, sizes, keys, None, shared)


def _earlier_windows(table: pa.Table) -> pa.Table:
    """For a bucket: to each part, those of its windows that some document of it has after the
    smallest document of all, with that document."""
    parts, sizes = table["part"].to_pylist(), table["n"].to_pylist()
    keys = _unpacked(table["keys"].to_pylist(), sizes, _WINDOW, _WINDOW_BYTES)
    docs = _unpacked(table["docs"].to_pylist(), sizes, _DOC, 8)
    order = _order(keys, docs)
    heads = _heads(keys[order])
    least = np.empty(len(keys), _DOC)
    least[order] = np.repeat(docs[order][heads], np.diff(np.append(heads, len(keys))))
    return _replied(parts, sizes, keys, least, (docs > least) | _several(table))


def _replied(parts: list[int], sizes: list[int], keys: np.ndarray, docs: np.ndarray | None, wanted: np.ndarray) -> pa.Table:
    out: dict[str, list] = {"part": [], "n": [], "keys": [], "docs": []}
    at = 0
    for part, n in zip(parts, sizes, strict=True):
        mine = np.flatnonzero(wanted[at : at + n]) + at
        at += n
        if len(mine):
            out["part"].append(part)
            out["n"].append(len(mine))
            out["keys"].append(_packed(keys[mine], _ANCHOR_BYTES if docs is None else _WINDOW_BYTES))
            out["docs"].append(b"" if docs is None else _packed(docs[mine], 8))
    return pa.table(out, schema=_REPLY)


def _lookup(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is one of the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _slices_of(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array]]:
    texts, ids = table["text"].combine_chunks(), table["doc_id"].combine_chunks().to_numpy(zero_copy_only=False)
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    for a, b in slices(texts):
        yield ids[a:b], texts.slice(a, b - a)


def _part(*tables: pa.Table) -> int:
    return next(t["part"][0].as_py() for t in tables if t.num_rows)


def remove_repeated_passages(docs: DataFrame, window: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_words, removed_spans, kept_text)`` for every row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id. ``removed_spans`` are half-open word ranges; ``kept_text`` is the other words
    joined by single spaces. Windows are judged on the input. A null or empty text, or one
    shorter than the window, keeps all its words; rows with a null doc_id are left out, as they
    have no place in the order; rows that repeat a doc_id count as one document each way.
    Columns other than these two are ignored. ``window`` must be at least 7.
    ``part_bytes`` of text go to a part, about, whatever the corpus' size; it changes no result.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = docs.where("doc_id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(cores, -(-size // part_bytes))
    buckets = max(min(n, cores), n // PARTS_A_BUCKET)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))

    def anchors(table: pa.Table) -> pa.Table:
        found = []
        for ids, texts in _slices_of(table):
            words = Words(texts)
            keys, at = _anchored(words, words.hashes(), window)
            found.append((keys, ids[words.doc[at]]))
        return _sent(_part(table), buckets, found, _ANCHOR)

    def candidates(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not (table.num_rows and replies.num_rows):
            return pa.table({f.name: [] for f in _SENT}, schema=_SENT)
        known = np.sort(_unpacked(replies["keys"].to_pylist(), replies["n"].to_pylist(), _ANCHOR, _ANCHOR_BYTES))
        found = []
        for ids, texts in _slices_of(table):
            words = Words(texts)
            hashes = words.hashes()
            keys, at = _anchored(words, hashes, window)
            at = at[_lookup(keys, known)[0]]
            near = np.zeros(len(words) + 1, np.int64)  # +1 where windows around an anchor begin, -1 where they end
            np.add.at(near, np.maximum(at - PERIOD + 1, words.first[words.doc[at]]), 1)
            np.add.at(near, at + 1, -1)
            whole = words.windows(hashes, window)[1]
            start = np.flatnonzero((np.cumsum(near)[: len(whole)] > 0) & whole)
            found.append((_window_keys(words, hashes, start, window), ids[words.doc[start]]))
        return _sent(_part(table), buckets, found, _WINDOW)

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed_spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())])

    def cleaned(table: pa.Table, replies: pa.Table) -> pa.Table:
        sizes = replies["n"].to_pylist()
        known, least = _unpacked(replies["keys"].to_pylist(), sizes, _WINDOW, _WINDOW_BYTES), _unpacked(replies["docs"].to_pylist(), sizes, _DOC, 8)
        order = _order(known, least)
        known, least = known[order], least[order]
        rows: dict[str, list] = {f.name: [] for f in out}
        for ids, texts in _slices_of(table):
            gone = None
            if len(known):
                words = Words(texts)
                hashes = words.hashes()
                full, whole = words.windows(hashes, window)
                maybe = np.flatnonzero(whole & _lookup(full, known["a"])[0])
                is_known, at = _lookup(_window_keys(words, hashes, maybe, window), known)
                start = maybe[is_known]
                start = start[least[at[is_known]] < ids[words.doc[start]]]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
            for k, text in enumerate(texts.to_pylist()):
                own = (text or "").encode().split()
                spans: list[list[int]] = []
                if gone is not None and (mine := gone[words.first[k] : words.first[k + 1]]).any():
                    spans = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))).reshape(-1, 2).tolist()
                    rows["kept_text"].append(b" ".join(compress(own, ~mine)).decode())
                else:
                    rows["kept_text"].append(b" ".join(own).decode())
                rows["doc_id"].append(int(ids[k]))
                rows["n_words"].append(len(own))
                rows["removed_spans"].append(spans)
        return pa.table(rows, schema=out)

    first = dealt.groupBy("part").applyInArrow(anchors, _SENT_SQL).groupBy("bucket").applyInArrow(_shared_anchors, _REPLY_SQL)
    second = dealt.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(candidates, _SENT_SQL).groupBy("bucket").applyInArrow(_earlier_windows, _REPLY_SQL)
    return dealt.groupBy("part").cogroup(second.groupBy("part")).applyInArrow(cleaned, "doc_id long, n_words long, removed_spans array<array<long>>, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_passages(read_table(spark, sf_dir, "documents"), window=13)
    lengths = F.transform("removed_spans", lambda s: s[1] - s[0])
    return cleaned.select(
        "doc_id", "n_words", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (
  SELECT g, min(doc_id) AS first FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts ON windows.g = firsts.g AND first < doc_id, (SELECT unnest(range(13)) AS k)
), places AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
  SELECT a.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS text
  FROM places a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]], window: int = 13) -> list[tuple[int, int, int, str]]:
    """The digest rows of ``op8_substring_dedup`` by looking every window up."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
