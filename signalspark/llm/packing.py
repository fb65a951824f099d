"""Packing of tokenized documents into sequences of several context sizes.

Each partition packs its own documents in one pass, so nothing is shuffled and any lost task
can be done again. A document's whole windows of the longest tier become sequences of their
own. The rest is routed to the shortest tier that holds it and packed there. When a tier's
open sequence can't take the next piece, its gap is filled from the waiting pieces of shorter
tiers, longest first, the last one being cut to fit; so sequences close full. What is left at
the end of a partition is packed by the longest tiers first, and the last tokens by powers of
two, down to ``shortest``; only a rest below that is padded.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_spread

END_TOKEN = 2
TIERS = (256, 512, 1024, 2048, 4096)
_ID = np.dtype("<u4")


def _kinds() -> bytes:
    """For each character of Latin-1: p for a comma or full stop, o for other marks, else a."""
    plain = lambda c: unicodedata.category(c)[0] in "LN" or c in "\t\n\x0b\x0c\r \x85\xa0"
    return bytes(ord("p" if c in ",." else "a" if plain(c) else "o") for c in map(chr, range(256)))


_KINDS = _kinds()
#: Marks that the tokenizer always parts from the letters before them; an apostrophe may join.
_MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class WordTokenizer:
    """Ids of a tokenizer whose words never reach over white space, with the ids of words kept.

    Words up to white space are encoded once and kept, ``most`` at a time. A text of Latin-1 is
    lower-cased first, as the tokenizer does itself, so that more words are alike. New words of
    letters only are encoded in one call, as one text: the tokenizer makes one word of each, and
    ends it with a token that only ends words. Commas and full stops are words to the tokenizer
    when no other mark is next to them; then they are set apart before.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._most, self._kept = most, {}

    def _each(self, words: list[bytes]) -> None:
        encoded = self._tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for w, e in zip(words, encoded, strict=True):
            self._kept[w] = np.array(e.ids, _ID).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        # a letter that lower-cases to a letter and a mark would join the marks after it
        letters = {w for w in words if w.isalpha() or w.decode().isalpha() and w.decode().lower().isalpha()}
        rest, parts = words - letters, []
        for w in rest:
            stem = w.rstrip(_MARKS)
            if stem and stem != w and stem.decode().isalpha() and stem.decode().lower().isalpha():
                parts.append((w, stem, w[len(stem) :]))
        if parts:
            rest.difference_update(w for w, _, _ in parts)
            letters.update(stem for _, stem, _ in parts)
            rest.update(tail for _, _, tail in parts)
            letters, rest = letters.difference(self._kept), rest.difference(self._kept)
        self._letters(list(letters))
        self._each(list(rest))
        for w, stem, tail in parts:
            self._kept[w] = self._kept[stem] + self._kept[tail]

    def _letters(self, letters: list[bytes]) -> None:
        if letters:
            ids = np.array(self._tokenizer.encode(b" ".join(letters).decode(), add_special_tokens=False).ids, _ID)
            ends = (np.flatnonzero(self._ends_word[ids]) + 1) * _ID.itemsize
            if len(ends) == len(letters):
                raw, ends = ids.tobytes(), ends.tolist()
                self._kept.update(zip(letters, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
            else:
                self._each(letters)

    def _words(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            return text.encode().split()
        raw = text.lower().encode()
        if not (b"pp" in kinds or b"op" in kinds or b"po" in kinds):
            raw = raw.replace(b",", b" , ").replace(b".", b" . ")
        return raw.split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end token last."""
        end = np.array([END_TOKEN], _ID).tobytes()
        for at in range(0, len(texts), 256):
            if len(self._kept) > self._most:
                self._kept.clear()
            docs = [self._words(text) for text in texts[at : at + 256]]
            missing = set().union(*docs).difference(self._kept)
            if missing:
                self._learn(missing)
            get = self._kept.__getitem__
            for words in docs:
                yield b"".join(map(get, words)) + end


_encoders: dict[tuple[str, int], WordTokenizer] = {}


def encoder_of(path: str, most: int) -> WordTokenizer:
    """This worker's tokenizer; the words that one task has learnt serve the next."""
    if (path, most) not in _encoders:
        _encoders.clear()
        _encoders[path, most] = WordTokenizer(path, most)
    return _encoders[path, most]


class _Packer:
    """The open sequences and waiting pieces of one partition.

    A piece is [row, start, ids]; ``emit`` gets each closed sequence's pieces and its tier.
    """

    def __init__(self, tiers: tuple[int, ...], waiting: int, emit):
        self._tiers, self._most, self._emit = tiers, waiting, emit
        self._open = {t: [[], 0] for t in tiers}
        self._waiting: dict[int, list] = {t: [] for t in tiers}

    def add(self, row, ids: bytes) -> None:
        size, top, at = 4, self._tiers[-1], 0
        while len(ids) - at >= size * top:
            self._emit([[row, at // size, ids[at : at + size * top]]], top)
            at += size * top
        if at < len(ids):
            rest = [row, at // size, ids[at:]]
            self._waiting[self._fit(len(rest[2]) // size)].append(rest)
            self._settle()

    def _fit(self, n: int) -> int:
        return next(t for t in self._tiers if n <= t)

    def _settle(self) -> None:
        """Pack the tiers that have more pieces waiting than they should."""
        for tier in reversed(self._tiers):
            waiting = self._waiting[tier]
            while len(waiting) > self._most:
                self._place(tier, waiting.pop(0))

    def _place(self, tier: int, piece: list) -> None:
        pieces, used = self._open[tier]
        n = len(piece[2]) // 4
        if used + n > tier:
            self._fill(tier, pieces, tier - used)
            gap = tier - sum(len(p[2]) // 4 for p in pieces)
            if gap:
                head, piece = self._cut(piece, gap)
                pieces.append(head)
            self._emit(pieces, tier)
            pieces, used, n = [], 0, len(piece[2]) // 4
        pieces.append(piece)
        if used + n == tier:
            self._emit(pieces, tier)
            pieces, used, n = [], 0, 0
        self._open[tier] = [pieces, used + n]

    def _cut(self, piece: list, n: int) -> tuple[list, list]:
        row, start, ids = piece
        return [row, start, ids[: 4 * n]], [row, start + n, ids[4 * n :]]

    def _fill(self, tier: int, pieces: list, gap: int) -> None:
        """Fill a gap with waiting pieces of shorter tiers, the longest first; cut one to close it."""
        for shorter in reversed(self._tiers[: self._tiers.index(tier)]):
            waiting = self._waiting[shorter]
            for k in reversed(range(len(waiting))):
                n = len(waiting[k][2]) // 4
                if n <= gap:
                    pieces.append(waiting.pop(k))
                    gap -= n
                if not gap:
                    return
        for shorter in reversed(self._tiers[: self._tiers.index(tier)]):
            if self._waiting[shorter]:
                head, rest = self._cut(self._waiting[shorter].pop(), gap)
                pieces.append(head)
                self._waiting[self._fit(len(rest[2]) // 4)].append(rest)
                return

    def close(self, shortest: int) -> None:
        left = [p for t in reversed(self._tiers) for p in (*self._open[t][0], *self._waiting[t])]
        total = sum(len(p[2]) // 4 for p in left)
        while left:
            tier = next((t for t in reversed(self._tiers) if t <= total), None) or max(1 << total.bit_length() - 1, 1)
            if tier < shortest:
                tier = total
            pieces, need = [], tier
            while need:
                piece = left.pop(0)
                if len(piece[2]) // 4 > need:
                    piece, rest = self._cut(piece, need)
                    left.insert(0, rest)
                pieces.append(piece)
                need -= len(piece[2]) // 4
            self._emit(pieces, tier)
            total -= tier


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, waiting: int = 32, group_tokens: int = 65_536, shortest: int = 1, keep: tuple[str, ...] = (), kept_words: int = 600_000) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)``: ``doc_id, start, length, token_ids, doc_tokens,
    sequence_id, offset, tier, step_group`` and the columns named in ``keep``.

    ``token_ids`` are a piece's ids, little-endian unsigned 32-bit; a document's are those of its
    text and an end token, and each is in exactly one piece. ``tier`` is the sequence's length in
    tokens, without padding: one of ``tiers``, or at the end of a partition a smaller power of two
    (``shortest`` at least, else a rest, to be padded to the longest tier). Sequences of one tier
    form step groups of ``group_tokens`` tokens, so the steps of all tiers weigh the same; a group
    is written when it is full. What is left of all tiers at the end of a partition forms mixed
    groups, of which only the last weighs less.

    A null or empty text is its end token; a document with no other row is packed alike; rows
    that repeat are packed each for itself; doc_id may be null. No rows give no pieces. Memory is
    bounded by ``waiting`` pieces a tier, ``kept_words`` words whose ids a worker keeps (200 bytes
    each), an input batch, and the longest document. Other columns may have any name.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    source = docs.select("doc_id", "text", *keep)
    kinds = [f.dataType.simpleString() for f in source.schema if f.name != "text"]
    names = ["doc_id", *keep]
    own = "start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    sql = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)) + ", " + own

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, kept_words)
        base = TaskContext.get().partitionId() << 33
        ready: list[list] = []
        count = groups = 0
        waiting_steps: dict[int, list[list]] = {}  # tier: sequences of its next step group

        def emit(pieces: list, tier: int) -> None:
            mine = waiting_steps.setdefault(tier, [])
            mine.append(pieces)
            if (len(mine) + 1) * tier > group_tokens:
                step([(tier, s) for s in mine])
                mine.clear()

        def step(sequences: list[tuple[int, list]]) -> None:
            nonlocal count, groups
            for tier, pieces in sequences:
                offset = 0
                for (row, tokens), start, ids in pieces:
                    ready.append([*row, start, len(ids) // 4, ids, tokens, base + count, offset, tier, base + groups])
                    offset += len(ids) // 4
                count += 1
            groups += 1

        def last_steps() -> None:
            """The sequences that no full group took, of all tiers, the longest first."""
            mine: list[tuple[int, list]] = []
            for tier in sorted(waiting_steps, reverse=True):
                for pieces in waiting_steps[tier]:
                    if mine and sum(t for t, _ in mine) + tier > group_tokens:
                        step(mine)
                        mine = []
                    mine.append((tier, pieces))
            if mine:
                step(mine)

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [()] * len(schema)
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            ready.clear()
            return out

        packer, schema = _Packer(tiers, waiting, emit), None
        for batch in batches:
            if schema is None:
                mine = [batch.schema.field(n) for n in names]
                rest = [("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
                schema = pa.schema([*mine, *(pa.field(n, t) for n, t in rest)])
            texts = batch.column("text")
            rows = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            for at in range(0, len(rows), 256):
                for row, ids in zip(rows[at : at + 256], encoder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    packer.add((row, len(ids) // 4), ids)
                if len(ready) >= 1000:
                    yield flush(schema)
        if schema is not None:
            packer.close(shortest)
            last_steps()
            yield flush(schema)

    return source.mapInArrow(packed, sql)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_spread(spark, sf_dir, "documents", "doc_id"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", ids_crc32(F.col("token_ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def faults(rows: list[tuple[int, str | None]], pieces: list[dict], tokenizer: str, longest: int = TIERS[-1]) -> list[str]:
    """What is wrong with the rows of ``op3_packing``, by encoding every text anew."""
    from tokenizers import Tokenizer

    encoder, found = Tokenizer.from_file(tokenizer), []
    by_doc: dict[int, list[dict]] = {}
    by_sequence: dict[int, list[dict]] = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, END_TOKEN]
        at = 0
        for p in sorted(by_doc.pop(doc_id, []), key=lambda p: p["start"]):
            part = np.array(ids[p["start"] : p["start"] + p["length"]], _ID).tobytes()
            if p["start"] != at or p["ids_crc32"] != zlib.crc32(part) or p["doc_tokens"] != len(ids) or p["length"] < 1:
                found.append(f"document {doc_id} at {at}")
            at = p["start"] + p["length"]
        if at != len(ids):
            found.append(f"document {doc_id} ends at {at} of {len(ids)}")
    found += [f"document {d} is not in the input" for d in by_doc]
    for k, mine in by_sequence.items():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            if p["offset"] != at:
                found.append(f"sequence {k} has a gap at {at}")
            at = p["offset"] + p["length"]
        if at > longest or len({p["tier"] for p in mine}) != 1 or mine[0]["tier"] != at:
            found.append(f"sequence {k} has {at} tokens")
    return found
