"""Words of many texts as numpy arrays: one pass over the bytes, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each, so that arrays per byte stay small."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64))
    at = 0
    while at < len(texts):
        limit = (ends[at - 1] if at else 0) + most
        to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield at, to
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a slice of texts: ``doc`` (row of the slice), ``at`` (number in its text), counts.

    ``inside`` says of each byte whether it is part of a word (by default all but white space);
    with ``lower`` A-Z count as a-z.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray | None = None, lower: bool = False):
        texts = pa.array(texts.cast(pa.large_string()).fill_null(""))
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) if inside is None else inside[raw]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | np.uint8(32), raw)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        first[edges] = inside[edges]
        self._raw, self._inside, self._starts = raw, inside, np.flatnonzero(first)
        self.n_docs = len(texts)
        self.doc = np.searchsorted(offsets, self._starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.at = np.arange(len(self._starts)) - self.first[self.doc]

    def __len__(self) -> int:
        return len(self._starts)

    def strings(self, which: np.ndarray) -> list[bytes]:
        """Bytes of the words of these numbers."""
        if not len(which):
            return []
        starts, lengths = self._starts[which].tolist(), np.add.reduceat(self._inside, self._starts, dtype=np.int64)[which].tolist()
        return [self._raw[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]

    def before(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes that ``marks`` has stand before each word."""
        return np.cumsum(marks[self._raw], dtype=np.int64)[self._starts]

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; each kind is a hash of its own."""
        if not len(self):
            return np.zeros(0, np.uint64)
        start = np.zeros(len(self._raw), np.int64)
        start[self._starts] = self._starts
        place = np.arange(len(self._raw)) - np.maximum.accumulate(start)
        place[~self._inside] = 0
        value = np.where(self._inside, self._raw.astype(np.uint64) + np.uint64(1), np.uint64(0))
        value *= _powers(_BASES[kind], int(place.max()) + 1)[place]
        return mixed(np.add.reduceat(value, self._starts))

    def windows(self, hashes: np.ndarray, width: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and whether they are in one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for power, k in zip(_powers(_BASES[1 - kind], width), range(width), strict=True):
            out += hashes[k : k + n] * power
        return mixed(out), self.at[:n] + width <= self.count[self.doc[:n]]
