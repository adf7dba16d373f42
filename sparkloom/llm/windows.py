"""Content-defined chunks of fixed-length windows, for finding repeated passages.

A window is W consecutive units (words or bytes) of one document.  Its minimizer is the
K-gram in it with the least hash (Roberts et al. 2004; "winnowing", Schleimer et al.
2003): equal windows have it at the same place.  Neighbouring windows that share one
form a chunk, so each window belongs to exactly one chunk, of about (W - K) / 2 windows.

    equal windows  =>  equal minimizer gram  =>  chunks with equal gram hash ``h``

so only chunks whose ``h`` occurs twice can hold repeated windows.  If all chunks with
one ``h`` are equal as a whole, their windows repeat only among each other; else the
few chunks that differ (at the edges of a repeated passage) are compared window by
window.  Nothing is lost at any length of text or number of repeats.

Everything here is numpy over buffers of bounded size; long texts are cut into pieces
whose windows don't overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

#: Units of window starts in a piece, bytes in a buffer, chunks collected before they are sorted.
PIECE, BUFFER, FLUSH = 1 << 20, 1 << 18, 1 << 20

_POS = np.uint64((1 << 31) - 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLES = [_rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of a buffer in constant time: polynomials mod 2^64 over random byte values."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        have = self._powers.get(which)
        if have is None or len(have[0]) <= len(data):
            n = max(BUFFER * 2, len(data) + 1)
            inverse = pow(base, -1, 1 << 64)
            have = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).astype(np.uint64)) for b in (base, inverse))
            self._powers[which] = have
        self.inverse = have[1]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * have[0][: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every k bytes."""
        n = len(self.prefix) - k
        return _mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


@dataclass
class Chunks:
    """Parallel arrays: gram hash, digest of the whole chunk in two halves, document, first window, number of windows, place of the gram in the first window."""

    h: np.ndarray
    c: np.ndarray
    d: np.ndarray
    uid: np.ndarray
    s: np.ndarray
    r: np.ndarray
    a: np.ndarray

    @staticmethod
    def join(parts: list[Chunks]) -> Chunks:
        return Chunks(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("h", "c", "d", "uid", "s", "r", "a")))

    def take(self, at: np.ndarray) -> Chunks:
        return Chunks(self.h[at], self.c[at], self.d[at], self.uid[at], self.s[at], self.r[at], self.a[at])

    def __len__(self) -> int:
        return len(self.h)


def _chunks(grams: np.ndarray, span, ends: np.ndarray, uids: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Chunks:
    """Pieces lie one after the other in units; ends: where each stops; offsets: of its first unit in its document."""
    low = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    starts = np.concatenate([[0], ends[:-1]])
    count = np.maximum(ends - starts - window + 1, 0)  # windows of each piece
    piece = np.repeat(np.arange(len(ends)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(piece)) - first[piece] + starts[piece]  # every valid window
    if not len(at):
        z = np.zeros(0, np.int64)
        return Chunks(*[z.view(np.uint64)] * 3, z, z, z, z)
    anchor = (low[at] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    s, p = at[new], piece[new]
    r = np.diff(np.concatenate([new, [len(at)]]))
    c, d = span(s, s + r + window - 1)
    return Chunks(grams[anchor[new]], c, d, uids[p], s - starts[p] + offsets[p], r, anchor[new] - s)


def _pieces(docs: Iterator[tuple[int, list | bytes]], window: int) -> Iterator[tuple[int, int, list | bytes]]:
    for uid, units in docs:
        for a in range(0, max(1, len(units) - window + 1), PIECE):
            yield uid, a, units[a : a + PIECE + window - 1]


def _buffers(pieces: Iterator[tuple], limit: int, size) -> Iterator[list[tuple]]:
    held, total = [], 0
    for p in pieces:
        held.append(p)
        total += size(p[2])
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def byte_chunks(docs: Iterator[tuple[int, bytes]], window: int, gram: int) -> Iterator[Chunks]:
    """The digests are left at 0: byte chunks are compared as strings."""
    for group in _buffers(_pieces(docs, window), BUFFER, len):
        data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
        ends = np.cumsum([len(p[2]) for p in group])
        yield _chunks(Rolling(data).grams(gram), lambda a, _: (np.zeros(len(a), np.uint64),) * 2, ends, *(np.array([p[i] for p in group], np.int64) for i in (0, 1)), window, gram)


def word_chunks(docs: Iterator[tuple[int, bytes]], window: int, gram: int) -> Iterator[Chunks]:
    split = ((uid, text.split()) for uid, text in docs)  # bytes: ASCII white space
    for group in _buffers(_pieces(split, window), BUFFER // 8, len):
        w = [x for p in group for x in p[2]]
        if not w:
            continue
        data = np.frombuffer(b" ".join(w), np.uint8)
        length = np.fromiter(map(len, w), np.int64, len(w))
        stop = np.cumsum(length + 1) - 1
        start = stop - length
        n = len(w) - gram + 1
        grams = Rolling(data).of(start[:n], stop[gram - 1 :]) if n > 0 else np.zeros(0, np.uint64)

        def span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = np.frombuffer(digests(data, start[a], stop[b - 1]), np.uint64).reshape(-1, 2)
            return both[:, 0], both[:, 1]

        ends = np.cumsum([len(p[2]) for p in group])
        yield _chunks(grams, span, ends, *(np.array([p[i] for p in group], np.int64) for i in (0, 1)), window, gram)


def digests(data, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """128-bit BLAKE2b of data[start:stop] for each, joined: equal only for equal strings, also made by an adversary."""
    view = memoryview(data)
    return b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist())])


def flushes(chunks: Iterator[Chunks]) -> Iterator[Chunks]:
    """The chunks of a task in lots of bounded size."""
    held, total = [], 0
    for c in chunks:
        held.append(c)
        total += len(c)
        if total >= FLUSH:
            yield Chunks.join(held)
            held, total = [], 0
    if total:
        yield Chunks.join(held)


def span_arrays(column) -> list[np.ndarray]:
    """Of each row of an Arrow list of structs (s, r): an n x 2 array, empty for NULL."""
    flat = column.values
    rows = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "r")], axis=1).astype(np.int64)
    at, valid = column.offsets.to_numpy().tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [rows[a:b] if v else rows[:0] for a, b, v in zip(at, at[1:], valid)]


def cover(spans: np.ndarray, n: int, window: int) -> np.ndarray:
    """Units covered by the windows of spans (first window, number of windows), as booleans."""
    delta = np.zeros(n + 1, np.int32)
    if len(spans):
        np.add.at(delta, spans[:, 0], 1)
        np.add.at(delta, np.minimum(spans[:, 0] + spans[:, 1] + window - 1, n), -1)
    return np.cumsum(delta[:n]) > 0
