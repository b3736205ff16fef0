"""Numpy helpers that work on the bytes of many texts at once.

Arrow keeps the texts of a batch end to end in one UTF-8 buffer. White space, letters A-Z and ASCII punctuation are single
bytes in UTF-8, so words are found and hashed on that buffer without making a Python string for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CASED = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_BYTE = _CASED[LOWER]


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, 1 << 64))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has ``most`` bytes of text, or a single longer text."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = buffer_of(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; words end at separators and at the ends of documents."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separator[data], out=inside[1 : n + 1])
    starts_here = inside[1 : n + 1] & ~inside[:n]
    ends_here = inside[1 : n + 1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts_here[cuts] = inside[1:][cuts]
    ends_here[cuts - 1] = inside[cuts]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """64-bit hashes of words, unless ``cased`` without regard to the case of A-Z; equal bytes give equal hashes wherever they stand."""
    table = _CASED if cased else _BYTE
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + _CHUNK, side="right"))
        if to <= at:
            out[at] = _long_hash(data[low : ends[at]], table)
            at += 1
            continue
        high = int(ends[to - 1])
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(table[data[low:high]] * _POW[: high - low], out=sums[1:], dtype=U64)
        first = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[first]) * _INV[first]
        at = to
    return mix(out)


def _long_hash(data: np.ndarray, table: np.ndarray) -> np.uint64:
    """The same polynomial for a word longer than a chunk."""
    total, shift = 0, 1
    step = pow(_BASE, _CHUNK, 1 << 64)
    for k in range(0, len(data), _CHUNK):
        part = data[k : k + _CHUNK]
        total += int((table[part] * _POW[: len(part)]).sum(dtype=U64)) * shift
        shift = shift * step % (1 << 64)
    return U64(total % (1 << 64))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that start at each word, over the positions ``keep`` only, and the windows' first words.

    Windows that would leave their document are left out.
    """
    span = keep[-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for k, j in enumerate(keep):
        total += hashes[j : j + n] * U64(pow(_BASE, k + 1, 1 << 64))
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    return mix(total[at]), at


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of sequences of ``n`` words from each ``first`` on, whose order counts."""
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    each = mix(hashes[place + np.repeat(first, n)] + mix(place.astype(U64) + U64(1)))
    return mix(np.add.reduceat(each, np.cumsum(n) - n) + n.astype(U64)) if len(n) else np.zeros(0, U64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position, and after the last."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
