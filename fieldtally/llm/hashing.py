"""Words and shingles of Arrow text columns as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Text is worked on in pieces of about this many bytes, which bounds the memory of a task.
PIECE = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _piece_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a piece and the number of words that begin before each cut."""
    n = len(data)
    low = _LOWER[data]
    inside = ~_BLANK[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = cuts[(cuts > 0) & (cuts < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[low] * up[:n], out=sums[1:])
    words = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return words, np.searchsorted(begin, cuts)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at ASCII blanks) of all texts in a row, and offsets by text.

    Null texts have no words. A long text is cut at a blank where one is in reach.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    parts: list[np.ndarray] = []
    counts = np.zeros(n, dtype=np.int64)
    at, row = int(offsets[0]), 0
    while at < offsets[-1]:
        stop = int(offsets[min(n, max(row + 1, int(np.searchsorted(offsets, at + PIECE, "right")) - 1))])
        if stop - at > PIECE:  # one long text: cut after a blank
            blanks = np.flatnonzero(_BLANK[data[at:at + PIECE]])
            if len(blanks) == 0:
                blanks = np.flatnonzero(_BLANK[data[at:stop]])[:1]
            stop = at + int(blanks[-1]) + 1 if len(blanks) else stop
        end_row = int(np.searchsorted(offsets, stop, "left"))  # the text that ends at or after `stop`
        cuts = np.clip(offsets[row:end_row + 1] - at, 0, stop - at)
        words, upto = _piece_words(data[at:stop], cuts)
        counts[row:end_row] += np.diff(upto)
        parts.append(words)
        at = stop
        row = int(np.searchsorted(offsets, at, "right")) - 1
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; of the whole if it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = words[:n - k + 1].copy()
        for i in range(1, k):
            h = mixed(h) + words[i:n - k + 1 + i]
        return np.unique(mixed(h + np.uint64(k)))
