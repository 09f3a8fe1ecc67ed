"""Whole batches of texts as bytes: word positions and hashes without a loop over words.

All helpers work on stretches of a few megabytes, so that the index arrays beside the bytes
stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose index arrays exist at the same time (each takes 8 bytes per byte).
STRETCH = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the contracts.
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Letters, digits and all bytes of non-ASCII characters.
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; missing is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; a run ends with its row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    first[cuts] |= mask[cuts]
    last[cuts - 1] |= mask[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    h = h.copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of byte times power of its place, modulo 2**64; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), dtype=np.uint64, out=out[1:])
    return out


def word_places(data: np.ndarray, offsets: np.ndarray, *, inside: np.ndarray, fold: np.ndarray | None = None) -> Iterator[
        tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]:
    """Starts, ends and rows of the maximal runs of ``inside`` bytes, in order, stretch by stretch,
    and a function that hashes pieces of the stretch (by such starts and ends)."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STRETCH)
        while end < n and inside[data[end - 1]] and inside[data[end]]:  # not inside a word
            more = np.flatnonzero(~inside[data[end:end + STRETCH]])
            end = end + int(more[0]) if len(more) else min(n, end + STRETCH)
        part = data[at:end]
        low, high = np.searchsorted(offsets, [at, end])
        starts, ends = runs(inside[part], np.concatenate([[0], offsets[low:high] - at, [end - at]]))
        sums, back = prefix_sums(fold[part] if fold is not None else part), powers(len(part) + 1, _INVERSE)

        def hashed(s: np.ndarray, e: np.ndarray, sums=sums, back=back) -> np.ndarray:
            return mixed((sums[e] - sums[s]) * back[s])

        yield starts, ends, np.searchsorted(offsets, starts + at, "right") - 1, hashed
        at = end


def all_word_hashes(data: np.ndarray, offsets: np.ndarray, *, inside: np.ndarray, fold: np.ndarray | None = None
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order."""
    parts = [(hashed(s, e), rows) for s, e, rows, hashed in word_places(data, offsets, inside=inside, fold=fold)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words within a row. A row of fewer words, but at
    least one, has one window of all its words."""
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    factors = powers(size + 1)[1:]
    for j in range(size):
        total += words[j:len(words) - size + 1 + j] * factors[j]
    full = rows[:len(total)] == rows[size - 1:] if len(total) else np.zeros(0, bool)
    hashes, owners = mixed(total[full]), rows[:len(total)][full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([np.sum(words[begins[r]:begins[r + 1]] * factors[:counts[r]], dtype=np.uint64) for r in short], np.uint64)
        hashes, owners = np.concatenate([hashes, mixed(whole)]), np.concatenate([owners, short])
    return hashes, owners


def slices(offsets: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)
