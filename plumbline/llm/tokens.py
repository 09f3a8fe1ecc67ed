"""Token ids of whole batches, encoding each distinct piece of text once.

A piece is a run of blanks and line feeds followed by other characters. Neither tokenizer
used here builds a token across the start of such a piece, so the ids of a text are those
of its pieces in order. Texts with any other white space may break that rule for byte-level
pre-tokenizers and are encoded whole.

Pieces are found and hashed as bytes; only pieces that are not yet known become strings. What is known of
a piece is compared with its size and first bytes; a text where that fails is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.bytetext import STRETCH, mixed, powers, prefix_sums, runs, text_bytes

_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))  # of the base of prefix_sums
_VISIBLE = ~np.isin(np.arange(256), [10, 32])
#: White space but blanks and line feeds.
_OTHER_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_KEPT: dict[str, "Encoder"] = {}


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that end right behind a piece or a text."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STRETCH)
        while end < n and not (_VISIBLE[data[end - 1]] and not _VISIBLE[data[end]]):
            window = _VISIBLE[data[end - 1:end + STRETCH]]
            ends = np.flatnonzero(window[:-1] & ~window[1:])
            next_text = int(offsets[np.searchsorted(offsets, end)])
            end = min(end + int(ends[0]) if len(ends) else min(n, end + STRETCH), next_text)
            if end == next_text:
                break
        yield at, end
        at = end


def _places(part: np.ndarray, edges: np.ndarray, with_blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pieces between the edges of rows."""
    starts, ends = runs(_VISIBLE[part], edges)
    rows = np.searchsorted(edges, starts, "right") - 1
    if not with_blanks:
        return starts, ends, rows
    starts = edges[rows]
    same = rows[1:] == rows[:-1]
    starts[1:][same] = ends[:-1][same]
    last = edges[:-1].copy()  # where the pieces of a row end
    last[rows] = ends
    bare = np.flatnonzero(last < edges[1:])  # rows that end in blanks
    at = np.searchsorted(rows, bare, "right")
    return np.insert(starts, at, last[bare]), np.insert(ends, at, edges[1:][bare]), np.insert(rows, at, bare)


class Encoder:
    """Encodes with a tokenizer file; the memory of pieces starts anew beyond ``most`` pieces or 8 times as many ids."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = self.tokenizer.normalizer is not None  # then white space makes no tokens
        self.splitter = Tokenizer.from_file(path)  # knows special tokens: one of them keeps pieces apart
        plain = [(i, t.content) for i, t in self.splitter.get_added_tokens_decoder().items()
                 if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.fence = plain[-1] if plain else None
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.sizes, self.heads = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def of(path: str) -> "Encoder":
        """One per worker process, for the file that was used last."""
        if path not in _KEPT:
            _KEPT.clear()
            _KEPT[path] = Encoder(path)
        return _KEPT[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fenced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that do not look like special tokens, many in one call."""
        mark, text = self.fence
        groups = [text.join(pieces[i:i + 128]) + text for i in range(0, len(pieces), 128)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.splitter.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(ends, prepend=-1) - 1

    def _learn(self, pieces: list[str]) -> None:
        """Ids of further pieces, in their order."""
        for at in range(0, len(pieces), 1 << 15):
            part = pieces[at:at + (1 << 15)]
            if self.fence is None or any("<|" in x for x in part):
                lists = self._ids(part)
                ids, sizes = np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists])
            else:
                ids, sizes = self._fenced(part)
            self.flat = np.concatenate([self.flat, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes, dtype=np.int64)])

    def _known(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, learning new ones, and whether the piece is the one with that number."""
        if len(self.numbers) > self.most or len(self.flat) > 8 * self.most:
            self._forget()
        hashes = self._hashes(part, starts, ends)
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        head = np.ndarray(len(part), "<u8", padded, strides=(1,))[starts]  # the first eight bytes
        sizes = ends - starts
        head = np.where(sizes < 8, head & ((np.uint64(1) << (8 * np.minimum(sizes, 7)).astype(np.uint64)) - np.uint64(1)), head)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        numbers = np.empty(len(distinct), np.int64)
        numbers[~new] = self.numbers[at[~new]]
        if new.any():
            raw, source = part.tobytes(), first[new]
            self._learn([raw[s:e].decode() for s, e in zip(starts[source].tolist(), ends[source].tolist())])
            numbers[new] = len(self.numbers) + np.arange(len(source))
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.numbers = np.insert(self.numbers, at[new], numbers[new])
            self.sizes, self.heads = np.concatenate([self.sizes, sizes[source]]), np.concatenate([self.heads, head[source]])
        which = numbers[inverse]
        return which, (self.sizes[which] == sizes) & (self.heads[which] == head)

    def _hashes(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = prefix_sums(part)
        return mixed((sums[ends] - sums[starts]) * powers(len(part) + 1, _INVERSE)[starts])

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, ``end_id`` behind each text, and the n + 1 bounds."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        data, offsets = text_bytes(column)
        n = len(column)
        whole = np.zeros(n, bool)
        if not self.drops_space:
            whole |= pc.fill_null(pc.match_substring_regex(column, _OTHER_SPACE), False).to_numpy(zero_copy_only=False)
        parts, counts = [], np.zeros(n, np.int64)
        for at, end in _stretches(data, offsets):
            low, high = np.searchsorted(offsets, [at, end], "right")[0] - 1, np.searchsorted(offsets, end, "left")
            edges = np.clip(offsets[low:high + 1] - at, 0, end - at)
            starts, ends, rows = _places(data[at:end], edges, not self.drops_space)
            if not len(starts):
                continue
            which, sure = self._known(data[at:end], starts, ends)
            whole[low + np.unique(rows[~sure])] = True
            sizes = self.bounds[which + 1] - self.bounds[which]
            stops = np.cumsum(sizes)
            parts.append(self.flat[np.repeat(self.bounds[which] - (stops - sizes), sizes) + np.arange(int(sizes.sum()))])
            np.add.at(counts, low + rows, sizes)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if whole.any():
            bounds, out = np.concatenate([[0], np.cumsum(counts)]), []
            for i in range(n):
                part = np.array(self._ids([column[i].as_py()])[0], np.uint32) if whole[i] else ids[bounds[i]:bounds[i + 1]]
                out.append(part)
                counts[i] = len(part)
            ids = np.concatenate(out)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
