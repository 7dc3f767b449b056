"""Words, lines and shingles of whole Arrow batches as NumPy arrays.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return. Spans of bytes are
hashed eight bytes a step, all spans at once, through a state of two 64-bit lanes that each step mixes; very long spans
have a cryptographic digest instead. Neither is linear in the bytes, so no patterns of letters collide by structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Odd factors of the words of a shingle, by place.
PLACES = tuple(U(x) for x in (0xD6E8FEB86659FD93, 0xA5A5B2A9C3D1E57B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
LANES = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9))
LONG = 64  # bytes: longer spans are digested one by one
SLAB = 1 << 20  # bytes that are looked at together, so that what a long text needs beside itself stays small
#: For a number of bytes from 0 to 8: the mask that keeps so many of a little-endian word.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 17) -> Iterator[Chunk]:
    """Chunks of about limit bytes; nulls are empty texts. A longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Chunk:
    """Some texts: their bytes and where each begins (and the last one ends)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.space = SPACE[data]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes of spans of bytes."""
        out = np.empty(len(starts), U)
        for at in range(0, len(starts), SLAB // 8):
            part = slice(at, at + SLAB // 8)
            out[part] = self._spans(starts[part], ends[part])
        return out

    def _spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if not len(size):
            return np.zeros(0, U)
        low, high = int(starts.min()), int(ends.max())
        raw = np.zeros(high - low + 8, np.uint8)
        raw[:-8] = self.data[low:high]
        eight = np.ndarray(high - low + 1, "<u8", raw.data, strides=(1,))  # the eight bytes from each place on
        one = mixed(size.astype(U) * LANES[0] + LANES[1])
        two = one ^ LANES[0]
        at = np.flatnonzero(size <= LONG)
        step = 0
        while len(at := at[size[at] > step]):
            word = eight[starts[at] - low + step] & MASKS[np.minimum(size[at] - step, 8)]
            x = mixed(one[at] ^ word)
            two[at] = mixed((two[at] + word) * LANES[1] + x)
            one[at] = x ^ (two[at] >> U(32))
            step += 8
        out = mixed(one + two * LANES[0])
        far = np.flatnonzero(size > LONG)
        if len(far):
            out[far] = self.digests(starts[far], ends[far])[0].view(U)
        return out

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a cryptographic digest of each span."""
        raw = memoryview(np.ascontiguousarray(self.data))
        made = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
        view = np.frombuffer(made, "<i8").reshape(-1, 2)
        return view[:, 0].copy(), view[:, 1].copy()

    def total(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        return np.add.reduceat(np.append(mask, False), self.offsets[:-1], dtype=np.int64) * (np.diff(self.offsets) > 0)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.offsets, places, "right") - 1).astype(np.int32)

    def slabs(self) -> Iterator[slice]:
        for at in range(0, len(self.data), SLAB):
            yield slice(at, min(at + SLAB, len(self.data)))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its text, start, end and hash."""
        starts, ends = self.bounds()
        return self.text_of(starts), starts, ends, self.spans(starts, ends)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        full = ~self.space
        first, last = full & edge[:-1], full & edge[1:]
        first[1:] |= full[1:] & self.space[:-1]
        last[:-1] |= full[:-1] & self.space[1:]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def contents(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a cryptographic digest of each text's words, one space between. text, starts: of the words."""
        keep = ~self.space
        later = np.flatnonzero(text[1:] == text[:-1]) + 1
        keep[starts[later] - 1] = True
        kept = self.data[keep]
        kept[SPACE[kept]] = 32
        size = self.total(keep)
        ends = np.cumsum(size)
        return Chunk(kept, np.append(0, ends)).digests(ends - size, ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line (texts split at newlines): its text, start, end, and whether it has a word."""
        cuts = np.flatnonzero(self.data == 10)
        kept = np.flatnonzero(np.diff(self.offsets) > 0)
        starts = np.unique(np.concatenate([self.offsets[:-1][kept], cuts + 1]))
        # a newline at a text's end opens an empty last line, which has no word
        starts = starts[starts < len(self.data)]
        text = self.text_of(starts)
        ends = np.minimum(np.append(starts[1:], len(self.data)), self.offsets[text + 1])
        ends = ends - ((ends > starts) & (self.data[np.maximum(ends - 1, 0)] == 10))
        words = self.bounds()[0]
        return text, starts, ends, np.searchsorted(words, ends) > np.searchsorted(words, starts)


def shingles(text: np.ndarray, words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The first word's index, and the hash, of each window of k words within one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    value = words[at] * PLACES[0]
    for j in range(1, k):
        value += words[at + j] * PLACES[j % len(PLACES)] + U(j)
    return at, mixed(value)


def repeated(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in the same text, and which are left over when one of each equal ones is taken out."""
    key = mixed(value ^ (text.astype(U) + U(1)) * PLACES[0])
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later
