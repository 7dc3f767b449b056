"""Best segmentations of many words at once, by dynamic programming over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FIELD = 32  # bits of a token count in a packed number (see token_counts)
LONGEST = 512  # bytes of a word; scores of its segmentations fit the bits that are left
SLICE = 1 << 18  # bytes of words that are segmented at a time
NEAR = 257 << 8  # the keys of first and second steps are less
NONE = np.iinfo(np.int64).min
NODE, SIZE = 24, 16  # bits of a node and of a piece's bytes in the key of a match


class Segments:
    """The pieces as a trie, whose steps are sorted numbers of node and byte."""

    def __init__(self, values: dict[bytes, int]) -> None:
        """values: the packed number of each piece; all single bytes are pieces."""
        steps: dict[int, int] = {}
        own = [NONE]
        self.pieces: list[bytes] = [b""]  # that nodes spell, empty where none
        # single bytes first, so that their nodes, and the keys of steps from these, are the lowest ones
        for piece, value in sorted(values.items(), key=lambda x: (len(x[0]), x[0])):
            node = 0
            for b in piece:
                step = node << 8 | b
                node = steps.get(step)
                if node is None:
                    node = steps[step] = len(own)
                    own.append(NONE)
                    self.pieces.append(b"")
            own[node], self.pieces[node] = value, piece
        self.own = np.array(own, np.int64)
        keys, nodes = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]
        near = keys < NEAR
        self.near = np.zeros(NEAR, np.int64)
        self.near[keys[near]] = nodes[near]

    def _next(self, node: np.ndarray, byte: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the steps behind size bytes there are, and the nodes that these lead to."""
        key = node << 8 | byte
        if size < 2:
            node = self.near[key]
            found = node > 0
            return found, node[found]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, self.nodes[at[found]]

    def _matches(self, raw: np.ndarray, room: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each piece that occurs in a word its end's place, size and node as one number, rising.

        room: the bytes from each one to its word's end; place: of each byte's end in the table of best values."""
        at, node, size, out = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0, []
        while len(at):
            found, node = self._next(node, raw[at + size], size)
            at, size = at[found], size + 1
            hit = self.own[node] != NONE
            out.append(place[at[hit] + (size - 1)] << (SIZE + NODE) | size << NODE | node[hit])
            more = room[at] > size
            at, node = at[more], node[more]
        return np.sort(np.concatenate(out))

    def _best(self, words: list[bytes], trace: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best: the packed numbers of all prefixes; last: the place of each word's end in it; and, with trace, choice:
        the match that each prefix ends with, start and node: those of the matches.

        Prefixes of equal length lie side by side, those of longer words first, so that a step takes all words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        raw = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # of each length, the words that reach it and where their prefixes begin
        reach = np.append(len(words), np.bincount(offset))
        base = np.append(0, np.cumsum(reach))
        found = self._matches(raw, np.repeat(sizes, sizes) - offset, base[offset + 1] + word)
        end, size, node = found >> (SIZE + NODE), found >> NODE & ((1 << SIZE) - 1), found & ((1 << NODE) - 1)
        first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))  # of each prefix's matches, as every byte is a piece
        length = np.repeat(np.arange(len(reach)), reach)[end]
        start, own = base[length - size] + end - base[length], self.own[node]
        best, choice = np.zeros(base[-1], np.int64), np.zeros(base[-1] if trace else 0, np.int64)
        cuts = np.append(first, len(end))[base[1:] - len(words)]
        for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), 1):
            groups = first[base[n] - len(words) : base[n + 1] - len(words)] - a
            value = best[start[a:b]] + own[a:b]
            best[base[n] : base[n + 1]] = top = np.maximum.reduceat(value, groups)
            if trace:
                # of equal ones, the shortest last piece
                at = np.flatnonzero(value == np.repeat(top, np.diff(np.append(groups, b - a))))
                own_end = end[a:b][at]
                choice[base[n] : base[n + 1]] = a + at[np.append(True, own_end[1:] != own_end[:-1])]
        last = np.empty(len(words), np.int64)
        last[order] = base[sizes] + np.arange(len(words))
        return best, last, choice, start, node

    def values(self, words: list[bytes]) -> list[int]:
        """The packed number of each word's best segmentation. Words have LONGEST bytes at most, and one at least."""
        out: list[int] = []
        for some in sliced(words):
            best, last, *_ = self._best(some, False)
            out += best[last].tolist()
        return out

    def tally(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each node's piece is in the best segmentations of the words, each of which counts so often."""
        out, at = np.zeros(len(self.own), np.int64), 0
        for some in sliced(words):
            _, place, choice, start, node = self._best(some, True)
            n, at = counts[at : at + len(some)], at + len(some)
            while len(place):
                match = choice[place]
                np.add.at(out, node[match], n)
                place = start[match]
                more = place >= len(some)
                place, n = place[more], n[more]
        return out


def sliced(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in order, in lists of SLICE bytes and one more word at most."""
    at = size = 0
    for i, word in enumerate(words, 1):
        size += len(word)
        if size > SLICE:
            yield words[at:i]
            at, size = i, 0
    if at < len(words):
        yield words[at:]
