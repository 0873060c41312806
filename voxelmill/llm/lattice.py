"""The lattice of all segmentations of words into the pieces of a subword vocabulary.

Words of a batch are laid out level by level, so one numpy step of the recursion
advances all of them by a byte.  Pieces are found by walking a trie from every byte
of every word at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Marks the start of a word in a vocabulary's pieces.
WORD_START = "▁".encode()
#: Bytes of words whose lattices are held at once; a longer word is by itself.
_AT_ONCE = 1 << 18


@dataclass
class Trie:
    """The strings of a vocabulary, as bytes: edges (state * 256 + byte) sorted, the state that each leads to, and the piece that ends in each state or -1.  All single bytes are pieces, so any word has a segmentation."""

    first: np.ndarray
    edges: np.ndarray
    to: np.ndarray
    piece: np.ndarray

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.to[at], -1)


def trie(strings: list[bytes]) -> Trie:
    """Of distinct strings; their numbers are their places in the list."""
    edges: dict[int, int] = {}
    piece = [-1]
    for k, s in enumerate(strings):
        state = 0
        for b in s:
            key = state << 8 | b
            if (state := edges.get(key, -1)) < 0:
                state = edges[key] = len(piece)
                piece.append(-1)
        piece[state] = k
    keys = np.array(sorted(edges), np.int64)
    to = np.array([edges[k] for k in keys.tolist()], np.int32)
    first = np.full(256, -1, np.int32)
    first[keys[keys < 256]] = to[keys < 256]
    return Trie(first, keys, to, np.array(piece, np.int32))


class Lattice:
    """The lattices of a batch of words that aren't empty: nodes level by level, arcs sorted by the node where they end.

    ``order`` has the words by falling length; node ``off[t] + j`` stands before byte t
    of the j-th of them, or at its end.
    """

    def __init__(self, known: Trie, buf: np.ndarray, bound: np.ndarray):
        size = np.diff(bound)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.levels = int(self.size[0])
        self.count = np.searchsorted(-self.size, -np.arange(self.levels + 1), "right")  # words of t bytes or more
        self.off = np.r_[0, np.cumsum(self.count)]
        rank = np.empty(len(size), np.int64)
        rank[self.order] = np.arange(len(size))
        byte = np.zeros(self.off[-1], np.uint8)
        inside = np.arange(len(buf)) - np.repeat(bound[:-1] - bound[0], size)
        byte[self.off[inside] + np.repeat(rank, size)] = buf
        held = np.append(self.count[1:], 0)  # words that have a byte at each level
        level = np.repeat(np.arange(self.levels + 1), held)
        word = np.arange(len(level)) - np.repeat(np.cumsum(held) - held, held)
        start = self.off[level] + word
        state = known.first[byte[start]]
        starts, ends, pieces = [], [], []
        while True:
            level = level + 1
            end = self.off[level] + word
            found = known.piece[state]
            ok = found >= 0
            starts.append(start[ok])
            ends.append(end[ok])
            pieces.append(found[ok])
            more = word < held[level]
            start, level, word, end, state = start[more], level[more], word[more], end[more], state[more]
            state = known.step(state, byte[end])
            alive = state >= 0
            start, level, word, state = start[alive], level[alive], word[alive], state[alive]
            if not len(start):
                break
        end = np.concatenate(ends)
        by = np.argsort(end, kind="stable")
        self.start, self.end, self.piece = np.concatenate(starts)[by], end[by], np.concatenate(pieces)[by]

    def _folded(self, arcs: np.ndarray, node: np.ndarray) -> np.ndarray:
        """log sum exp of the arcs of each node, which stand together and are never none."""
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        top = np.maximum.reduceat(arcs, first)
        return top + np.log(np.add.reduceat(np.exp(arcs - np.repeat(top, np.diff(np.r_[first, len(arcs)]))), first))

    def forward(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log of the summed weight of all ways from a word's start to each node, and of each word, in the order given."""
        alpha = np.zeros(self.off[-1])
        cut = np.searchsorted(self.end, self.off)
        for t in range(1, self.levels + 1):
            arcs = slice(cut[t], cut[t + 1])
            alpha[self.off[t] : self.off[t + 1]] = self._folded(alpha[self.start[arcs]] + weight[self.piece[arcs]], self.end[arcs])
        ends = alpha[self.off[self.size] + np.arange(len(self.size))]
        out = np.empty(len(ends))
        out[self.order] = ends
        return alpha, out

    def expected(self, weight: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """How often each of n pieces is expected in the words, each taken so many times."""
        alpha, total = self.forward(weight)
        beta = np.zeros(self.off[-1])
        by = np.argsort(self.start, kind="stable")
        start, end, piece = self.start[by], self.end[by], self.piece[by]
        cut = np.searchsorted(start, self.off)
        share = np.zeros(n)
        times, total = times[self.order], total[self.order]
        for t in range(self.levels - 1, -1, -1):
            arcs = slice(cut[t], cut[t + 1])
            after = beta[end[arcs]] + weight[piece[arcs]]
            held = self.count[t + 1]
            beta[self.off[t] : self.off[t] + held] = self._folded(after, start[arcs])
            word = start[arcs] - self.off[t]
            share += np.bincount(piece[arcs], np.exp(alpha[start[arcs]] + after - total[word]) * times[word], n)
        return share


def marked(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Words in parts of a bounded size: bytes with the mark before each word, bounds, and the number of the first word."""
    coded = [WORD_START + w.encode() for w in words]
    bound = np.r_[0, np.cumsum([len(w) for w in coded])].astype(np.int64)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + _AT_ONCE, "right")) - 1)
        yield np.frombuffer(b"".join(coded[at:to]), np.uint8), bound[at : to + 1], at
        at = to
