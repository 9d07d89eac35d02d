"""BK-tree under the Levenshtein metric, searched for many words at once.

At each node one vector computation gives the distance of the node's word to all words still alive there; the triangle
inequality decides which of them go down which edge. Every entry within the radius is returned.
"""

from __future__ import annotations

import numpy as np


def encode(words: list[str], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters, one row a word, padded with zeros; lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = width or int(lengths.max(initial=0))
    codes = np.zeros((len(words), max(1, width)), np.uint32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, lengths


def distances(word: str, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distance of ``word`` to each of the words whose characters lie in ``columns`` (one row a position)."""
    width, n = columns.shape
    kind = np.int8 if max(width, len(word)) < 60 else np.int32
    at = np.arange(width + 1, dtype=kind)[:, None]
    row, new = np.repeat(at, n, 1), np.empty((width + 1, n), kind)
    for k, c in enumerate(word, 1):
        new[0] = k
        np.minimum(row[1:] + 1, row[:-1] + (columns != ord(c)), out=new[1:])
        new -= at  # letters left out of the words: a running minimum along the slope
        np.minimum.accumulate(new, axis=0, out=new)
        new += at
        row, new = new, row
    return row[lengths, np.arange(n)].astype(np.int32)


def swapped(a: str, b: str) -> bool:
    """Whether b is a with two neighbouring letters exchanged."""
    if len(a) != len(b):
        return False
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


class BKTree:
    def __init__(self, words: list[str]) -> None:
        """Built top-down: the words below a node part by their distance to it, in one vector computation a node."""
        self.words = sorted(set(words))
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []
        if self.words:
            codes, lengths = encode(self.words)
            self._build(np.arange(len(self.words)), codes, lengths)

    def _build(self, members: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        waiting = [(members, None, 0)]
        while waiting:
            group, parent, edge = waiting.pop()
            middle = group[len(group) // 2]
            me = len(self.nodes)
            self.nodes.append((int(middle), []))
            if parent is not None:
                self.nodes[parent][1].append((edge, me))
            rest = group[group != middle]
            if len(rest):
                d = distances(self.words[middle], np.ascontiguousarray(codes[rest].T), lengths[rest])
                for e in np.unique(d).tolist():
                    waiting.append((rest[d == e], me, e))

    def search(self, queries: list[str], radius: int) -> list[list[tuple[str, int]]]:
        """For each query every word within ``radius``, with its distance."""
        out: list[list[tuple[str, int]]] = [[] for _ in queries]
        if not self.nodes or not queries:
            return out
        codes, lengths = encode(queries)
        columns = np.ascontiguousarray(codes.T)
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, alive = waiting.pop()
            word, edges = self.nodes[node]
            d = distances(self.words[word], columns[: int(lengths[alive].max(initial=1))][:, alive], lengths[alive])
            for q in np.flatnonzero(d <= radius).tolist():
                out[alive[q]].append((self.words[word], int(d[q])))
            for e, child in edges:
                go = np.abs(d - e) <= radius
                if go.any():
                    waiting.append((child, alive[go]))
        return out
