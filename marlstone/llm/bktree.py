"""BK-trees over 64-bit fingerprints in numpy: many trees at once, built and searched level by level."""

from __future__ import annotations

import numpy as np

#: Nodes that a batch of queries may have to look at, at most.
VISITS = 2_000_000
_EDGES = 65


class Forest:
    """One tree per group. Children hang at their Hamming distance to the parent; values differ within a group."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        n = len(value)
        order = np.argsort(group, kind="stable")
        self.groups, first = np.unique(group[order], return_index=True)
        self.roots = order[first]
        self.sizes = np.diff(np.append(first, n))
        key, child = [], []
        left, home = order, group[order]
        hung = np.zeros(0, dtype=np.int64)
        while len(left):
            lead = np.empty(len(left), dtype=bool)
            lead[0] = True
            np.not_equal(home[1:], home[:-1], out=lead[1:])
            if len(hung):
                key.append(hung[lead])
                child.append(left[lead])
            parent = left[lead][np.cumsum(lead) - 1]
            rest = ~lead
            left, parent = left[rest], parent[rest]
            home = parent * _EDGES + np.bitwise_count(value[left] ^ value[parent])
            order = np.argsort(home, kind="stable")
            left, home = left[order], home[order]
            hung = home
        key, child = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (key, child))
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def near(self, group: np.ndarray, value: np.ndarray, radius: int):
        """Batches of (query, node) with at most ``radius`` differing bits; each query looks into its group's tree."""
        at = np.searchsorted(self.groups, group)
        at = np.minimum(at, max(0, len(self.groups) - 1))
        ok = np.flatnonzero(self.groups[at] == group) if len(self.groups) else np.zeros(0, dtype=np.int64)
        order = ok[np.argsort(at[ok], kind="stable")]
        ends = np.cumsum(self.sizes[at[order]]) if len(order) else np.zeros(0, dtype=np.int64)
        start = 0
        while start < len(order):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + VISITS, side="right")))
            query = order[start:stop]
            node = self.roots[at[query]]
            while len(query):
                apart = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
                hit = apart <= radius
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.key, node * _EDGES + np.maximum(apart - radius, 1), side="left")
                high = np.searchsorted(self.key, node * _EDGES + np.minimum(apart + radius, _EDGES - 1), side="right")
                many = high - low
                total = int(many.sum())
                query = np.repeat(query, many)
                node = self.child[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
            start = stop


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the index of a smaller or equal member) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
