"""BK-trees: children keyed by their integer Hamming distance from the parent, searched within a radius."""

from __future__ import annotations

import numpy as np


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, of which each is the least member of its component, after the links (a, b)."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


class BKForest:
    """BK-trees of many shards, built and searched together: one array of children by (node, distance).

    Columns before distance 0 and after 64 stay empty, so a search can look at all edges near a distance.
    """

    def __init__(self, shards: np.ndarray, prints: np.ndarray, pad: int = 16):
        """``shards`` is sorted; the first member of each is the root of its tree. Searches go up to a radius of ``pad``."""
        self.pad = pad
        self.prints, n = prints, len(prints)
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        self.sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.sizes).astype(np.int32)
        self.child = np.full((n, 65 + 2 * pad), -1, np.int32)
        rest = np.flatnonzero(self.root != np.arange(n)).astype(np.int32)
        at = self.root[rest]
        while len(rest):  # all members go down one edge; the first to want a free edge becomes its child
            d = np.bitwise_count(prints[rest] ^ prints[at]) + np.int16(pad)
            free = np.flatnonzero(self.child[at, d] < 0)
            _, lead = np.unique(at[free].astype(np.int64) * 128 + d[free], return_index=True)
            lead = free[lead]
            self.child[at[lead], d[lead]] = rest[lead]
            at = self.child[at, d]
            on = at != rest
            rest, at = rest[on], at[on]

    def earlier_within(self, queries: np.ndarray, radius: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs within the radius where the member comes first; only edges within it are followed.

        Edges are looked at for ``block`` pairs of a query and a node at a time, as each pair has up to 2 * radius + 1 of them.
        """
        if radius > self.pad:
            raise ValueError(f"the radius is at most {self.pad}")
        found_q, found_m, edges = [], [], np.arange(self.pad - radius, self.pad + radius + 1, dtype=np.int16)
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.prints[q] ^ self.prints[node]).astype(np.int16)
            hit = (d <= radius) & (node < q)
            found_q.append(q[hit])
            found_m.append(node[hit])
            next_q, next_node = [], []
            for at in range(0, len(q), block):
                part = q[at : at + block]
                near = self.child[node[at : at + block, None], d[at : at + block, None] + edges]
                go = (near >= 0) & (near < part[:, None])  # a subtree's members all come after its root
                next_q.append(np.repeat(part, go.sum(1)))
                next_node.append(near[go])
            q, node = np.concatenate(next_q), np.concatenate(next_node)
        return np.concatenate(found_q), np.concatenate(found_m)

    def spanning(self, radius: int, room: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """Members and the earlier member each is connected to, one pair a member at most."""
        n = len(self.prints)
        label = np.arange(n, dtype=np.int32)
        block = int(np.clip(room // max(1, self.sizes.max(initial=1)), 16, 8192))
        queries = np.flatnonzero(np.repeat(self.sizes, self.sizes) > 1).astype(np.int32)
        for at in range(0, len(queries), block):
            a, b = self.earlier_within(queries[at : at + block], radius)
            label = joined(label, a, b)
        member = np.flatnonzero(label != np.arange(n))
        return member, label[member]
