"""A prefix tree of ordered sets, searched for sets with a large overlap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quire.shipping import ship


class PrefixTree:
    """A compressed trie of distinct sets, each an ascending array of ranks.

    A node holds the run of ranks below its parent, the least and largest size of the sets under it, and how many of
    those are still live. search() walks it once for a whole set, adding up overlaps along shared paths, and leaves
    a subtree as soon as the remaining lengths can't reach the least similarity any more.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = [len(x) for x in sets]
        keys = [x.astype(">i4").tobytes() for x in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.run: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.depth, self.parent, self.leaf = [0], [-1], [-1]
        self.children: list[list[int]] = [[]]
        path, before = [0], None
        self.node_of = [0] * len(sets)
        for k in order:
            ranks, shared = sets[k], 0
            if before is not None:
                n = min(len(before), len(ranks))
                differ = np.flatnonzero(before[:n] != ranks[:n])
                shared = int(differ[0]) if len(differ) else n
            while self.depth[path[-1]] > shared:
                last = path.pop()
                if self.depth[path[-1]] < shared:
                    path.append(self._split(last, shared))
            if shared < len(ranks):
                path.append(self._add(path[-1], ranks[shared:], len(ranks)))
            self.leaf[path[-1]] = k
            self.node_of[k] = path[-1]
            before = ranks
        n = len(self.run)
        self.live, self.low, self.high = [0] * n, [1 << 60] * n, [0] * n
        for k, node in enumerate(self.node_of):
            while node >= 0:
                self.live[node] += 1
                self.low[node] = min(self.low[node], self.sizes[k])
                self.high[node] = max(self.high[node], self.sizes[k])
                node = self.parent[node]
        universe = max((int(x[-1]) for x in sets if len(x)), default=-1) + 1
        self.mark = np.zeros(universe, bool)

    def _add(self, parent: int, run: np.ndarray, depth: int) -> int:
        node = len(self.run)
        self.run.append(run)
        self.depth.append(depth)
        self.parent.append(parent)
        self.leaf.append(-1)
        self.children.append([])
        self.children[parent].append(node)
        return node

    def _split(self, node: int, depth: int) -> int:
        """A new node above node, ending at depth."""
        parent, run = self.parent[node], self.run[node]
        cut = depth - self.depth[parent]
        self.children[parent].remove(node)
        upper = self._add(parent, run[:cut], depth)
        self.run[node], self.parent[node] = run[cut:], upper
        self.children[upper].append(node)
        return upper

    def remove(self, k: int) -> None:
        node = self.node_of[k]
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def search(self, k: int, num: int, den: int) -> list[int]:
        """Live sets whose intersection with set k is at least num/den of the union."""
        probe = self.sets[k]
        size, both = len(probe), num + den
        self.mark[probe] = True
        found, open_nodes = [], [(0, 0, 0)]
        while open_nodes:
            node, overlap, used = open_nodes.pop()
            if not self.live[node]:
                continue
            run = self.run[node]
            if len(run):
                overlap += int(np.count_nonzero(self.mark[run]))
                used = int(np.searchsorted(probe, run[-1], "right"))
            depth, left = self.depth[node], size - used
            best = min(max(depth + left, self.low[node]), self.high[node])
            if both * (overlap + min(best - depth, left)) < num * (size + best):
                continue
            other = self.leaf[node]
            if other >= 0 and both * overlap >= num * (size + self.sizes[other]) and self._is_live(other):
                found.append(other)
            open_nodes += [(c, overlap, used) for c in self.children[node]]
        self.mark[probe] = False
        return found

    def _is_live(self, k: int) -> bool:
        node = self.node_of[k]
        return self.live[node] > sum(self.live[c] for c in self.children[node])


def meeting(codes: np.ndarray, lengths: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Groups of two and more of the sets (codes, one set after the other) that a link may hold together.

    Ordered by their counts here, the rarest first, two sets that link share a token of both prefixes; the sets at such a token, by size, hang together
    while sizes allow a link.
    """
    counts = np.bincount(codes)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((codes, counts[codes], owner))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = order[place < np.repeat(lengths - -(-num * lengths // den) + 1, lengths)]
    kept = kept[counts[codes[kept]] > 1]
    kept = kept[np.lexsort((owner[kept], lengths[owner[kept]], codes[kept]))]
    a, b = owner[kept[:-1]], owner[kept[1:]]
    near = (codes[kept[:-1]] == codes[kept[1:]]) & (den * lengths[a] >= num * lengths[b])
    up = list(range(len(lengths)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    if near.any():
        for x, y in np.unique(np.stack([a[near], b[near]], axis=1), axis=0).tolist():
            up[top(y)] = top(x)
    tops = np.array([top(k) for k in range(len(lengths))])
    by_top = np.argsort(tops, kind="stable")
    parts = np.split(by_top, np.flatnonzero(np.diff(tops[by_top])) + 1)
    return [x for x in parts if len(x) > 1]


def linked(sets: list[np.ndarray], num: int = 4, den: int = 5, ranks_of: Callable[[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct sets of tokens: pairs of places in sets.

    Tokens are ordered by ranks_of(tokens), equal ranks by the token, so all trees have one order. Two sets link if their intersection is at least
    num/den of their union. A set leaves the tree once it is reached, so a group of near copies costs one walk, not one per pair.
    """
    if len(sets) < 2:
        return []
    tokens, places = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(tokens), np.int32)
    rank[np.lexsort((tokens, ranks_of(tokens))) if ranks_of else slice(None)] = np.arange(len(tokens), dtype=np.int32)
    lengths = np.array([len(x) for x in sets])
    ranks = np.split(rank[places], np.cumsum(lengths)[:-1])
    out: list[tuple[int, int]] = []
    for group in meeting(places, lengths, num, den):
        out += [(int(group[a]), int(group[b])) for a, b in _forest([np.sort(ranks[k]) for k in group], num, den)]
    return out


def _forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    tree = PrefixTree(sets)
    out, reached = [], np.zeros(len(sets), bool)
    for start in range(len(sets)):
        if reached[start]:
            continue
        reached[start] = True
        tree.remove(start)
        frontier = [start]
        while frontier and tree.live[0]:
            k = frontier.pop()
            for other in tree.search(k, num, den):
                reached[other] = True
                tree.remove(other)
                out.append((k, other))
                frontier.append(other)
    return out


ship(__name__)
