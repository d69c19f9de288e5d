"""Sets in one global order as a trie, and many pairs of them compared in one walk."""

from __future__ import annotations

import numpy as np

#: Items of an edge that are looked at in one step.
EDGE = 48
#: Items that a step may look up at once.
STEP_ITEMS = 1 << 18


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m items that are similar."""
    return -(-percent * (n + m) // (100 + percent))


class PrefixTree:
    """Sets of numbers, each ascending, as a compressed trie: an edge is a run of items that all sets below share."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.place = np.empty(len(sets), np.int64)  # of each given set in the order of the tree
        self.place[order] = np.arange(len(sets))
        sets = [sets[i] for i in order]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        values, ranks = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.ranks, self.n_ranks = ranks.astype(np.int64), max(1, len(values))
        common = [self._shared(x, y) for x, y in zip(sets, sets[1:], strict=False)]
        self._grow(np.array(common, np.int64))

    @staticmethod
    def _shared(x: np.ndarray, y: np.ndarray) -> int:
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        return int(differ[0]) if len(differ) else k

    def _grow(self, common: np.ndarray) -> None:
        """Nodes: sets from lo to hi share their items from `start` up to `end`; children of a node are consecutive."""
        nodes: list[tuple[int, int, int, int]] = []
        children: list[tuple[int, int]] = []

        def node(lo: int, hi: int, start: int) -> tuple[int, int, int, int]:
            return lo, hi, start, int(common[lo : hi - 1].min()) if hi - lo > 1 else int(self.size[lo])

        nodes.append(node(0, len(self.size), 0)) if len(self.size) else None
        at = 0
        while at < len(nodes):
            lo, hi, _, end = nodes[at]
            begin = len(nodes)
            if hi - lo > 1:
                cuts = (lo + 1 + np.flatnonzero(common[lo : hi - 1] == end)).tolist()
                nodes += [node(a, b, end) for a, b in zip([lo, *cuts], [*cuts, hi], strict=True)]
            children.append((begin, len(nodes)))
            at += 1
        self.lo, self.hi, self.start, self.end = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        self.child, self.child_end = (np.array([c[i] for c in children], np.int64) for i in range(2))
        self.least = np.array([self.size[n[0] : n[1]].min() for n in nodes], np.int64)
        self.most = np.array([self.size[n[0] : n[1]].max() for n in nodes], np.int64)

    def similar(self, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs (numbers of given sets) are similar.

        The queries descend all at once.  A query goes into a subtree only if one of its partners is in it
        and the sizes and remaining lengths there leave room for the overlap; what partners share is counted once.
        """
        out = np.zeros(len(left), bool)
        if not len(left):
            return out
        a, b = self.place[left], self.place[right]
        n = len(self.size)
        pair = a * n + b
        order = np.argsort(pair)
        pair = pair[order]
        items = np.repeat(np.arange(n), self.size) * self.n_ranks + self.ranks  # ascending: sets in order, items in order
        hit = np.zeros(len(pair), bool)
        queries = np.unique(a)
        zero = np.zeros(len(queries), np.int64)
        stack = [(queries, zero, zero, zero)]  # query, node, depth reached, overlap so far
        while stack:
            q, t, d, o = stack.pop()
            length = np.minimum(self.end[t] - d, EDGE)
            total = np.cumsum(length)
            if total[-1] > STEP_ITEMS and len(q) > 1:
                half = max(1, min(len(q) - 1, int(np.searchsorted(total, total[-1] // 2))))
                stack += [(q[half:], t[half:], d[half:], o[half:]), (q[:half], t[:half], d[:half], o[:half])]
                continue
            state = np.repeat(np.arange(len(q)), length)
            run = self.ranks[np.arange(len(state)) - np.repeat(total - length, length) + (self.first[self.lo[t]] + d)[state]]
            probe = q[state] * self.n_ranks + run
            at = np.searchsorted(items, probe)
            same = items[np.minimum(at, len(items) - 1)] == probe
            o = o + np.bincount(state[same], minlength=len(q))
            d = d + length
            # how many items of the query lie behind the last one looked at
            passed = np.zeros(len(q), np.int64)
            some = length > 0
            passed[some] = (at + same)[total[some] - 1] - self.first[q[some]]
            if not some.all():  # an edge without items: what was passed before it
                rest = np.flatnonzero(~some & (d > 0))
                probe = q[rest] * self.n_ranks + self.ranks[self.first[self.lo[t[rest]]] + d[rest] - 1]
                passed[rest] = np.searchsorted(items, probe, "right") - self.first[q[rest]]
            behind = self.size[q] - passed
            best = np.minimum(np.maximum(d + behind, self.least[t]), self.most[t])  # the size with most room
            alive = np.flatnonzero(o + np.minimum(behind, best - d) >= needed(self.size[q], best, percent))
            q, t, d, o = q[alive], t[alive], d[alive], o[alive]
            ended = d == self.end[t]
            leaf = np.flatnonzero(ended & (self.child[t] == self.child_end[t]))
            if len(leaf):
                ql, s = q[leaf], self.lo[t[leaf]]
                good = o[leaf] >= needed(self.size[ql], self.size[s], percent)
                at = np.searchsorted(pair, (ql * n + s)[good])
                found = at[pair[np.minimum(at, len(pair) - 1)] == (ql * n + s)[good]]
                hit[found] = True
            on = np.flatnonzero(~ended)
            if len(on):
                stack.append((q[on], t[on], d[on], o[on]))
            inner = np.flatnonzero(ended & (self.child[t] < self.child_end[t]))
            if len(inner):
                width = (self.child_end - self.child)[t[inner]]
                of = np.repeat(inner, width)
                t2 = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + self.child[t[of]]
                wanted = np.searchsorted(pair, q[of] * n + self.lo[t2]) < np.searchsorted(pair, q[of] * n + self.hi[t2])
                if wanted.any():
                    of, t2 = of[wanted], t2[wanted]
                    stack.append((q[of], t2, d[of], o[of]))
        out[order] = hit
        if len(pair) > 1:  # pairs given more than once
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            out[order] = np.repeat(np.logical_or.reduceat(hit, first), np.diff(np.concatenate([first, [len(pair)]])))
        return out
