"""A tree of cuts through points of few components, with the box that each node's points fill.

A query's distance to a box is the least that it can have to any point in it. It goes down the tree to one leaf, and then
only into nodes whose box is not beyond its k-th neighbour so far; so its work grows with the leaves that it has to look
at, not with all leaves, and boxes stay tight for queries that lie beside all points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Allowance for rounding in distances to boxes, relative to them.
SLACK = 1e-9


class Boxes:
    """``axis`` and ``cut``: a point goes right if that component is greater. Leaves have no children (-1)."""

    def __init__(self, sample: np.ndarray, most: int):
        """Halve the sample along the longest side until no node has more than ``most`` points or unequal ones."""
        axis, cut, left, right, todo = [0], [0.0], [-1], [-1], [(0, sample)]
        while todo:
            node, rows = todo.pop()
            spans = np.ptp(rows, axis=0) if len(rows) > max(most, 1) else np.zeros(1)
            if not spans.max() > 0:
                continue
            axis[node] = int(spans.argmax())
            values = np.sort(rows[:, axis[node]])
            middle = values[(len(values) - 1) // 2]
            cut[node] = middle if middle < values[-1] else values[values < values[-1]][-1]
            above = rows[:, axis[node]] > cut[node]
            left[node], right[node] = len(axis), len(axis) + 1
            for half in (rows[~above], rows[above]):
                todo.append((len(axis), half))
                axis.append(0), cut.append(0.0), left.append(-1), right.append(-1)
        self.axis, self.cut, self.left, self.right = np.array(axis), np.array(cut), np.array(left), np.array(right)

    def leaf(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        while len(inner := np.flatnonzero(self.left[at] >= 0)):
            n = at[inner]
            at[inner] = np.where(v[inner, self.axis[n]] > self.cut[n], self.right[n], self.left[n])
        return at

    def fill(self, table: pd.DataFrame) -> Boxes:
        """Take the ranges and sizes of the leaves (_part, _rows, _low, _high); inner nodes hold those below them."""
        shape = (len(self.axis), len(table["_low"].iloc[0]))
        self.rows, self.low, self.high = np.zeros(shape[0], np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        part = table["_part"].to_numpy()
        self.rows[part], self.low[part], self.high[part] = table["_rows"], np.stack(table["_low"].to_numpy()), np.stack(table["_high"].to_numpy())
        for n in range(shape[0] - 1, -1, -1):  # children come after their parent
            if self.left[n] >= 0:
                a, b = self.left[n], self.right[n]
                self.rows[n], self.low[n], self.high[n] = self.rows[a] + self.rows[b], np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
        return self

    def least(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        beside = np.maximum(np.maximum(self.low[at] - v, v - self.high[at]), 0.0)
        return np.sqrt((beside * beside).sum(axis=1)) * (1 - SLACK)

    def most(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        across = np.maximum(np.abs(v - self.low[at]), np.abs(v - self.high[at]))
        return np.sqrt((across * across).sum(axis=1)) * (1 + SLACK)

    def first(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaf to look at first, and a distance within which k points must lie."""
        at = np.zeros(len(v), np.int64)
        reach = self.most(v, at) if self.rows[0] >= k else np.full(len(v), np.inf)
        while len(inner := np.flatnonzero(self.left[at] >= 0)):
            some, a, b = v[inner], self.left[at[inner]], self.right[at[inner]]
            near_a, near_b, far_a, far_b = self.least(some, a), self.least(some, b), self.most(some, a), self.most(some, b)
            go_a = (near_a < near_b) | ((near_a == near_b) & (far_a <= far_b))
            at[inner] = np.where(go_a, a, b)
            for side, far in ((a, far_a), (b, far_b)):
                reach[inner] = np.where(self.rows[side] >= k, np.minimum(reach[inner], far), reach[inner])
        return at, reach

    def reached(self, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a leaf that may hold a point within its distance."""
        query, at, found = np.arange(len(v)), np.zeros(len(v), np.int64), []
        while len(query):
            near = self.least(v[query], at) <= r[query]
            query, at = query[near], at[near]
            inner = self.left[at] >= 0
            found.append((query[~inner], at[~inner]))
            query, at = query[inner], at[inner]
            query, at = np.concatenate([query, query]), np.concatenate([self.left[at], self.right[at]])
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])
