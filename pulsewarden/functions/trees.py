"""Isolation trees grown level by level, with choices that depend on a node's place alone.

Which rows a tree has, which feature a node splits and where are hashes of the seed, the tree and the node, so a tree comes
out the same whoever grows it: in one go, or its top by sums over partitions and the rest from the rows of its nodes.
Nodes are numbered as in a heap: the root is 1, the children of k are 2k and 2k + 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def mixed(*parts) -> np.ndarray:
    """64 bits from integers or arrays of them (a chain of splitmix64 steps)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            x = np.asarray(part).astype(np.int64).view(np.uint64) if np.ndim(part) else np.uint64(int(part) & ((1 << 64) - 1))
            h = (h ^ x) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def unit(*parts) -> np.ndarray:
    """A number from 0 up to 1."""
    return (mixed(*parts) >> np.uint64(11)) / float(1 << 53)


class Plan(NamedTuple):
    """How the trees of one key are grown."""

    seed: int
    trees: int
    row_share: float
    features: int
    feature_share: float
    rows: int  # of the key, all in all

    @property
    def sample(self) -> int:
        return max(1, round(self.row_share * self.rows))

    @property
    def limit(self) -> int:
        return int(np.ceil(np.log2(max(self.sample, 2))))

    def allowed(self, tree: int) -> np.ndarray:
        order = np.argsort(unit(self.seed, tree, -1, np.arange(self.features)), kind="stable")
        return np.sort(order[: max(1, int(self.feature_share * self.features))])

    def member(self, row_hash: np.ndarray, tree: int) -> np.ndarray:
        """Whether rows are in a tree's sample: each with the chance of row_share, without repeats."""
        return unit(self.seed, tree, -2, row_hash) < self.row_share


def choose(plan: Plan, tree: int, node: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each node from the bounds of its rows (nodes by features); feature -1 for a leaf.

    The feature is drawn from the tree's own that are not constant in the node, the cut is uniform between its bounds.
    """
    spread = np.zeros(low.shape, bool)
    of = plan.allowed(tree)
    spread[:, of] = high[:, of] > low[:, of]
    usable = spread.sum(axis=1)
    depth = np.frexp(node.astype(float))[1] - 1
    leaf = (usable == 0) | (n < 2) | (depth >= plan.limit)
    pick = np.minimum((unit(plan.seed, tree, -3, node) * usable).astype(int), np.maximum(usable - 1, 0))
    feature = (np.cumsum(spread, axis=1) == (pick + 1)[:, None]).argmax(axis=1)
    at = np.arange(len(node))
    a, b = low[at, feature], high[at, feature]
    cut = a + unit(plan.seed, tree, -4, node) * (b - a)
    cut = np.where(cut <= a, np.nextafter(a, b), cut)
    return np.where(leaf, -1, feature), np.where(leaf, 0.0, cut)


def grow(plan: Plan, tree: int, values: np.ndarray, root: int = 1) -> tuple[np.ndarray, ...]:
    """(node, feature, cut, n) of the subtree below `root` from its rows, breadth first; rows go left below the cut."""
    found = []
    node = np.full(len(values), root, np.int64)
    rows = np.arange(len(values))
    while len(rows):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        x = values[rows]
        low, high = np.minimum.reduceat(x, edge), np.maximum.reduceat(x, edge)
        n = np.diff(np.append(edge, len(rows)))
        feature, cut = choose(plan, tree, node[edge], low, high, n)
        found.append((node[edge], feature, cut, n))
        f, c = np.repeat(feature, n), np.repeat(cut, n)
        going = f >= 0
        rows, node = rows[going], 2 * node[going] + (x[going, f[going]] >= c[going])
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))


def expected(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        full = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, full))


class Tree(NamedTuple):
    """A tree as arrays in breadth-first order: feature (-1: leaf), cut, place of the left child (the right follows), path length of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray

    def paths(self, values: np.ndarray) -> np.ndarray:
        """Path length of each row."""
        at = np.zeros(len(values), np.int64)
        rows = np.arange(len(values)) if len(self.feature) and self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            here = at[rows]
            at[rows] = self.left[here] + (values[rows, self.feature[here]] >= self.cut[here])
            rows = rows[self.feature[at[rows]] >= 0]
        return self.depth[at]


def packed(node: np.ndarray, feature: np.ndarray, cut: np.ndarray, n: np.ndarray) -> Tree:
    """A Tree from its nodes in any order."""
    order = np.argsort(node, kind="stable")
    node, feature, cut, n = node[order], feature[order], cut[order], n[order]
    left = np.searchsorted(node, 2 * node)
    depth = np.frexp(node.astype(float))[1] - 1 + expected(n)
    return Tree(feature.astype(np.int16), cut.astype(float), np.where(feature >= 0, left, -1).astype(np.int32), np.where(feature >= 0, 0.0, depth).astype(np.float32))
