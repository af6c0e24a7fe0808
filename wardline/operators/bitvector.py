"""Tree ensembles scored by bit vectors, many rows at a time.

The leaves of a tree are numbered from left to right, one bit each.  A test
``x <= threshold`` that fails rules out the leaves of its left side.  All tests
of one feature, over all trees, are sorted by threshold, so the tests a value
fails are a prefix of the list, and the leaves that prefix rules out are looked
up as one row of a table.  The rows of all features are combined by AND; the
lowest bit left in a tree is the leaf the row falls into.  No step depends on
the depth of a tree, and no row walks one (Lucchese et al., "QuickScorer",
SIGIR 2015).

A tree takes one 64-bit word per 64 leaves.  Tables grow with the square of the
number of trees scored together, so trees are scored in groups whose tables
stay below a bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Bytes of a group's tables; rows whose words are held at once.
TABLE_BYTES, ROWS = 24 << 20, 512
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def leaf_spans(feature: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Leaves of one tree from left to right, and (node, first, end) of the leaves left of each test."""
    leaves: list[int] = []
    spans: list[tuple[int, int, int]] = []
    todo: list[tuple[int, int]] = [(0, -1)]  # a node, or where the left side of a test begins
    while todo:
        node, begun = todo.pop()
        if begun >= 0:
            spans.append((node, begun, len(leaves)))
        elif feature[node] < 0:
            leaves.append(node)
        else:
            todo += [(int(right[node]), -1), (node, len(leaves)), (int(left[node]), -1)]
    return leaves, spans


class Group:
    """Trees that are scored together."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        found = [leaf_spans(f, a, b) for f, _, a, b, _ in trees]
        words = [-(-len(leaves) // 64) for leaves, _ in found]
        # First words of all trees, then the second words of those that have one, ...
        self.layers = [[t for t, w in enumerate(words) if w > k] for k in range(max(words))]
        column = {(t, k): c for c, (k, t) in enumerate((k, t) for k, layer in enumerate(self.layers) for t in layer)}
        self.width = len(column)
        self.value = np.zeros(self.width * 64)
        tests: dict[int, list[tuple[float, int, int]]] = {}
        for t, ((leaves, spans), (feature, threshold, _, _, value)) in enumerate(zip(found, trees)):
            for i, node in enumerate(leaves):
                self.value[column[t, i // 64] * 64 + i % 64] = value[node]
            for node, first, end in spans:
                for k in range(first // 64, (end - 1) // 64 + 1):
                    low, high = max(first - 64 * k, 0), min(end - 64 * k, 64)
                    tests.setdefault(int(feature[node]), []).append(
                        (float(threshold[node]), column[t, k], ((1 << high) - 1) ^ ((1 << low) - 1)))
        self.tests = {f: (np.array([a for a, _, _ in rows]), np.array([b for _, b, _ in rows]), np.array([c for _, _, c in rows], np.uint64))
                      for f, rows in sorted(tests.items())}
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] | None = None

    def prepare(self) -> None:
        """What each prefix of a feature's tests leaves; made once in each worker."""
        self.tables = []
        for f, (threshold, column, mask) in self.tests.items():
            cuts, at = np.unique(threshold, return_inverse=True)
            table = np.full((len(cuts) + 1, self.width), ONES)
            np.bitwise_and.at(table, (at + 1, column), ~mask)
            self.tables.append((f, cuts, np.bitwise_and.accumulate(table, axis=0)))

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]: the value of the leaf each row falls into."""
        if self.tables is None:
            self.prepare()
        state = np.full((len(x), self.width), ONES)
        for f, cuts, table in self.tables:
            values = x[:, f]
            state &= table[np.where(np.isnan(values), 0, np.searchsorted(cuts, values, "left"))]
        lowest = state & (~state + np.uint64(1))
        bit = (lowest.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent of a power of two
        at = np.maximum(bit, 0) + np.arange(self.width) * 64
        out, begin = self.value[at[:, :len(self.layers[0])]], len(self.layers[0])
        empty = state[:, :begin] == 0
        for layer in self.layers[1:]:
            part = slice(begin, begin + len(layer))
            use = empty[:, layer] & (state[:, part] != 0)
            out[:, layer] = np.where(use, self.value[at[:, part]], out[:, layer])
            empty[:, layer] &= ~use
            begin += len(layer)
        return out


class BitVectorScorer:
    """Scores rows against trees given as a table of nodes.

    The table has tree, node (numbered from 0 in each tree, 0 the root), feature
    (-1 on a leaf), threshold, left, right and the named value.  A missing
    number goes left.
    """

    def __init__(self, nodes: pd.DataFrame, value: str, table_bytes: int = TABLE_BYTES):
        trees = []
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
            trees.append((t["feature"].to_numpy(np.int64), t["threshold"].to_numpy(float), t["left"].to_numpy(np.int64),
                          t["right"].to_numpy(np.int64), t[value].to_numpy(float)))
        self.n_trees = len(trees)
        tests = sum(int((t[0] >= 0).sum()) for t in trees)
        words = sum(-(-int((t[0] < 0).sum()) // 64) for t in trees)
        groups = max(1, -(-(tests + 1) * words * 8 // table_bytes))
        size = max(1, -(-len(trees) // groups))
        self.groups = [Group(trees[i:i + size]) for i in range(0, len(trees), size)]

    def leaf_values(self, x: np.ndarray):
        """Chunks of rows: (slice, [row, tree] values)."""
        for low in range(0, len(x), ROWS):
            part = slice(low, min(low + ROWS, len(x)))
            yield part, np.concatenate([g.leaf_values(x[part]) for g in self.groups], axis=1)
