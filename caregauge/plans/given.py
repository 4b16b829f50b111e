"""A forest given by a rule, so that the walk over a node table can be checked in SQL.

Complete binary trees. Thresholds lie at sixteenths of a feature's range and leaves hold thirty-seconds, so that sums
are exact in any order.
"""

from __future__ import annotations

from ..operators.fixed import FOREST_FEATURES

TREES = 16
DEPTH = 4

# Ranges of the features, in their order.
RANGES = ((16, 96), (0, 32), (0, 8), (0, 8), (0, 8), (0, 4), (0, 64), (0, 131072), (0, 16384), (0, 131072), (0, 16))


def forest_rows() -> list[tuple[int, int, int, float | None, int, int, float]]:
    """Rows of a node table: tree, node, feature, threshold, left, right, share."""
    inner = 2**DEPTH - 1
    found = []
    for tree in range(TREES):
        for node in range(2 * inner + 1):
            share = (tree * 11 + node * 7) % 32 / 32
            if node >= inner:
                found.append((tree, node, -1, None, -1, -1, share))
                continue
            feature = (tree * 5 + node * 3) % len(FOREST_FEATURES)
            low, high = RANGES[feature]
            threshold = low + (high - low) * ((tree * 7 + node * 13) % 15 + 1) / 16
            found.append((tree, node, feature, threshold, 2 * node + 1, 2 * node + 2, share))
    return found
