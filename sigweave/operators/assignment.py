"""Maximum-weight bipartite matching, per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOLERANCE = 1e-10


def solve(similarity: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that maximise the sum of 1 + similarity over pairs with a similarity over 0."""
    if similarity.size and (similarity.min() < -TOLERANCE or similarity.max() > 1 + TOLERANCE):
        raise ValueError("similarities must be between 0 and 1")
    return solve_weights(np.where(similarity > 0, 1 + similarity, -np.inf))


def solve_weights(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that maximise the sum of their weights as they are; minus infinity forbids a pair, and a row or column may stay alone.

    Successive shortest augmenting paths on the bipartite graph of allowed edges. Equal sums go to the lower rows and
    columns that are tried first.
    """
    rows, columns = weights.shape
    # each row also has a column of its own with weight 0: staying alone
    size = columns + rows
    cost = np.full((rows, size), np.inf)
    cost[:, :columns] = -weights
    cost[np.arange(rows), columns + np.arange(rows)] = 0.0
    u, v = np.zeros(rows), np.zeros(size)
    owner = np.full(size, -1)
    for row in range(rows):
        distance, back = np.full(size, np.inf), np.full(size, -1)
        done = np.zeros(size, bool)
        at, base, end = row, 0.0, -1
        last = -1
        while True:
            step = base + cost[at] - u[at] - v
            better = ~done & (step < distance - TOLERANCE)
            distance[better], back[better] = step[better], last
            open_ = np.where(done, np.inf, distance)
            last = int(np.argmin(open_))
            base = float(open_[last])
            done[last] = True
            if owner[last] < 0:
                end = last
                break
            at = int(owner[last])
        fixed = np.flatnonzero(done)
        fixed = fixed[fixed != end]
        u[row] += base
        for c in fixed:
            u[owner[c]] += base - distance[c]
            v[c] -= base - distance[c]
        while end >= 0:
            before = int(back[end])
            owner[end] = row if before < 0 else owner[before]
            end = before
    return sorted((int(owner[c]), c) for c in range(columns) if owner[c] >= 0)


def assign(edges: DataFrame, group: str, left: str, right: str, similarity: str = "sim", raw: bool = False) -> DataFrame:
    """(group, left, right, similarity): the best matching of each group's edges; with raw, by the sum of the numbers themselves (edges that aren't there are forbidden). A group is solved in one task, which its dense matrix must fit."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ls, rs = np.sort(pdf[left].unique()), np.sort(pdf[right].unique())
        m = np.full((len(ls), len(rs)), -np.inf if raw else 0.0)
        m[np.searchsorted(ls, pdf[left]), np.searchsorted(rs, pdf[right])] = pdf[similarity]
        pairs = solve_weights(m) if raw else solve(m)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(pairs), left: [ls[i] for i, _ in pairs], right: [rs[j] for _, j in pairs], similarity: [m[p] for p in pairs]})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (group, left, right)) + f", `{similarity}` double"
    allowed = edges.where(f"`{similarity}` IS NOT NULL") if raw else edges.where(f"`{similarity}` > 0")
    return allowed.select(group, left, right, similarity).groupBy(group).applyInPandas(one, schema)


def unmatched(nodes: DataFrame, matching: DataFrame, keys: list[str]) -> DataFrame:
    """Rows or columns (keys, ...) that no pair of a matching holds."""
    return nodes.join(matching.select(*keys).distinct(), keys, "left_anti")


def matched(nodes: DataFrame, matching: DataFrame, keys: list[str]) -> DataFrame:
    """Rows or columns (keys, ...) that a pair of a matching holds."""
    return nodes.join(matching.select(*keys).distinct(), keys, "left_semi")
