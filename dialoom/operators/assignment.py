"""Optimal one-to-one assignment per group: small score matrices, one per recording."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def solve(score: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs maximizing the total score (shortest augmenting paths with potentials)."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score).astype(float)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m] = i  # column m is the virtual start
        j, low, back, done = m, np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            row = owner[j]
            step = cost[row] - u[row] - v[:m]
            better = ~done[:m] & (step < low[:m])
            low[:m][better], back[:m][better] = step[better], j
            nxt = int(np.argmin(np.where(done[:m], np.inf, low[:m])))
            d = low[nxt]
            used = np.flatnonzero(done)
            u[owner[used]] += d
            v[used] -= d
            low[:m][~done[:m]] -= d
            j = nxt
        while j != m:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def best_pairs(cells: DataFrame, keys: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """Cells (keys, left, right, score) -> the chosen pairs. A group is one speaker-by-speaker matrix."""
    keys = list(keys)
    schema = T.StructType([*[cells.schema[k] for k in keys], cells.schema[left], cells.schema[right],
                           T.StructField(score, T.DoubleType())])

    def run(key, pdf):
        mat = pdf.pivot_table(index=left, columns=right, values=score, aggfunc="sum", fill_value=0.0).sort_index()
        rows = [(*key, mat.index[r], mat.columns[c], float(mat.iat[r, c])) for r, c in solve(mat.to_numpy(float))]
        return pd.DataFrame(rows, columns=[*keys, left, right, score])

    return cells.select(*keys, left, right, score).groupBy(*keys).applyInPandas(run, schema)
