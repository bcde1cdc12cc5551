"""Nearest items of a part, exactly: blocks of dense vectors multiplied, and groups of items left out that an angle bound rules out."""

from __future__ import annotations

import numpy as np

PIVOTS = 32
SLACK = 1e-9  # by which a product of blocks may be off


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, their lengths before); each length is summed from left to right."""
    norms = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1]) if rows.size else np.zeros(len(rows))
    return rows / np.where(norms > 0, norms, 1)[:, None], norms


def spread_out(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of some unit rows, each the one farthest from those before it."""
    at = [0]
    closest = rows @ rows[0]
    while len(at) < most and closest.min() < 1 - SLACK:
        at.append(int(closest.argmin()))
        closest = np.maximum(closest, rows @ rows[at[-1]])
    return rows[at]


def candidates(queries: np.ndarray, items: np.ndarray, k: int, low: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, item, pairs never multiplied): all pairs of unit rows that can be among a query's k best of these items and reach its `low`.

    Items are grouped round pivots. A query at an angle t from a pivot is at least t - r from every item of
    its group, r being the group's widest angle, so a group beyond a query's k-th best so far is left out.
    `low` is raised to the k-th best.
    """
    n, m = len(queries), len(items)
    pivots = spread_out(items[:: max(1, m // (16 * PIVOTS))], PIVOTS)
    to_pivot = items @ pivots.T
    group = to_pivot.argmax(1)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(pivots) + 1))
    nearest = to_pivot[np.arange(m), group]
    angles = np.arccos(np.clip(queries @ pivots.T, -1, 1))
    bounds = np.full((n, len(pivots)), -np.inf)
    for g in range(len(pivots)):
        if cuts[g] < cuts[g + 1]:
            widest = np.arccos(np.clip(nearest[order[cuts[g] : cuts[g + 1]]].min(), -1, 1))
            bounds[:, g] = np.cos(np.clip(angles[:, g] - widest, 0, np.pi))
    best = np.tile(low[:, None], (1, k))
    kept, left_out = [], 0
    for g in np.argsort(-bounds.mean(0), kind="stable"):
        rows = order[cuts[g] : cuts[g + 1]]
        asked = np.flatnonzero(bounds[:, g] >= low - slack)
        left_out += (n - len(asked)) * len(rows)
        if not len(rows) or not len(asked):
            continue
        scores = queries[asked] @ items[rows].T
        both = np.concatenate((best[asked], scores), axis=1)
        best[asked] = np.partition(both, -k, axis=1)[:, -k:]
        low[asked] = best[asked].min(1)
        q, i = np.nonzero(scores >= (low[asked] - slack)[:, None])
        kept.append((asked[q], rows[i], scores[q, i]))
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64), left_out
    q, i, s = (np.concatenate(x) for x in zip(*kept, strict=True))
    near = s >= low[q] - slack
    return q[near], i[near], left_out


def top(queries: np.ndarray, query_norms: np.ndarray, items: np.ndarray, ranks: np.ndarray, k: int, low: np.ndarray, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, item, cosine, pairs never multiplied) of each query's k best items that reach its `low`; equal ones go by `ranks`.

    Cosines are computed as a sum from left to right over both lengths, whatever block a pair was found in.
    With `digits`, cosines are rounded before they are compared.
    """
    units, norms = unit(items)
    real = np.flatnonzero((norms > 0) & np.isfinite(norms))
    unit_queries, _ = unit(queries)
    slack = SLACK if digits is None else SLACK + 10.0**-digits
    q, i, left_out = candidates(unit_queries, units[real], k, low, slack) if len(real) and len(queries) else (np.empty(0, np.int64), np.empty(0, np.int64), 0)
    i = real[i]
    cosine = np.empty(len(q))
    for start in range(0, len(q), 65_536):
        a, b = q[start : start + 65_536], i[start : start + 65_536]
        cosine[start : start + 65_536] = np.cumsum(items[b] * queries[a], axis=1)[:, -1] / (norms[b] * query_norms[a])
    compared = cosine if digits is None else np.floor(cosine * 10.0**digits + 0.5)
    order = np.lexsort((ranks[i], -compared, q))
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    chosen = order[place < k]
    return q[chosen], i[chosen], cosine[chosen], left_out
