"""Boundaries of 0/1 maps and distances between them as array kernels over the cells of one scene."""

from __future__ import annotations

import numpy as np

#: Pairs of target row and source column that are looked at together.
PAIRS = 2_000_000
NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def places(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each cell and the step from row to row; steps of one cell never wrap around."""
    width = int(col.max() - col.min()) + 3
    return (row - row.min()).astype(np.int64) * width + (col - col.min()), width


def look_up(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted number among sorted distinct ``known`` ones, and whether it is there."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def boundary(row: np.ndarray, col: np.ndarray, maps: list[np.ndarray]) -> list[np.ndarray]:
    """Whether a cell is 1 and one of its eight neighbours is 0, for each map; cells that are not listed do not count."""
    place, width = places(row, col)
    known, number = np.unique(place, return_inverse=True)
    zero = [np.zeros(len(known), bool) for _ in maps]
    for z, v in zip(zero, maps, strict=True):
        z[number[v == 0]] = True
    near = [np.zeros(len(place), bool) for _ in maps]
    for dr, dc in NEIGHBOURS:
        at, there = look_up(known, place + dr * width + dc)
        for n, z in zip(near, zero, strict=True):
            n |= there & z[at]
    return [(v == 1) & n for v, n in zip(maps, near, strict=True)]


def nearest_distances(row: np.ndarray, col: np.ndarray, to_row: np.ndarray, to_col: np.ndarray, res_x: float, res_y: float) -> np.ndarray:
    """Distance of each cell to the nearest of the other cells.

    The nearest cell of each column is found by binary search; columns are then taken from the inside out, until
    their own distance alone is as large as the best.
    """
    columns, own = np.unique(to_col, return_inverse=True)
    low = min(row.min(), to_row.min())
    height = int(max(row.max(), to_row.max()) - low) + 1
    known = np.sort(own * height + (to_row - low))
    rows, at_row = np.unique(row, return_inverse=True)
    out = np.empty(len(row))
    chunk = max(1, PAIRS // len(columns))
    base = np.arange(len(columns)) * height
    for start in range(0, len(rows), chunk):
        wanted = base + (rows[start:start + chunk, None] - low)
        at = np.searchsorted(known, wanted)
        after, before = known[np.minimum(at, len(known) - 1)], known[np.maximum(at - 1, 0)]
        down = np.where((at < len(known)) & (after < base + height), after - wanted, np.inf)
        up = np.where((at > 0) & (before >= base), wanted - before, np.inf)
        rise = (np.minimum(down, up) * res_y) ** 2
        left = np.flatnonzero((at_row >= start) & (at_row < start + chunk))
        first = np.searchsorted(columns, col[left])
        line, here, best = at_row[left] - start, col[left], np.full(len(left), np.inf)
        todo, step = np.arange(len(left)), 0
        while len(todo):
            more = np.zeros(len(todo), bool)
            for side in (first[todo] + step, first[todo] - 1 - step):
                ok = (side >= 0) & (side < len(columns))
                t, s = todo[ok], side[ok]
                run = ((columns[s] - here[t]) * res_x) ** 2
                best[t] = np.minimum(best[t], run + rise[line[t], s])
                more[ok] |= run < best[t]
            todo, step = todo[more], step + 1
        out[left] = np.sqrt(best)
    return out


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Linear-interpolated quantile of values that count ``weights`` times."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    rank = q * (upto[-1] - 1)
    lo, hi = (values[order][np.searchsorted(upto, r, side="right")] for r in (np.floor(rank), np.ceil(rank)))
    return float(lo + (hi - lo) * (rank - np.floor(rank)))


def symmetric_distance(
    row: np.ndarray, col: np.ndarray, on_a: np.ndarray, on_b: np.ndarray, res_x: float, res_y: float, weight: np.ndarray | None = None
) -> float:
    """Larger of the two directed 95th percentiles of nearest-boundary distance; NaN where a boundary is empty."""
    if not on_a.any() or not on_b.any():
        return np.nan
    row, col = row.astype(np.int64), col.astype(np.int64)
    w = np.ones(len(row), np.int64) if weight is None else weight
    return max(
        weighted_quantile(nearest_distances(row[p], col[p], row[q], col[q], res_x, res_y), w[p], 0.95) for p, q in ((on_a, on_b), (on_b, on_a))
    )
