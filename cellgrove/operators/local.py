"""What tasks do with the points of one sample: neighbours within a radius, and groups as columns."""
from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa

#: Points of a sample up to which all are compared, and compared pairs held at once.
ALL_UP_TO, AT_ONCE = 256, 2_000_000


def places(table: pa.Table, axes: str = "xyz") -> np.ndarray:
    """Points of the columns ``axes``; a missing coordinate is NaN."""
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in axes])


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of broadcast points, summed axis by axis as the joins do."""
    out = p[..., 0] - q[..., 0]
    out *= out
    for c in range(1, p.shape[-1]):
        d = p[..., c] - q[..., c]
        d *= d
        out += d
    return out


def _grid_keys(p: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells as whole numbers, and what a step along each axis adds; gaps between cells are narrowed to one empty cell."""
    at = []
    for c in range(p.shape[1]):
        seen, where = np.unique(np.floor(p[:, c] / side), return_inverse=True)
        at.append(np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(seen), 2))]).astype(np.int64)[where])
    step = np.array([np.prod([int(a.max()) + 2 for a in at[c + 1:]], dtype=np.int64) for c in range(len(at))], np.int64)
    return sum(a * s for a, s in zip(at, step)), step


def near(p: np.ndarray, radius: float, sample: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance) of all ordered pairs of points within ``radius``, of one sample each if ``sample`` numbers them from 0; a point is its own neighbour."""
    n, found = len(p), []
    if sample is None and n <= ALL_UP_TO:
        d2 = squares(p[:, None], p[None])
        a, b = np.nonzero(d2 <= radius * radius)
        return a, b, d2[a, b]
    # a hair of room, as quotients are rounded
    key, step = _grid_keys(p, radius * (1 + 1e-9) if radius > 0 else 1.0)
    if sample is not None:  # keys of a sample and of the empty cells around it follow those of the one before
        key = key + sample * (int(key.max(initial=0)) + 2 * int(step.sum()) + 2)
    order = np.argsort(key, kind="stable")
    ranks = key[order]
    for way in product((-1, 0, 1), repeat=p.shape[1] - 1):
        # cells that follow each other along the last axis are one run
        middle = key + sum(w * s for w, s in zip(way, step))
        lo, hi = np.searchsorted(ranks, middle - 1), np.searchsorted(ranks, middle + 1, "right")
        count = hi - lo
        part = np.cumsum(count) // AT_ONCE
        for at in np.split(np.arange(n), np.flatnonzero(np.diff(part)) + 1):
            k = count[at]
            a = np.repeat(at, k)
            b = order[np.repeat(lo[at] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            d2 = squares(p[a], p[b])
            keep = d2 <= radius * radius
            found.append((a[keep], b[keep], d2[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))
