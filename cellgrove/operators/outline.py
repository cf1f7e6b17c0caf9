"""Boxes and outermost points of groups of points, by one aggregation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The axes and the diagonals of a box, and sixteen ways in the plane; each is looked along both ways.
SPACE = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1)]
PLANE = [(1, 0), (0, 1), (1, 1), (1, -1), (2, 1), (1, 2), (2, -1), (1, -2)]


def outlines(points: DataFrame, by, axes: str = "xyz", directions=None) -> DataFrame:
    """(by, lo_*, hi_*, tips): the box and the outermost point in each direction of every group; tips are structs of the axes."""
    directions = directions or (SPACE if len(axes) == 3 else PLANE)
    out = [f(c).alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]
    for i, d in enumerate(directions):
        along = F.col(axes[0]) * float(d[0])
        for c, w in zip(axes[1:], d[1:]):
            along = along + F.col(c) * float(w)
        # one aggregate sees rows in one order, so the coordinates of a tip are one point's, also in ties
        out += [f(c, along).alias(f"{n}{i}_{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in axes]
    tips = F.array(*(F.struct(*(F.col(f"{n}{i}_{c}").alias(c) for c in axes)) for i in range(len(directions)) for n in "ab"))
    return points.groupBy(*by).agg(*out).select(*by, *(f"{n}_{c}" for c in axes for n in ("lo", "hi")), tips.alias("tips"))
