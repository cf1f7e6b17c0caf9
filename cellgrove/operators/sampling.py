"""Choosing samples: greedy pruning by composition variance."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removals(points: np.ndarray, keep: int) -> list[int]:
    """Rows in the order in which they go, until ``keep`` (one at least) are left.

    Leaving out a row takes n / (n - 1) of its squared distance from the mean off the
    sum of squares, so the row that goes is the one farthest from the mean of what is
    left; the first of equals, up to rounding.  Rows are sorted by distance from a
    mean of before: the mean has moved little since, so only the first of them can be
    the farthest.  When they grow many, all are sorted anew.
    """
    n, gone = len(points), []
    if not n:
        return gone
    points = points - points.mean(axis=0)
    scale = float(np.abs(points).max()) or 1.0
    total, left, alive = points.sum(axis=0), n, np.ones(n, bool)

    def far(rows, centre):
        return np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))

    order = None
    while left > keep and left >= 2:
        centre = total / left
        if order is None:
            rows, start, base = np.flatnonzero(alive), 0, centre
            order = rows[np.argsort(-far(rows, base), kind="stable")]
            reach = far(order, base)
        while not alive[order[start]]:
            start += 1
        moved = float(np.sqrt(((centre - base) ** 2).sum()))
        # the first row alive is at least so far from the mean now, so no row nearer than this is the farthest
        least = float(reach[start]) - 2 * moved - 1e-9 * scale
        stop = start + int(np.searchsorted(-reach[start:], -least, "right"))
        window = order[start:stop]
        window = window[alive[window]]
        d = far(window, centre)
        worst = int(window[d >= d.max() - 1e-12 * scale].min())
        alive[worst] = False
        gone.append(worst)
        total, left = total - points[worst], left - 1
        if stop - start > 256 + 2 * int(left ** 0.5):
            order = None
    return gone


def prune(shares: DataFrame, group: str, sample: str, columns, keep: int = 3) -> DataFrame:
    """(group, sample, step): samples to archive, worst first.

    Of each group with two samples or more, the sample whose removal leaves the
    least mean variance of the columns goes, until ``keep`` are left; the first by
    name goes among equals.  One group is a few numbers of each sample of a condition.
    """
    def run(pdf):
        pdf = pdf.sort_values(sample)
        names = pdf[sample].to_numpy()
        gone = removals(pdf[list(columns)].fillna(0.0).to_numpy(float), keep)
        return pd.DataFrame({group: pdf[group].iloc[0], sample: names[gone], "step": range(1, len(gone) + 1)})

    kinds = {c: shares.schema[c].dataType.simpleString() for c in (group, sample)}
    return shares.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {sample} {kinds[sample]}, step int")


def condition_key(name, folder):
    """The condition that a file name begins with: its first part, or its first two where the experiment's folder names a morphogen."""
    parts = F.split(F.replace(name, F.lit(".csv"), F.lit("")), "_")
    both = F.contains(F.upper(folder), F.lit("BMP4")) | F.contains(F.upper(folder), F.lit("WNT"))
    return F.array_join(F.slice(parts, 1, F.when(both, 2).otherwise(1)), "_")


def prune_files(shares: DataFrame, columns, keep: int = 3) -> DataFrame:
    """(experiment, replicate, condition, file, step): files to archive of shares by (experiment, replicate, file)."""
    s = shares.withColumn("condition", condition_key(F.col("file"), F.col("experiment")))
    s = s.withColumn("_group", F.concat_ws("\t", "experiment", "replicate", "condition"))
    part = lambda i: F.element_at(F.split("_group", "\t"), i)
    return prune(s, "_group", "file", columns, keep).select(part(1).alias("experiment"), part(2).alias("replicate"), part(3).alias("condition"), "file", "step")
