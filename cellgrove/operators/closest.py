"""Least distances between clusters, without all pairs of the members of large ones.

A cluster shows its members if they are few, else its outermost ones in fourteen
directions.  What is shown is compared, which gives the least distance of two small
clusters and bounds that of others: a member whose distance from the other cluster's
box is beyond the bound cannot be of the closest pair.  What is left of these meets in
a grid with the bound as its side.
"""
from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.neighbors import squared
from cellgrove.operators.outline import outlines
from cellgrove.operators.rounds import stored

AXES = "xyz"
#: Members up to which a cluster shows them all, and up to which clusters are compared whole where none is larger.
FEW, WHOLE = 16, 256


def boxes(members: DataFrame, keys) -> DataFrame:
    """(keys, cluster, size, lo_*, hi_*)."""
    ends = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return members.groupBy(*keys, "cluster").agg(F.count("*").alias("size"), *ends)


def shown(members: DataFrame, box: DataFrame, keys) -> DataFrame:
    """(keys, cluster, size, x, y, z) of the members that stand for their cluster."""
    by = [*keys, "cluster"]
    sized = members.join(box.select(*by, "size"), by).select(*by, "size", *AXES)
    tips = outlines(sized.where(F.col("size") > FEW), [*by, "size"])
    return sized.where(F.col("size") <= FEW).unionByName(tips.select(*by, "size", F.inline(F.array_distinct("tips"))))


def _compared(left: DataFrame, right: DataFrame, keys, same: bool) -> DataFrame:
    """(keys, i, j, largest, bound) of rows (keys, cluster, size, x, y, z): all pairs of two clusters of a sample, each row with each."""
    side = lambda m, n: m.select(*keys, F.col("cluster").alias(n), F.col("size").alias(f"{n}_size"), *(F.col(c).alias(f"{n}_{c}") for c in AXES))
    met = side(left, "i").join(side(right, "j").hint("merge"), list(keys))
    met = met.where("i < j") if same else met
    return met.groupBy(*keys, "i", "j").agg(F.max(F.greatest("i_size", "j_size")).alias("largest"), F.min(squared("i_", "j_")).alias("bound"))


def bounds(left: DataFrame, right: DataFrame, keys, same: bool = False) -> DataFrame:
    """(keys, i, j, largest, bound): each pair of clusters of one sample, the size of the larger and a squared distance that two of their members have; the least one where ``largest`` is at most ``FEW``."""
    return _compared(*(shown(m, boxes(m, keys), keys) for m in (left, right)), keys, same)


def _rim(members: DataFrame, pairs: DataFrame, box: DataFrame, keys, own: str, other: str) -> DataFrame:
    """(keys, i, j, bound, place) of the members that may be of the closest pair of i and j."""
    p = pairs.join(box.withColumnRenamed("cluster", other).drop("size"), [*keys, other])
    gap = [F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in AXES]
    m = members.withColumnRenamed("cluster", own).join(p, [*keys, own])
    # a hair of room, as the gap and the bound are rounded apart
    m = m.where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= F.col("bound") * (1 + 1e-9))
    return m.select(*keys, "i", "j", "bound", *(F.col(c).alias(f"{own}_{c}") for c in AXES))


def met_members(left: DataFrame, right: DataFrame, pairs: DataFrame, keys) -> DataFrame:
    """(keys, i, j, i_*, j_*) of the members of ``pairs`` (keys, i, j, bound) that are compared."""
    a, b = _rim(left, pairs, boxes(right, keys), keys, "i", "j"), _rim(right, pairs, boxes(left, keys), keys, "j", "i")
    side = F.greatest(F.sqrt("bound") * (1 + 1e-9), F.lit(1e-12))
    cell = [f"_g{c}" for c in AXES]
    a = a.withColumns({g: F.floor(F.col(f"i_{c}") / side) for g, c in zip(cell, AXES)}).drop("bound")
    steps = F.array(*(F.struct(*(F.lit(s).alias(g) for s, g in zip(step, cell))) for step in product((-1, 0, 1), repeat=3)))
    b = b.withColumn("_side", side).withColumn("_step", F.explode(steps))
    b = b.withColumns({g: F.floor(F.col(f"j_{c}") / F.col("_side")) + F.col(f"_step.{g}") for g, c in zip(cell, AXES)}).drop("_step", "_side", "bound")
    return a.join(b, [*keys, "i", "j", *cell]).drop(*cell)


def closest(left: DataFrame, right: DataFrame, keys=("organoid_id",), same: bool = False, whole: int = WHOLE) -> DataFrame:
    """(keys, i, j, min_dist) for every pair of a cluster of ``left`` and one of ``right`` (keys, cluster, x, y, z) in one sample; with ``same``, both are one table and i < j.

    Members need finite places.  Where a cluster has more than ``whole`` members,
    members of large clusters are not paired.
    """
    k = list(keys)
    sizes = boxes(left, k).select("size") if same else boxes(left, k).select("size").unionByName(boxes(right, k).select("size"))
    if sizes.where(F.col("size") > whole).isEmpty():  # then no pair of clusters costs much, and bounds would cost more
        p = _compared(*(m.withColumn("size", F.lit(1)) for m in (left, right)), k, same)
        return p.select(*k, "i", "j", F.sqrt("bound").alias("min_dist"))
    p = stored(bounds(left, right, k, same), "bounds")
    met = met_members(left, right, p.where(F.col("largest") > FEW).drop("largest"), k).groupBy(*k, "i", "j").agg(F.min(squared("i_", "j_")).alias("d2"))
    return p.join(met, [*k, "i", "j"], "left").select(*k, "i", "j", F.sqrt(F.least("d2", "bound")).alias("min_dist"))
