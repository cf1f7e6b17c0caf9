"""Mixing of lineages: neighbourhood mixing scores, local mixing, entropy by radius."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.neighbors import neighbour_counts
from cellgrove.schema import ENDO, HALF_SLAB, LINEAGES, MESO, MIXING_RADIUS, NMS_RADIUS

#: mode: (foreign cells are all others, at least so many on both sides, score when no same-type neighbour exists)
MODES = {
    "mean_of_ratios": (True, 10, None),
    "pooled_gt10_zero": (False, 11, 0.0),
    "pooled_ge10_both": (False, 10, 0.0),
    "pooled_gt10_missing": (False, 11, None),
    "endo_only_ge10": (False, 10, 0.0),
}


def scores(counts: DataFrame, totals: DataFrame, i: int, mode: str) -> DataFrame:
    """(organoid_id, nms_endo, nms_meso) from the counts of radius number ``i``."""
    everyone, least, none = MODES[mode]
    names = {"Endo": LINEAGES["Endo"]} if mode == "endo_only_ge10" else LINEAGES
    sums = []
    for name, t in names.items():
        own, foe = (f"endo_{i}", f"meso_{i}") if t == ENDO else (f"meso_{i}", f"endo_{i}")
        mine, same = F.col("cell_type") == t, F.col(f"same_{i}")
        foreign = F.col(f"k_{i}") - F.col(own) if everyone else F.col(foe)
        if mode == "mean_of_ratios":
            sums.append(F.avg(F.when(mine & (same > 0), foreign / same)).alias(f"r_{name}"))
        else:
            sums += [F.sum(F.when(mine, foreign)).alias(f"f_{name}"), F.sum(F.when(mine, same)).alias(f"s_{name}")]
    s = totals.join(counts.groupBy("organoid_id").agg(*sums), "organoid_id", "left")
    out = []
    for name, t in LINEAGES.items():
        n_own, n_other = (F.col("n_endo"), F.col("n_meso")) if t == ENDO else (F.col("n_meso"), F.col("n_endo"))
        foe = F.col("n") - n_own if everyone else n_other
        if name not in names:
            value = F.lit(None).cast("double")
        elif mode == "mean_of_ratios":
            value = F.col(f"r_{name}") / (foe / n_own)
        else:
            empty = F.lit(none).cast("double")
            value = F.when(F.col(f"s_{name}") > 0, (F.col(f"f_{name}") / F.col(f"s_{name}")) / (foe / n_own)).otherwise(empty)
        out.append(F.when((n_own >= least) & (foe >= least), value).alias(f"nms_{name.lower()}"))
    s = s.select("organoid_id", *out)
    if mode == "pooled_gt10_zero":
        return s.where("nms_endo IS NOT NULL OR nms_meso IS NOT NULL")
    return s.where("nms_endo IS NOT NULL AND nms_meso IS NOT NULL") if mode == "pooled_ge10_both" else s


def totals_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("organoid_id").agg(F.count("*").alias("n"), F.count_if(F.col("cell_type") == ENDO).alias("n_endo"), F.count_if(F.col("cell_type") == MESO).alias("n_meso"))


def nms(cells: DataFrame, radius: float = NMS_RADIUS, mode: str = "mean_of_ratios") -> DataFrame:
    """Neighbourhood mixing score by organoid; the modes differ in guards and degenerate values."""
    if not MODES[mode][0]:
        cells = cells.where(F.col("cell_type").isin(ENDO, MESO))
    return scores(neighbour_counts(cells, [radius]), totals_of(cells), 0, mode)


def nms_by_radius(cells: DataFrame, radii, mode: str = "pooled_ge10_both") -> DataFrame:
    """(organoid_id, radius, nms_endo, nms_meso); one join serves all radii."""
    if not MODES[mode][0]:
        cells = cells.where(F.col("cell_type").isin(ENDO, MESO))
    counts, totals, out = neighbour_counts(cells, radii), totals_of(cells), None
    per = [F.struct(F.lit(float(r)).alias("radius"), *(F.col(f"{c}_{i}").alias(f"{c}_0") for c in ("k", "same", "endo", "meso"))) for i, r in enumerate(radii)]
    flat = counts.select("organoid_id", "cell_type", F.inline(F.array(*per)))
    flat = flat.withColumn("organoid_id", F.struct("organoid_id", "radius"))
    spread = totals.withColumn("radius", F.explode(F.array(*(F.lit(float(r)) for r in radii)))).withColumn("organoid_id", F.struct("organoid_id", "radius"))
    out = scores(flat, spread, 0, mode)
    return out.select("organoid_id.organoid_id", "organoid_id.radius", "nms_endo", "nms_meso")


def slab(cells: DataFrame, half: float = HALF_SLAB) -> DataFrame:
    """Cells within ``half`` of the median height of all cells of their organoid; adds z_center."""
    middle = cells.groupBy("organoid_id").agg(F.median("z").alias("z_center"))
    return cells.join(middle, "organoid_id").where(F.col("z").between(F.col("z_center") - half, F.col("z_center") + half))


def centred(cells: DataFrame) -> DataFrame:
    """x and y less their means over the given cells of an organoid."""
    mean = cells.groupBy("organoid_id").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    return cells.join(mean, "organoid_id").withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")}).drop("_mx", "_my")


def local_mixing(cells: DataFrame, radius: float = MIXING_RADIUS, half: float = HALF_SLAB) -> DataFrame:
    """Per cell of the slab: foreign over other neighbours in the plane, 0 for a cell alone."""
    flat = centred(slab(cells, half)).where(F.col("cell_type").isin(ENDO, MESO))
    c = neighbour_counts(flat, [radius], axes="xy")
    foreign = F.when(F.col("cell_type") == ENDO, F.col("meso_0")).otherwise(F.col("endo_0"))
    return c.select("organoid_id", "cell_id", F.when(F.col("k_0") < 2, 0.0).otherwise(foreign / (F.col("k_0") - 1)).alias("local_mixing"))


def entropy_gradient(cells: DataFrame, radii, most: int = 5000, take: int = 1000) -> DataFrame:
    """(organoid_id, radius, entropy): mean Shannon bits of lineage counts around each cell.

    Of an organoid with more than ``most`` cells, ``take`` query cells are drawn by
    a hash, as the statistic samples them; all cells remain neighbours.
    """
    from pyspark.sql import Window as W

    c = cells.where(F.col("cell_type").isin(ENDO, MESO))
    n = F.count("*").over(W.partitionBy("organoid_id"))
    place = F.row_number().over(W.partitionBy("organoid_id").orderBy(F.xxhash64("cell_id"), "cell_id"))
    large = (c.groupBy("organoid_id").count().agg(F.max("count")).first()[0] or 0) > most
    if large:
        c = c.withColumn("_n", n).withColumn("_p", place).withColumn("_asked", (F.col("_n") <= most) | (F.col("_p") <= take))
    counts = neighbour_counts(c, radii, asked="_asked" if large else None)
    per = [F.struct(F.lit(float(r)).alias("radius"), F.col(f"k_{i}").alias("k"), F.col(f"endo_{i}").alias("e"), F.col(f"meso_{i}").alias("m")) for i, r in enumerate(radii)]
    flat = counts.select("organoid_id", F.inline(F.array(*per)))
    bits = lambda x: F.when(F.col(x) > 0, -(F.col(x) / F.col("k")) * F.log2(F.col(x) / F.col("k"))).otherwise(0.0)
    return flat.groupBy("organoid_id", "radius").agg(F.coalesce(F.avg(F.when(F.col("k") >= 2, bits("e") + bits("m"))), F.lit(0.0)).alias("entropy"))
