"""Spatial autocorrelation over a distance band; an isolated cell has no neighbours."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.draws import digests, draw, ranked
from cellgrove.operators.local import near, places
from cellgrove.operators.neighbors import pairs
from cellgrove.schema import BAND


def lags(cells: DataFrame, channels, band: float = BAND) -> DataFrame:
    """``cells`` with lag_<channel> (mean over neighbours, NULL for an isolated cell) of complete cells."""
    c = cells
    for ch in channels:
        c = c.where(F.col(ch).isNotNull())
    p = pairs(c, band, keep=("cell_id", *channels)).where("a_cell_id <> b_cell_id")
    m = p.groupBy("organoid_id", F.col("a_cell_id").alias("cell_id")).agg(*(F.avg(f"b_{ch}").alias(f"lag_{ch}") for ch in channels))
    return c.join(m, ["organoid_id", "cell_id"], "left")


def local_moran(cells: DataFrame, channel: str, band: float = BAND) -> DataFrame:
    """(organoid_id, cell_id, z, lag, local_i, n, s0, ss); rows are weights of sum one."""
    stats = cells.where(F.col(channel).isNotNull()).groupBy("organoid_id").agg(F.avg(channel).alias("m"), F.stddev_pop(channel).alias("sd"), F.count("*").alias("n")).where("n >= 2 AND sd > 0")
    l = lags(cells, [channel], band).join(stats, "organoid_id")
    l = l.withColumn("z", (F.col(channel) - F.col("m")) / F.col("sd")).withColumn("lag", F.coalesce((F.col(f"lag_{channel}") - F.col("m")) / F.col("sd"), F.lit(0.0)))
    # the sum of z squared is n, as the deviation is the population's
    return l.withColumn("local_i", (F.col("n") - 1) * F.col("z") * F.col("lag") / F.col("n")).withColumn("joined", F.col(f"lag_{channel}").isNotNull())


def morans_i(cells: DataFrame, channel: str, band: float = BAND) -> DataFrame:
    l = local_moran(cells, channel, band)
    return l.groupBy("organoid_id").agg((F.sum(F.col("z") * F.col("lag")) / F.nullif(F.count_if("joined"), F.lit(0))).alias("morans_i"))


#: Cells of one sample from which its permutations are joins, not one task.
SPREAD_FROM = 100_000


def permutation_p(cells: DataFrame, channel: str, band: float = BAND, rounds: int = 99, seed: int = 0, method: str = "auto") -> DataFrame:
    """(organoid_id, morans_i, p_sim): one-sided pseudo p-value from seeded shuffles of values over places.

    In every round the cells of a sample are ranked by a digest of (seed, round, cell),
    and the values move to the places of that rank, which round 0 numbers.  Values
    that are all equal, or cells without neighbours, have neither figure.  method:
    ``task`` takes each sample in one task, ``spread`` joins; ``auto`` joins for samples
    of at least ``SPREAD_FROM`` cells.
    """
    c = cells.where(F.col(channel).isNotNull()).select("organoid_id", "cell_id", *"xyz", F.col(channel).alias("v"))
    stats = c.groupBy("organoid_id").agg(F.count("*").alias("n"))
    if method == "auto":
        most = stats.agg(F.max("n")).first()[0] or 0
        if most >= SPREAD_FROM:
            large = stats.where(F.col("n") >= SPREAD_FROM).select("organoid_id")
            parts = [(c.join(large, "organoid_id", "left_anti"), "task"), (c.join(large, "organoid_id", "left_semi"), "spread")]
            one, two = (permutation_p(x, "v", band, rounds, seed, m) for x, m in parts)
            return one.unionByName(two)
    sums = _sums_by_join(c, band, rounds, seed) if method == "spread" else _sums_in_tasks(c, band, rounds, seed)
    i = F.max(F.when(F.col("round") == 0, F.col("i")))
    found = sums.groupBy("organoid_id").agg(i.alias("morans_i"), F.collect_list(F.when(F.col("round") > 0, F.col("i"))).alias("sims"))
    # equal arrangements differ in the last digits only, and count as not below
    above = F.size(F.filter("sims", lambda s: s >= F.col("morans_i") - 1e-9))
    found = found.select("organoid_id", "morans_i", ((F.least(above, rounds - above) + 1) / (rounds + 1)).alias("p_sim"))
    return stats.select("organoid_id").join(found, "organoid_id", "left")


def _sums_in_tasks(c: DataFrame, band: float, rounds: int, seed: int) -> DataFrame:
    """(organoid_id, round, i) of samples whose values differ, each sample in one task; a cell is sent once."""
    known: dict = {}

    def run(table: pa.Table) -> pa.Table:
        v, ids, p = table.column("v").to_numpy(), table.column("cell_id").to_numpy(), places(table)
        order = np.argsort(ids, kind="stable")
        v, ids, p = v[order], ids[order], p[order]
        sd, there = v.std(), np.flatnonzero(np.isfinite(p).all(axis=1))
        a, b, _ = near(p[there], band)
        a, b = there[a[a != b]], there[b[a != b]]
        degree = np.bincount(a, minlength=len(v))
        if len(v) < 2 or not sd > 0 or not len(a):
            out = np.array([])
        else:
            z, share, joined = (v - v.mean()) / sd, 1 / degree[a], float((degree > 0).sum())
            # cells by their draw, then by number; numbers are sorted already
            ranks = [np.argsort(digests(seed, i, ids, known), kind="stable") for i in range(rounds + 1)]
            out, held = np.empty(rounds + 1), np.empty(len(v))
            for i, rank in enumerate(ranks):
                held[ranks[0]] = z[rank]
                out[i] = (share * held[a] * held[b]).sum() / joined
        return pa.Table.from_arrays([pa.repeat(table.column("organoid_id")[0], len(out)), pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["organoid_id", "round", "i"])

    kind = c.schema["organoid_id"].dataType.simpleString()
    return c.groupBy("organoid_id").applyInArrow(run, f"organoid_id {kind}, round int, i double")


def _sums_by_join(c: DataFrame, band: float, rounds: int, seed: int) -> DataFrame:
    """(organoid_id, round, i): a cell carries its values of all rounds, so one table of neighbours serves them."""
    stats = c.groupBy("organoid_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))
    z = c.join(stats.where("n >= 2 AND sd > 0"), "organoid_id").select("organoid_id", "cell_id", ((F.col("v") - F.col("m")) / F.col("sd")).alias("z"))
    turns = z.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    turns = ranked(turns, ["organoid_id", "round"], draw(seed, F.col("round"), F.col("cell_id")), "cell_id", "place")
    places = turns.where("round = 0").select("organoid_id", "place", "cell_id", F.col("z").alias("own"))
    moved = places.join(turns.where("round > 0").select("organoid_id", "place", "round", "z"), ["organoid_id", "place"])
    held = moved.groupBy("organoid_id", "cell_id").agg(F.concat(F.array(F.first("own")), F.transform(F.sort_array(F.collect_list(F.struct("round", "z"))), lambda s: s["z"])).alias("zs"))
    near = pairs(c, band, keep=("cell_id",)).where("a_cell_id <> b_cell_id").select("organoid_id", "a_cell_id", "b_cell_id")
    degree = near.groupBy("organoid_id", "a_cell_id").agg(F.count("*").alias("k"))
    side = lambda x: held.select("organoid_id", F.col("cell_id").alias(f"{x}_cell_id"), F.col("zs").alias(x))
    edges = near.join(degree.join(side("a"), ["organoid_id", "a_cell_id"]), ["organoid_id", "a_cell_id"]).join(side("b"), ["organoid_id", "b_cell_id"])
    products = edges.select("organoid_id", "k", F.posexplode(F.zip_with("a", "b", lambda x, y: x * y)).alias("round", "zz"))
    sums = products.groupBy("organoid_id", "round").agg((F.sum(F.col("zz") / F.col("k")) / F.round(F.sum(1 / F.col("k")))).alias("i"))
    return sums


def lisa_cluster_mean(clustered: DataFrame, channel: str, band: float = BAND) -> DataFrame:
    """Mean local statistic over cells in clusters."""
    return local_moran(clustered, channel, band).where("cluster_id >= 0").groupBy("organoid_id").agg(F.avg("local_i").alias("lisa_mean"))


def spatial_power(cells: DataFrame, a: str, b: str, band: float = BAND) -> DataFrame:
    """(organoid_id, power_a, power_b): absolute first component of the two channels' neighbour means.

    The 2 x 2 covariance has its leading vector in closed form.
    """
    s = cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy("organoid_id").agg(*(f(c).alias(f"{n}_{k}") for k, c in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).where("s_a > 0 AND s_b > 0")
    l = lags(cells, [a, b], band).join(s, "organoid_id")
    u = lambda k, c: (F.coalesce(f"lag_{c}", c) - F.col(f"m_{k}")) / F.col(f"s_{k}")
    l = l.select("organoid_id", u("a", a).alias("u"), u("b", b).alias("v"))
    m = l.groupBy("organoid_id").agg(F.var_samp("u").alias("p"), F.covar_samp("u", "v").alias("q"), F.var_samp("v").alias("r"))
    m = m.withColumn("top", (F.col("p") + F.col("r") + F.sqrt((F.col("p") - F.col("r")) * (F.col("p") - F.col("r")) + 4 * F.col("q") * F.col("q"))) / 2)
    norm = F.sqrt(F.col("q") * F.col("q") + (F.col("top") - F.col("p")) * (F.col("top") - F.col("p")))
    axis = lambda first: F.when((F.col("p") >= F.col("r")) == F.lit(first), 1.0).otherwise(0.0)
    return m.select("organoid_id", F.when(norm > 0, F.abs(F.col("q")) / norm).otherwise(axis(True)).alias("power_a"), F.when(norm > 0, F.abs(F.col("top") - F.col("p")) / norm).otherwise(axis(False)).alias("power_b"))
