"""Density clusters and what is measured on them."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from cellgrove.operators.closest import closest
from cellgrove.operators.local import near, places
from cellgrove.operators.neighbors import pairs, squared, within
from cellgrove.operators.rounds import Rounds, components, stored
from cellgrove.schema import ENDO, EPS, MESO, MIN_SAMPLES

KEYS = ("organoid_id", "cell_type")


def label(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their clusters from all neighbour pairs (each with itself).

    Clusters are numbered by their first core cell; a border cell joins the lowest
    number among its core neighbours; -1 is noise.
    """
    cells, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[:len(a)], flat[len(a):]
    core = np.bincount(a, minlength=len(cells)) >= least
    inner = core[a] & core[b]
    root = np.arange(len(cells))
    while True:
        low = root.copy()
        np.minimum.at(low, a[inner], root[b[inner]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    number = np.full(len(cells), -1)
    firsts = np.unique(root[core])
    number[core] = np.searchsorted(firsts, root[core])
    rim = ~core[a] & core[b]
    best = np.full(len(cells), len(cells))
    np.minimum.at(best, a[rim], number[b[rim]])
    edge = best < len(cells)
    number[edge] = best[edge]
    return cells, number


def dbscan(cells: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, keys=KEYS, method: str = "auto") -> DataFrame:
    """``cells`` with cluster_id, clustered within each value of ``keys``; see ``dbscan_sweep`` for the method."""
    small, large = _by_size(cells, keys, method)
    parts = []
    if small is not None:
        def run(table: pa.Table, sample: np.ndarray) -> pa.Table:
            row, cells, numbers = labels(table, sample, keys, [(eps, min_samples)])
            number = np.full(len(table) + 1, -1)  # the last one is of rows without an id
            number[cells] = numbers[0]
            return table.append_column("cluster_id", pa.array(number[row].astype(np.int32)))

        parts.append(by_sample(small, keys, run, StructType([*small.schema.fields, StructField("cluster_id", IntegerType())])))
    if large is not None:
        large = stored(large, "cells")  # read twice: searched, and given their labels
        swept = _spread(_near(large.where(F.col(keys[-1]).isNotNull()), [(eps, min_samples)], list(keys)), [(eps, min_samples)], list(keys)).drop("eps", "min_samples")
        parts.append(large.join(swept, [*keys, "cell_id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).select(*cells.columns, "cluster_id"))
    return reduce(DataFrame.unionByName, parts)


#: Cells of one sample from which its clusters are found by joins, not in one task.
SPREAD_FROM = 100_000


def _by_size(cells: DataFrame, keys, method: str):
    """(samples clustered in a task each, samples clustered by joins), None for neither."""
    if method != "auto":
        return (cells, None) if method == "task" else (None, cells)
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) < SPREAD_FROM:
        return cells, None
    large = sizes.where(F.col("size") >= SPREAD_FROM).where(F.col(keys[-1]).isNotNull()).select(*keys)
    return cells.join(large, list(keys), "left_anti"), cells.join(large, list(keys), "left_semi")


def dealt(cells: DataFrame, keys) -> DataFrame:
    """``cells`` by sample over all shuffle partitions: a search costs more than its bytes, by which adaptive execution would draw samples together."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_sample(cells: DataFrame, keys, run, schema) -> DataFrame:
    """``run`` (table, number of each row's sample from 0) over whole samples, as many at a time as a batch holds: most have too few cells to be worth a call each."""
    def first_rows(b: pa.Table) -> np.ndarray:
        """Whether a row is of another sample than the one before."""
        new = np.zeros(len(b), bool)
        for k in keys:
            c = b.column(k).combine_chunks()
            c = pc.add(c, 0.0) if pa.types.is_floating(c.type) else c  # one zero only
            code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return new

    def whole(batches):
        held = []
        for b in batches:
            b = pa.Table.from_batches([b])
            if not len(b):
                continue
            new = first_rows(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), b]) if held else b)
            at = np.flatnonzero(new[1:] if held else new)
            if len(at):
                yield pa.concat_tables([*held, b.slice(0, at[-1])])
                held, b = [], b.slice(at[-1])
            held.append(b)
        if held:
            yield pa.concat_tables(held)

    def each(batches):
        for table in whole(batches):
            yield from run(table.combine_chunks(), np.cumsum(first_rows(table))).to_batches()

    return dealt(cells, keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def labels(table: pa.Table, sample: np.ndarray, keys, params) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The cell of each row (a number by sample and id, -1 without an id), the cells that have a place, and their clusters by each of ``params``; none where the last key is missing."""
    p, ids = places(table), table.column("cell_id")
    named = ids.is_valid().to_numpy()
    ids = ids.fill_null(0).to_numpy().astype(np.int64)
    order = np.lexsort((ids, sample, ~named))
    row = np.full(len(table), -1)
    row[order] = np.cumsum(np.r_[False, (np.diff(ids[order]) != 0) | (np.diff(sample[order]) != 0)][:len(order)])
    row[~named] = -1
    there = np.flatnonzero(np.isfinite(p).all(axis=1) & named & table.column(keys[-1]).is_valid().to_numpy())
    if not len(there):
        return row, there, [there for _ in params]
    a, b, d2 = near(p[there], max(eps for eps, _ in params), sample[there])
    a, b = row[there][a], row[there][b]
    of = np.zeros(len(table), np.int64)
    of[row[there]] = sample[there]
    out = []
    for eps, least in params:
        kept = d2 <= eps * eps
        cells, number = label(a[kept], b[kept], least)
        # clusters are numbered through all samples, in their order
        first = np.full(int(sample[-1]) + 1, len(table))
        np.minimum.at(first, of[cells[number >= 0]], number[number >= 0])
        out.append(np.where(number >= 0, number - first[of[cells]], -1))
    return row, cells, out


def dbscan_sweep(cells: DataFrame, params, keys=KEYS, method: str = "auto") -> DataFrame:
    """(keys, cell_id, eps, min_samples, cluster_id) of the cells with a place, for several parameters from one search at the largest eps.

    method: ``task`` labels each sample in one task; ``spread`` by joins and rounds on
    DataFrames, in bounded memory; ``auto`` takes ``spread`` for samples of at least
    ``SPREAD_FROM`` cells.  The labels are the same.
    """
    keys = list(keys)
    cells = cells.where(F.col(keys[-1]).isNotNull()).select(*dict.fromkeys([*keys, "cell_id", *"xyz"]))
    small, large = _by_size(cells, keys, method)
    parts = []
    if small is not None:
        def run(table: pa.Table, sample: np.ndarray) -> pa.Table:
            row, cells, numbers = labels(table, sample, keys, params)
            rows = np.zeros(len(table), np.int64)
            rows[row[row >= 0]] = np.flatnonzero(row >= 0)
            same, n = table.select([*keys, "cell_id"]).take(np.tile(rows[cells], len(params))), len(cells)
            columns = [pa.array(np.repeat([float(e) for e, _ in params], n)), pa.array(np.repeat([int(m) for _, m in params], n).astype(np.int32)), pa.array(np.concatenate(numbers).astype(np.int32))]
            return pa.Table.from_arrays([*same.columns, *columns], [*keys, "cell_id", "eps", "min_samples", "cluster_id"])

        kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
        parts.append(by_sample(small, keys, run, f"{kinds}, cell_id long, eps double, min_samples int, cluster_id int"))
    if large is not None:
        parts.append(_spread(_near(large, params, keys), params, keys))
    return reduce(DataFrame.unionByName, parts)


def _near(cells: DataFrame, params, keys, method: str = "auto") -> DataFrame:
    return pairs(cells, max(p[0] for p in params), keys=keys, keep=("cell_id",), method=method).select(*keys, "a_cell_id", "b_cell_id", "d2")


def _spread(near: DataFrame, params, keys) -> DataFrame:
    """Core cells by counting, their components by contraction, border cells by the least number among core neighbours."""
    rounds = Rounds(near.sparkSession)
    near = near.withColumnsRenamed({"a_cell_id": "a", "b_cell_id": "b"}).where("a IS NOT NULL AND b IS NOT NULL")
    near = rounds.store("near", near) if len(params) > 1 else near
    parts = []
    for i, (eps, least) in enumerate(params):
        # counted where the pairs were made, and only pairs with a core cell are sent on
        core_a = F.count("*").over(W.partitionBy(*keys, "a")) >= least
        n = rounds.store(f"near{i}", near.where(F.col("d2") <= eps * eps).select(*keys, "a", "b").withColumn("core_a", core_a))
        cells = rounds.store(f"cells{i}", n.where("a = b").select(*keys, F.col("a").alias("cell_id"), F.col("core_a").alias("core")).distinct())
        core = cells.where("core").select(*keys, "cell_id")
        met = rounds.store(f"met{i}", n.where("a <> b AND (a < b OR NOT core_a)").join(core.withColumnRenamed("cell_id", "b"), [*keys, "b"], "left_semi"))
        edges = met.where("core_a AND a < b")
        found = components(edges.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")), keys, rounds).withColumnRenamed("node", "cell_id")
        rooted = core.join(found, [*keys, "cell_id"], "left").withColumn("component", F.coalesce("component", "cell_id"))
        # one row for each cluster: numbers follow their first core cells
        number = F.row_number().over(W.partitionBy(*keys).orderBy("component")) - 1
        numbers = rooted.select(*keys, "component").distinct().withColumn("cluster_id", number)
        numbered = rounds.store(f"core{i}", rooted.join(numbers, [*keys, "component"]).select(*keys, "cell_id", "cluster_id"))
        rim = met.where("NOT core_a").join(numbered.withColumnRenamed("cell_id", "b"), [*keys, "b"])
        rim = rim.groupBy(*keys, F.col("a").alias("cell_id")).agg(F.min("cluster_id").alias("cluster_id"))
        labelled = cells.join(numbered.unionByName(rim), [*keys, "cell_id"], "left")
        parts.append(labelled.select(*keys, "cell_id", F.lit(float(eps)).alias("eps"), F.lit(int(least)).alias("min_samples"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")))
    return reduce(DataFrame.unionByName, parts)


def spine(cells: DataFrame) -> DataFrame:
    """(organoid_id, cell_type) for both lineages of every organoid."""
    return cells.select("organoid_id").distinct().withColumn("cell_type", F.explode(F.array(F.lit(ENDO), F.lit(MESO))))


def metrics(clustered: DataFrame, min_samples: int = MIN_SAMPLES, missing: str = "null") -> DataFrame:
    """(organoid_id, cell_type, n_cells, n_clusters, avg_size) for both lineages of every organoid.

    missing: ``null`` leaves count and size empty for fewer cells than ``min_samples``
    and the size of no cluster empty; ``rows`` counts 0 then; ``zero`` gives 0 for both.
    """
    sizes = clustered.where(F.col("cell_type").isin(ENDO, MESO)).groupBy("organoid_id", "cell_type", "cluster_id").agg(F.count("*").alias("s"))
    m = sizes.groupBy("organoid_id", "cell_type").agg(F.sum("s").alias("n_cells"), F.count_if(F.col("cluster_id") >= 0).alias("n_clusters"), F.avg(F.when(F.col("cluster_id") >= 0, F.col("s"))).alias("avg_size"))
    m = spine(clustered).join(m, ["organoid_id", "cell_type"], "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    count = F.coalesce("n_clusters", F.lit(0))
    if missing == "null":
        count = F.when(F.col("n_cells") >= min_samples, count)
    size = F.coalesce("avg_size", F.lit(0.0)) if missing == "zero" else F.col("avg_size")
    return m.select("organoid_id", "cell_type", "n_cells", count.alias("n_clusters"), size.alias("avg_size"))


def _members(clustered: DataFrame, kind=None) -> DataFrame:
    c = clustered.where(F.col("cluster_id") >= 0)
    c = c if kind is None else c.where(F.col("cell_type") == kind)
    return c.select("organoid_id", "cell_type", F.col("cluster_id").alias("cluster"), *"xyz")


def intra_distance(clustered: DataFrame) -> DataFrame:
    """(organoid_id, cell_type, distance): mean over cluster pairs of one lineage of their least member distance."""
    c = _members(clustered)
    p = closest(c, c, ("organoid_id", "cell_type"), same=True)
    return p.groupBy("organoid_id", "cell_type").agg(F.avg("min_dist").alias("distance"))


def lineage_pairs(clustered: DataFrame) -> DataFrame:
    """(organoid_id, endo, meso, min_dist) of every Endo and Meso cluster of an organoid."""
    a, b = (_members(clustered, t).drop("cell_type") for t in (ENDO, MESO))
    return closest(a, b).select("organoid_id", F.col("i").alias("endo"), F.col("j").alias("meso"), "min_dist")


def inter_distance(clustered: DataFrame) -> DataFrame:
    return lineage_pairs(clustered).groupBy("organoid_id").agg(F.avg("min_dist").alias("distance"))


def centroid_separation(clustered: DataFrame) -> DataFrame:
    """(organoid_id, cell_type, separation): mean distance of cluster centroids, 0 below two clusters."""
    c = clustered.where(F.col("cluster_id") >= 0).groupBy("organoid_id", "cell_type", "cluster_id").agg(*(F.avg(x).alias(x) for x in "xyz"))
    a = c.select("organoid_id", "cell_type", F.col("cluster_id").alias("i"), *(F.col(x).alias(f"a_{x}") for x in "xyz"))
    b = c.select("organoid_id", "cell_type", F.col("cluster_id").alias("j"), *(F.col(x).alias(f"b_{x}") for x in "xyz"))
    p = a.join(b, ["organoid_id", "cell_type"]).where("i < j").groupBy("organoid_id", "cell_type").agg(F.avg(F.sqrt(squared())).alias("separation"))
    return spine(clustered).join(p, ["organoid_id", "cell_type"], "left").withColumn("separation", F.coalesce("separation", F.lit(0.0)))


def sides(clustered: DataFrame) -> DataFrame:
    """(organoid_id, n_endo, n_meso) of each organoid with a cluster."""
    c = clustered.where(F.col("cluster_id") >= 0)
    n = [F.countDistinct(F.when(F.col("cell_type") == t, F.col("cluster_id"))).alias(f"n_{x}") for x, t in (("endo", ENDO), ("meso", MESO))]
    return c.groupBy("organoid_id").agg(*n).where("n_endo + n_meso > 0")


def touching(clustered: DataFrame, threshold: float) -> DataFrame:
    """(organoid_id, endo, meso) of the clusters of both lineages with members within ``threshold``; only cells that near meet."""
    c = clustered.where(F.col("cluster_id") >= 0)
    a, b = (c.where(F.col("cell_type") == t) for t in (ENDO, MESO))
    near = pairs(a, threshold, right=b, keep=("cluster_id",), method="grid" if threshold > 0 else "sample")
    return near.select("organoid_id", F.col("a_cluster_id").alias("endo"), F.col("b_cluster_id").alias("meso")).distinct()


def touched(clustered: DataFrame, threshold: float) -> DataFrame:
    """(organoid_id, cell_type, cluster_id) of clusters that touch one of the other lineage: a semi-join, which makes no row for a pair."""
    c = clustered.where((F.col("cluster_id") >= 0) & F.col("cell_type").isin(ENDO, MESO))
    other = c.withColumn("other", F.when(F.col("cell_type") == ENDO, MESO).otherwise(ENDO)).select("organoid_id", F.col("other").alias("cell_type"), *"xyz")
    return within(c, other, threshold, keys=("organoid_id", "cell_type")).select("organoid_id", "cell_type", "cluster_id").distinct()


def adjacency_pct(clustered: DataFrame, threshold: float) -> DataFrame:
    """(organoid_id, adjacency_pct): share of the minority's clusters that touch the other lineage, where both have clusters; Meso is the minority on a tie."""
    t = touched(clustered, threshold).groupBy("organoid_id").agg(*(F.count_if(F.col("cell_type") == k).alias(f"t_{x}") for x, k in (("endo", ENDO), ("meso", MESO))))
    m = sides(clustered).where("n_endo > 0 AND n_meso > 0").join(t, "organoid_id", "left").na.fill(0, ["t_endo", "t_meso"])
    pct = F.when(F.col("n_endo") < F.col("n_meso"), 100.0 * F.col("t_endo") / F.col("n_endo")).otherwise(100.0 * F.col("t_meso") / F.col("n_meso"))
    return m.select("organoid_id", pct.alias("adjacency_pct"))


def adjacency(clustered: DataFrame, threshold: float) -> DataFrame:
    """One row per organoid with a cluster: sides, touching clusters and three percentages.

    The minority is the lineage with fewer clusters, Meso on a tie; with one side
    empty all percentages are 0.
    """
    n = sides(clustered)
    t = touching(clustered, threshold).groupBy("organoid_id").agg(F.count("*").alias("touching_pairs"), F.countDistinct("endo").alias("endo_touched"), F.countDistinct("meso").alias("meso_touched"))
    m = n.join(t, "organoid_id", "left").na.fill(0, ["touching_pairs", "endo_touched", "meso_touched"])
    endo_less = F.col("n_endo") < F.col("n_meso")
    both = (F.col("n_endo") > 0) & (F.col("n_meso") > 0)
    few, many = F.when(endo_less, F.col("n_endo")).otherwise(F.col("n_meso")), F.when(endo_less, F.col("n_meso")).otherwise(F.col("n_endo"))
    tfew, tmany = F.when(endo_less, F.col("endo_touched")).otherwise(F.col("meso_touched")), F.when(endo_less, F.col("meso_touched")).otherwise(F.col("endo_touched"))
    pct = lambda a, b: F.when(both, 100.0 * a / b).otherwise(0.0)
    return m.select(
        "organoid_id", "n_endo", "n_meso", F.when(endo_less, "Endo").otherwise("Meso").alias("minority"), F.when(endo_less, "Meso").otherwise("Endo").alias("majority"),
        few.alias("n_minority"), many.alias("n_majority"), tfew.alias("minority_touched"), tmany.alias("majority_touched"), "touching_pairs",
        pct(tfew, few).alias("minority_pct"), pct(tmany, many).alias("majority_pct"), pct(F.col("touching_pairs"), F.col("n_endo") + F.col("n_meso")).alias("density_pct"))


def status(cells: DataFrame, clustered: DataFrame, kind: float, min_samples: int) -> DataFrame:
    """Why a cell type does or does not form clusters in each organoid."""
    n = cells.groupBy("organoid_id").agg(F.count_if(F.col("cell_type") == kind).alias("n_cells"))
    k = clustered.where((F.col("cell_type") == kind) & (F.col("cluster_id") >= 0)).groupBy("organoid_id").agg(F.countDistinct("cluster_id").alias("n_clusters"))
    m = n.join(k, "organoid_id", "left").na.fill(0, ["n_clusters"])
    return m.withColumn("status", F.when(F.col("n_cells") == 0, "Zero Cells").when(F.col("n_cells") < min_samples, "Below MS").when(F.col("n_clusters") == 0, "Too Sparse").otherwise("Formed Clusters"))


def centres(clustered: DataFrame) -> DataFrame:
    """Mean place and size of each cluster."""
    return clustered.where(F.col("cluster_id") >= 0).groupBy("organoid_id", "cell_type", "cluster_id").agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in "xyz"))


def first_n(samples: DataFrame, n: int | None, keys=("experiment", "replicate", "dox", "condition"), number: str = "number", tie: str = "organoid_id") -> DataFrame:
    """The ``n`` samples of least number in each group; no number, no place; ``n`` of None or 0: all."""
    if not n or n <= 0:
        return samples
    place = F.row_number().over(W.partitionBy(*keys).orderBy(number, tie))
    return samples.where(F.col(number).isNotNull()).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
