"""What the third round of findings asked for."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import autocorr, clusters, geometry, local, neighbors, sampling

SAMPLE = "organoid_id long, cell_id long, x double, y double, z double, cell_type double, v double"


@pytest.fixture(scope="module")
def cloud(spark):
    """Three samples on a lattice, so many distances are equal to the radius, with a cell without a place or type."""
    r = np.random.default_rng(5)
    rows = [(o, i, *map(float, r.integers(0, 14, 3)), float(r.integers(2, 4)), float(r.integers(0, 9))) for o, n in ((1, 60), (2, 300), (3, 700)) for i in range(n)]
    rows += [(1, 60, None, 1.0, 1.0, 2.0, 4.0), (1, 61, 1.0, 1.0, 1.0, None, 5.0), (1, 62, 1.0, float("nan"), 1.0, 3.0, 6.0)]
    return spark.createDataFrame(rows, SAMPLE).cache()


@pytest.mark.parametrize("n", [1, 40, 900])
def test_near_is_all_pairs(n, monkeypatch):
    p = np.random.default_rng(n).integers(-9, 9, (n, 3)).astype(float) * 0.3
    want = {(i, j) for i in range(n) for j in np.flatnonzero(local.squares(p[i][None], p) <= 0.9 * 0.9)}
    for limit in (0, 10 ** 6):
        monkeypatch.setattr(local, "ALL_UP_TO", limit)
        a, b, _ = local.near(p, 0.9)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_permutations_in_a_task_and_by_joins(cloud):
    one, two = ({r["organoid_id"]: r for r in autocorr.permutation_p(cloud, "v", 3.0, 9, method=m).collect()} for m in ("task", "spread"))
    assert one.keys() == two.keys() == {1, 2, 3}
    for o in one:
        assert one[o]["p_sim"] == two[o]["p_sim"] and one[o]["morans_i"] == pytest.approx(two[o]["morans_i"], abs=1e-9)


def test_permutations_send_a_cell_once(cloud):
    plan = autocorr.permutation_p(cloud, "v", 3.0, 99)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_pruning_of_many_samples_is_the_greedy_one(spark):
    x = np.random.default_rng(3).random((60, 2))
    left, gone = pd.DataFrame(x), []
    while len(left) > 3:
        spread = [left.drop(index=s).var(ddof=1).mean() for s in left.index]
        gone.append(left.index[int(np.argmin(spread))])
        left = left.drop(index=gone[-1])
    assert sampling.removals(x, 3) == gone
    many = spark.range(20_000).select(F.lit("g").alias("g"), "id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    assert sampling.prune(many, "g", "id", ["a", "b"]).count() == 19_997


def test_equal_slabs_give_the_lowest(spark, monkeypatch):
    # the same hull in two slabs, once with a corner more that is in line but for rounding
    p = [(0.0, 0.1, 0.0), (1.0, 0.2, 5.0), (3.0, 0.4, 5.0), (2.0, 0.3, 10.0), (0.0, 9.0, 5.0), (3.0, 9.0, 5.0), (0.0, 0.1, 10.0)]
    df = spark.createDataFrame([(1, *q) for q in p], "organoid_id long, x double, y double, z double")
    for limit in (geometry.THIN_FROM, 1):
        monkeypatch.setattr(geometry, "THIN_FROM", limit)
        assert [(r["z_center"], round(r["area"], 6)) for r in geometry.max_biopsy_area(df, 5.0).collect()] == [(0.0, 26.25)]


def test_slabs_are_found_alike_in_a_task_and_by_layers(cloud, monkeypatch):
    found = []
    for limit in (geometry.THIN_FROM, 1):
        monkeypatch.setattr(geometry, "THIN_FROM", limit)
        found.append(sorted((r["organoid_id"], r["z_center"], round(r["area"], 6)) for r in geometry.max_biopsy_area(cloud, 1.0, 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 3


def test_counts_and_labels_are_the_same_by_every_method(cloud):
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    one, two, three = (rows(neighbors.neighbour_counts(cloud, [1.0, 3.0], method=m)) for m in ("task", "grid", "sample"))
    assert one == two == three and len(one) == 1061
    one, two = (rows(clusters.dbscan(cloud, 2.0, 4, method=m)) for m in ("task", "spread"))
    assert one == two and len(one) == 1063


def test_a_grid_sends_few_copies(cloud):
    b = neighbors.reached(cloud.where("organoid_id = 3 AND x IS NOT NULL"), {f"_{c}": F.col(c) for c in "xyz"}, 1.0)
    assert b.count() < 700 * 8  # 27 before


def test_samples_are_not_drawn_together_for_their_few_bytes(spark):
    cells = spark.range(4000).select((F.col("id") % 50).alias("organoid_id"), F.col("id").alias("cell_id"), F.lit(2.0).alias("cell_type"), *(F.rand(i).alias(x) for i, x in enumerate("xyz")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and clusters.dbscan(cells, 0.1, 3).rdd.getNumPartitions() == n
    assert clusters.dbscan_sweep(cells, [(0.1, 3)]).rdd.getNumPartitions() == n


def test_many_samples_are_clustered_in_one_call(spark, cloud, monkeypatch):
    calls = []
    found = clusters.labels
    monkeypatch.setattr(clusters, "labels", lambda *a: calls.append(1) or found(*a))
    r = np.random.default_rng(8)
    n, sample = 3000, np.repeat(np.arange(150), 20)
    import pyarrow as pa
    table = pa.table({"organoid_id": sample, "cell_type": np.full(n, 2.0), "cell_id": r.permutation(n), **{x: r.integers(0, 9, n).astype(float) for x in "xyz"}})
    row, cells, (number,) = clusters.labels(table, sample, clusters.KEYS, [(2.0, 3)])
    assert len(cells) == n and len(calls) == 1
    for s in range(150):
        at = slice(20 * s, 20 * s + 20)
        one = clusters.labels(table.slice(20 * s, 20), np.zeros(20, int), clusters.KEYS, [(2.0, 3)])
        assert number[row[at]].tolist() == one[2][0][one[0]].tolist()
    # samples that go over several batches, null and two zeros as keys
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        odd = cloud.unionByName(cloud.where("organoid_id = 1").withColumn("cell_type", F.when(F.col("cell_id") % 2 == 0, 0.0).otherwise(-0.0)).withColumn("organoid_id", F.lit(9)))
        rows = lambda df: sorted(map(repr, map(tuple, df.select("organoid_id", "cell_id", "cluster_id").collect())))
        assert rows(clusters.dbscan(odd, 2.0, 4)) == rows(clusters.dbscan(odd, 2.0, 4, method="spread"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spread_clusters_send_no_pair_without_a_core_cell(cloud, monkeypatch):
    kept = {}
    store = clusters.Rounds.store
    monkeypatch.setattr(clusters.Rounds, "store", lambda self, name, df: kept.update({name: store(self, name, df)}) or kept[name])
    spread = clusters.dbscan(cloud, 2.0, 4, method="spread").where("cluster_id >= 0").count()
    pairs, met = kept["near0"].count(), kept["met0"].count()
    assert "d2" not in kept["near0"].columns and met < pairs / 2
    assert spread == clusters.dbscan(cloud, 2.0, 4, method="task").where("cluster_id >= 0").count() > 0
