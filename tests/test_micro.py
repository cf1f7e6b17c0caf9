"""Guards and degenerate branches on hand-made samples."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions.scalar import bspline, fnv1a
from cellgrove.operators import autocorr, clusters, compare, geometry, mixing, neighbors, pca, predict, sampling

SHAPE = "organoid_id string, cell_id long, cell_type double, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(o, i, t, float(x), float(y), float(z)) for i, (o, t, x, y, z) in enumerate(rows, 1)], SHAPE)


def line(o, t, n, x0=0.0, step=0.01, y=0.0):
    return [(o, t, x0 + i * step, y, 0.0) for i in range(n)]


@pytest.mark.parametrize("n,mean,gt,ge", [(9, False, False, False), (10, True, False, True), (11, True, True, True)])
def test_mixing_guards(spark, n, mean, gt, ge):
    c = cloud(spark, line("a", 2.0, n) + line("a", 3.0, 20, y=0.5))
    value = lambda mode: [r["nms_endo"] for r in mixing.nms(c, 10.0, mode).collect()]
    assert (value("mean_of_ratios")[0] is not None) == mean
    assert bool([v for v in value("pooled_gt10_zero") if v is not None]) == gt
    assert bool(value("pooled_ge10_both")) == ge


def test_untyped_cells_are_foreign_only_in_the_mean_of_ratios(spark):
    c = cloud(spark, line("a", 2.0, 12) + [("a", None, 0.0, 0.1 * i, 0.0) for i in range(12)] + line("a", 3.0, 12, y=0.2))
    assert mixing.nms(c, 50.0, "mean_of_ratios").first()["nms_endo"] == pytest.approx((24 / 11) / (24 / 12))
    assert mixing.nms(c, 50.0, "pooled_ge10_both").first()["nms_endo"] == pytest.approx((12 * 12 / (12 * 11)) / 1)


@pytest.mark.parametrize("n,expected", [(19, 0), (20, 1)])
def test_density_threshold(spark, n, expected):
    c = clusters.dbscan(cloud(spark, line("a", 2.0, n)), 30.0, 20)
    got = {r["cell_type"]: r for r in clusters.metrics(c, 20).collect()}
    assert got[2.0]["n_clusters"] == (None if n < 20 else expected)
    assert got[3.0]["n_clusters"] is None and got[3.0]["n_cells"] == 0
    assert {r["n_clusters"] for r in clusters.metrics(c, 20, "zero").collect()} == {0, expected}


def test_two_blobs(spark):
    c = clusters.dbscan(cloud(spark, line("a", 2.0, 25) + line("a", 2.0, 25, x0=100.0)), 5.0, 20)
    assert sorted(r["cluster_id"] for r in c.select("cluster_id").distinct().collect()) == [0, 1]
    assert clusters.intra_distance(c).first()["distance"] == pytest.approx(100 - 0.24)
    assert [r for r in clusters.centroid_separation(c).collect() if r["cell_type"] == 2.0][0]["separation"] == pytest.approx(100)


def test_border_cell_joins_the_lowest_label():
    # 0-2 and 4-6 are core by four neighbours; 3 touches both
    xs = np.array([0, 0.1, 0.2, 1.1, 2.0, 2.1, 2.2])
    a, b = np.nonzero(np.abs(xs[:, None] - xs[None]) <= 1.0)
    assert clusters.label(a, b, 4)[1].tolist() == [0, 0, 0, 0, 1, 1, 1] or clusters.label(a, b, 4)[1][3] == 0


def test_adjacency_ties_and_empty_sides(spark):
    tie = line("t", 2.0, 5) + line("t", 2.0, 5, x0=50) + line("t", 3.0, 5, y=1) + line("t", 3.0, 5, x0=200)
    c = clusters.dbscan(cloud(spark, tie + line("e", 2.0, 5) + [("n", 2.0, 0, 0, 0)]), 2.0, 3)
    got = {r["organoid_id"]: r for r in clusters.adjacency(c, 5.0).collect()}
    assert got["t"]["minority"] == "Meso" and got["t"]["minority_pct"] == 50.0 and got["t"]["density_pct"] == 25.0
    assert got["e"]["minority_pct"] == 0.0 and "n" not in got


def test_hulls(spark):
    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    assert geometry.hull_3d(np.array(cube)) == pytest.approx((1.0, 6.0))
    assert geometry.hull_3d(np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (2, 2, 0)])) is None
    assert geometry.area_2d(np.array([(0, 0), (2, 0), (2, 1), (0, 1), (1, 0.5)])) == pytest.approx(2.0)
    assert geometry.area_2d(np.array([(0, 0), (1, 1), (2, 2)])) is None
    ball = np.random.default_rng(0).standard_normal((400, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    v, s = geometry.hull_3d(ball)
    assert 0.93 * 4 / 3 * np.pi < v < 4 / 3 * np.pi and 0.95 * 4 * np.pi < s < 4 * np.pi


def test_slab_thinning(spark):
    c = cloud(spark, [("a", 2.0, 0, 0, z) for z in range(100)])
    got = sorted(r["z_center"] for r in geometry.slab_centres(c).collect())
    assert got == sorted({float(int(i * 99 / 80)) for i in range(81)})


def test_grid_join_equals_sample_join(spark):
    rng = np.random.default_rng(1)
    c = cloud(spark, [(o, 2.0, *p) for o in "ab" for p in rng.uniform(-20, 20, (150, 3))])
    one, two = (sorted((r["organoid_id"], r["a_cell_id"], r["b_cell_id"]) for r in neighbors.pairs(c, 7.0, method=m).collect()) for m in ("sample", "grid"))
    assert one == two and len(one) > 300


def test_local_mixing_of_a_lone_cell(spark):
    assert mixing.local_mixing(cloud(spark, [("a", 2.0, 0, 0, 0)])).first()["local_mixing"] == 0.0


def test_autocorrelation_of_constant_and_isolated(spark):
    c = cloud(spark, line("a", 2.0, 5) + [("b", 2.0, 0, 0, 0), ("b", 2.0, 1, 0, 0), ("b", 2.0, 500, 0, 0)]).withColumn("v", F.when(F.col("organoid_id") == "a", 1.0).otherwise(F.col("x")))
    got = {r["organoid_id"]: r["morans_i"] for r in autocorr.morans_i(c, "v", 30.0).collect()}
    assert "a" not in got
    z = (np.array([0.0, 1.0, 500.0]) - 167) / np.std([0.0, 1.0, 500.0])
    assert got["b"] == pytest.approx(2 * z[0] * z[1] / 2)


def test_residuals_imputation_delta(spark):
    f = spark.createDataFrame([("a", "e", "r1", 0, 1.0), ("b", "e", "r1", 0, 3.0), ("c", "e", "r2", 0, 8.0), ("d", "e", "r2", 10, None), ("g", "t", "r1", 0, 6.0)], "organoid_id string, experiment string, replicate string, dox int, v double")
    got = {r["organoid_id"]: r["v"] for r in compare.residualize(f, ["v"]).collect()}
    assert got["a"] == pytest.approx(3.0) and got["c"] == pytest.approx(4.0) and got["d"] is None
    assert {r["organoid_id"]: r["v"] for r in compare.impute(f, ["v"]).collect()}["d"] == pytest.approx(4.5)
    assert compare.delta(f, "e", "t", [], ["v"]).first()["rel_v"] == pytest.approx(50.0)
    zero = f.withColumn("v", F.when(F.col("experiment") == "e", 0.0).otherwise(F.col("v")))
    assert compare.delta(zero, "e", "t", [], ["v"]).first()["rel_v"] == 0.0


def test_kruskal_and_tail(spark):
    f = spark.createDataFrame([("e", d, float(v)) for d, vs in ((0, (1, 2, 3)), (10, (4, 5, 6)), (25, (7, 8, 9))) for v in vs] + [("s", d, 1.0) for d in (0, 0, 10, 10)], "experiment string, dox int, v double")
    got = {r["experiment"]: r for r in compare.kruskal(f, ["v"]).withColumn("p", compare.chi2_tail(F.col("h"), F.col("k") - 1)).collect()}
    assert got["e"]["h"] == pytest.approx(7.2) and got["e"]["p"] == pytest.approx(np.exp(-3.6), rel=1e-6) and got["s"]["h"] is None
    tail = spark.range(1).select(compare.chi2_tail(F.lit(3.841458820694124), F.lit(1)).alias("a"), compare.chi2_tail(F.lit(7.814727903251179), F.lit(3)).alias("b"), compare.chi2_tail(F.lit(9.487729036781154), F.lit(4)).alias("c")).first()
    assert [tail["a"], tail["b"], tail["c"]] == pytest.approx([0.05] * 3, abs=1e-6)


def test_components(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    f = spark.createDataFrame([(str(i), "e", "r", i % 4, *map(float, r)) for i, r in enumerate(x)], "organoid_id string, experiment string, replicate string, dox int, a double, b double, c double")
    s = pca.fit(f, ["a", "b", "c"], "all")
    z = (x - x.mean(0)) / x.std(0)
    value = np.linalg.svd(z, compute_uv=False) ** 2
    assert s.ratio == pytest.approx(value / value.sum())
    back = pca.reconstruct(pca.project(f, s), s).toPandas().set_index("organoid_id").loc[[str(i) for i in range(40)], ["a", "b", "c"]].to_numpy()
    assert np.allclose(back, x)
    constant = compare.group_separation(f.withColumn("a", F.lit(1.0)), ["a"]).collect()
    assert {r["between"] for r in constant} == {0.0}


def test_models_and_folds(spark):
    x = np.array([[1.0, 2.0], [2.0, 1.0], [3.0, 5.0], [4.0, 3.0]])
    y = np.array([[1.0], [2.0], [2.0], [5.0]])
    m, s = x.mean(0), x.std(0)
    z = np.column_stack([(x - m) / s])
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(predict.ridge(x, y, 1.0)(x), z @ w + y.mean())
    assert np.allclose(bspline(np.linspace(-1, 3, 9), 0, 2).sum(axis=1), 1)
    assert fnv1a("") == 2166136261 and fnv1a("a") == 0xE40C292C
    f = spark.createDataFrame([(str(i), f"e{i % 2}", f"r{i % 3}") for i in range(12)], "organoid_id string, experiment string, replicate string")
    assert predict.lor_folds(f).where("role = 'test'").count() == 12
    r = predict.random_folds(f).where("role = 'test'").groupBy("fold").count().collect()
    assert len(r) == 10 and {x["count"] for x in r} == {2}
    with pytest.raises(ValueError):
        predict.holdout(f, ["e0"], ["e0", "e1"])
    with pytest.raises(ValueError):
        predict.parse_map("a=1")
    assert predict.parse_map("a:1, b:2.5") == {"a": 1.0, "b": 2.5}


def test_pruning(spark):
    f = spark.createDataFrame([("g", s, float(v)) for s, v in (("a", 50), ("b", 51), ("c", 49), ("z", 90))] + [("one", "q", 1.0)], "grp string, sample string, v double")
    assert [(r["grp"], r["sample"]) for r in sampling.prune(f, "grp", "sample", ["v"]).collect()] == [("g", "z")]


def test_all_components_rebuild_every_feature(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", "exp1", *map(float, r)) for i, r in enumerate(rng.standard_normal((12, 3)))]
    f = spark.createDataFrame(rows, "organoid_id string, experiment string, a double, b double, c double")
    space = pca.fit(f, ["a", "b", "c"])
    back = pca.reconstruct(pca.project(f, space, ["organoid_id"]), space)
    errors = predict.feature_errors(f.withColumn("b", F.when(F.col("organoid_id") != "s3", F.col("b"))), back, ["a", "b", "c"])
    got = {r["feature"]: r for r in predict.feature_error_summary(errors).collect()}
    assert [got[c]["n"] for c in "abc"] == [12, 11, 12]
    # as many components as features, or the share that is left out
    left = 1.0 - sum(space.ratio)
    assert all(r["rmse"] <= 1e-9 + 4 * left for r in got.values())


def test_boxes_bars_and_orders(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "k string, value double")
    box = compare.quartiles(df, ["k"]).first()
    assert (box["q1"], box["median"], box["q3"], box["low"], box["high"]) == (2.0, 3.0, 4.0, 1.0, 4.0)
    bar = compare.interval95(compare.summary(df, ["k"])).first()
    assert bar["high"] - bar["mean"] == pytest.approx(1.96 * np.std([1, 2, 3, 4, 100], ddof=1) / 5 ** 0.5)
    named = spark.createDataFrame([("BASAL",), ("BMP4+WNT5A",), ("other",), (None,)], "condition string")
    assert {r["condition"]: r["place"] for r in compare.in_order(named).collect()} == {"BASAL": 5, "BMP4+WNT5A": 4}
    long = compare.delta_long(spark.createDataFrame([(1, 2.0, 3.0)], "organoid_id long, abs_pct_endo double, rel_size_meso double"), ["organoid_id"])
    assert {(r["metric"], r["lineage"], r["type"]) for r in long.collect()} == {("abs_pct_endo", "endo", "absolute"), ("rel_size_meso", "meso", "relative")}
    table = spark.createDataFrame([(f, "pc1", 0.1) for f in "abcd"], "feature string, pc string, loading double")
    placed = {r["feature"]: (r["place"], r["group"]) for r in pca.ordered_loadings(table, [("first", ["d", "b"])]).collect()}
    assert placed == {"d": (1, "first"), "b": (2, "first"), "a": (3, "other"), "c": (4, "other")}


def test_encodings(spark):
    f = predict.cn_draws(spark.createDataFrame([("s1", "exp1")], "organoid_id string, experiment string"), {"exp1": 3.0})
    for name, n in (("lambda", 1), ("sample_mean", 1), ("summary", 5)):
        frame, columns = predict.encoded(f, name)
        assert len(columns) == n and set(columns) <= set(frame.columns)
    with pytest.raises(ValueError):
        predict.encoded(f, "none")


def test_infinite_places_have_no_neighbours(spark):
    c = cloud(spark, [("a", 2.0, 0, 0, 0), ("a", 2.0, 1, 0, 0), ("a", 2.0, float("inf"), 0, 0), ("a", 2.0, float("nan"), 0, 0)])
    assert neighbors.pairs(c, 2.0, method="sample").count() == neighbors.pairs(c, 2.0, method="grid").count() == 4
