"""All queries of the point-pattern engine, over the stand-in point cloud."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.functions.scalar import seed_of
from cellgrove.operators.rounds import stored
from cellgrove.operators import autocorr, clusters, compare, features, geometry, mixing, neighbors, pca, predict, sampling
from cellgrove.plans import fixtures as X
from cellgrove.plans import oracles

FS = ["f1", "f2", "f3"]
PCS = ["pc1", "pc2", "pc3"]
META = ["organoid_id", "experiment", "replicate", "dox"]


def shown(df):
    """Doubles to six places without a negative zero, whole numbers as longs: the form that is compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, 6) + 0.0).alias(name) if kind == "double" else c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint", "bigint") else c)
    return df.select(*out)


def clustered(s, d, *more):
    c = X.cells(s, d).where(F.col("cell_type").isin(2, 3))
    return clusters.dbscan(c.select("organoid_id", "cell_type", "cell_id", "x", "y", "z", *more), X.EPS, X.MIN_SAMPLES)


def once(s, d, *more):
    """The clustered cells as a stored table, for queries that read them more than once."""
    return stored(clustered(s, d, *more), "clustered")


def meta(s, d):
    return X.samples(s, d).select(*META)


def with_meta(s, d, df):
    return meta(s, d).join(df, "organoid_id")


def numbered(df):
    """Lineages by name, as tables carry them."""
    return df.withColumn("lineage", F.when(F.col("cell_type") == 2, "Endo").otherwise("Meso")).drop("cell_type")


def nms_rows(s, d):
    return with_meta(s, d, mixing.nms(X.cells(s, d), X.RADIUS, "pooled_gt10_missing"))


def trend_rows(s, d):
    return compare.long(nms_rows(s, d), META, ["nms_endo", "nms_meso"])


def space(s, d):
    f = pca.prepared(X.features(s, d), ["total_cells", "pct_endo", "pct_meso", *FS], "residualized")
    return f, pca.fit(f, ["total_cells", "pct_endo", "pct_meso", *FS])


def model_table(s, d):
    t = predict.one_hot(predict.anchor(X.scores(s, d), PCS), ["exp1", "exp3"])
    return t.withColumn("dox_log", F.log10(F.col("dox") + 1.0)).withColumn("cn", F.when(F.col("experiment") == "exp1", 2.0).otherwise(6.0))


HOT = ["experiment_id_exp1", "experiment_id_exp3"]


def both_folds(t):
    return predict.lor_folds(t).unionByName(predict.loex_folds(t))


def ridge_rows(s, d):
    t = model_table(s, d)
    return predict.predictions(t, both_folds(t), ["dox_log", "cn", *HOT], PCS, hide=HOT).drop("alpha")


GRID = (0.1, 1.0, 10.0, 100.0)


def tuning_rows(s, d):
    """Inner errors of the linear model for each alpha and fold."""
    t = stored(model_table(s, d))
    return predict.tune(t, both_folds(t), ["dox_log", "cn", *HOT], PCS, "ridge_linear", GRID).withColumn("selected", F.col("selected").cast("int"))


def tuned_rows(s, d):
    t = stored(model_table(s, d))
    return predict.tuned_predictions(t, both_folds(t), ["dox_log", "cn", *HOT], PCS, "ridge_linear", GRID, HOT)


def encoded_means(s, d):
    """Fold means of real predictions by encoding of drawn copy numbers."""
    t = stored(predict.cn_draws(model_table(s, d), {"exp1": 2.0, "exp3": 6.0}))
    p = predict.encoded_predictions(t, predict.lor_folds(t), PCS, models=["ridge_linear", "poly_selected", "spline"], hot=HOT)
    return predict.fold_means(predict.metrics(p, PCS, ("fold", "model", "encoding")), ("encoding", "model", "pc"))


def sweep(s, d, parameters=tuple((e, X.MIN_SAMPLES) for e in (3.0, 4.0, 5.0, 6.0))):
    """Clusters of one lineage by sample and parameters."""
    swept = clusters.dbscan_sweep(X.cells(s, d).where("cell_type = 2"), list(parameters))
    number = F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))
    return swept.groupBy("organoid_id", "eps", "min_samples").agg(F.countDistinct(number).alias("n_clusters"))


def deltas(s, d):
    return compare.delta(X.features(s, d), "exp1", "exp3", ["pct_endo"], ["f1", "f3"])


def rebuilt_errors(s, d):
    f, p = space(s, d)
    return predict.feature_errors(f, pca.reconstruct(pca.project(f, p), p), FS)


def steps(s, d):
    return compare.dose_steps(X.scores(s, d), PCS)


def plot_union(s, d):
    c = once(s, d)
    shape = lambda df, metric, lineage: df.select("organoid_id", F.lit(metric).alias("metric"), lineage.alias("lineage"), F.col("distance").alias("value"))
    return shape(clusters.inter_distance(c), "Inter", F.lit("Endo-Meso")).unionByName(shape(numbered(clusters.intra_distance(c)), "Intra", F.col("lineage")))


def count_3label(s, d):
    """Cluster counts of both lineages and of both together."""
    m = stored(numbered(clusters.metrics(once(s, d), X.MIN_SAMPLES, "rows").select("organoid_id", "cell_type", "n_clusters")), "counts")
    return m.unionByName(m.groupBy("organoid_id").agg(F.sum("n_clusters").alias("n_clusters")).withColumn("lineage", F.lit("Total")))


def pivoted(s, d):
    wide = compare.celltype_pct(X.cells(s, d)).groupBy("organoid_id").pivot("cell_type", [0.0, 2.0, 3.0]).agg(F.first("pct")).na.fill(0.0)
    return wide.toDF("organoid_id", "pct_0", "pct_2", "pct_3")


def build():
    q = {}

    def add(name, f):
        q[name] = lambda spark, sf_dir, f=f: shown(f(spark, sf_dir))

    C = X.cells
    add("lineage_filter", lambda s, d: C(s, d).where(F.col("cell_type").isin(2, 3)).select("organoid_id", "cell_id", "cell_type"))
    add("one_vs_all", lambda s, d: compare.one_vs_all(C(s, d)).groupBy("organoid_id", "cell_type").agg(F.count("*").alias("n")))
    add("z_slab", lambda s, d: mixing.slab(C(s, d), X.HALF).select("organoid_id", "cell_id", "z_center"))
    add("centered_slice", lambda s, d: compare.centred_slice(C(s, d), 12.0, 20.0).select("organoid_id", "cell_id", "x", "y", "z"))
    add("first_n_per_group", lambda s, d: clusters.first_n(X.samples(s, d), 3).select("organoid_id", "experiment", "replicate", "dox", "condition"))
    add("radius_pairs", lambda s, d: neighbors.pairs(C(s, d), X.RADIUS).groupBy("organoid_id").agg(F.count("*").alias("n_pairs"), F.sum(F.sqrt("d2")).alias("sum_distance")))
    add("radius_pairs_grid", lambda s, d: neighbors.pairs(C(s, d), X.TOUCH, method="grid").groupBy("organoid_id").agg(F.count("*").alias("n_pairs")))
    add("composition", lambda s, d: compare.composition(C(s, d)))
    add("radial_stats", lambda s, d: compare.radial(C(s, d)))
    add("celltype_pct", lambda s, d: compare.celltype_pct(C(s, d)))
    add("celltype_pivot", pivoted)
    add("depth_alpha", lambda s, d: compare.depth_alpha(C(s, d)).select("organoid_id", "cell_id", "depth", "alpha"))
    add("nms_pooled", lambda s, d: mixing.nms(C(s, d), X.RADIUS, "pooled_gt10_zero"))
    add("nms_mean_of_ratios", lambda s, d: mixing.nms(C(s, d), X.RADIUS, "mean_of_ratios"))
    add("nms_endo_only", lambda s, d: mixing.nms(C(s, d), X.TOUCH, "endo_only_ge10").select("organoid_id", "nms_endo"))
    add("nms_multi_radius", lambda s, d: mixing.nms_by_radius(C(s, d), X.RADII))
    add("nms_long", lambda s, d: trend_rows(s, d).drop("replicate"))
    add("trend_summary", lambda s, d: compare.summary(trend_rows(s, d), ["experiment", "dox", "metric"]))
    add("pairwise_mean_diff", lambda s, d: compare.pairwise_mean_diff(compare.summary(trend_rows(s, d), ["experiment", "dox", "metric"]), ["exp1", "exp3"]))
    add("delta_vs_baseline", lambda s, d: compare.delta(X.features(s, d), "exp1", "exp3", ["pct_endo"], ["f1", "f3"]))
    add("local_mixing", lambda s, d: mixing.local_mixing(C(s, d), X.MIXING, X.HALF))
    add("entropy_gradient", lambda s, d: mixing.entropy_gradient(C(s, d), X.ENTROPY))
    add("dbscan_clusters", lambda s, d: clustered(s, d).select("organoid_id", "cell_type", "cell_id", "cluster_id"))
    add("dbscan_counts", lambda s, d: clusters.metrics(once(s, d), X.MIN_SAMPLES, "rows").select("organoid_id", "cell_type", "n_clusters"))
    add("cluster_metrics", lambda s, d: clusters.metrics(once(s, d), X.MIN_SAMPLES))
    add("cluster_count_3label", count_3label)
    add("cluster_centres", lambda s, d: clusters.centres(clustered(s, d)))
    add("intra_cluster_distance", lambda s, d: clusters.intra_distance(once(s, d)))
    add("inter_cluster_distance", lambda s, d: clusters.inter_distance(once(s, d)))
    add("cluster_touch_pairs", lambda s, d: clusters.lineage_pairs(once(s, d)).withColumn("touching", (F.col("min_dist") <= X.TOUCH).cast("long")))
    add("centroid_separation", lambda s, d: clusters.centroid_separation(once(s, d)))
    add("adjacency_metrics", lambda s, d: clusters.adjacency(once(s, d), X.TOUCH))
    add("adjacency_long", lambda s, d: compare.long(clusters.adjacency(once(s, d), X.TOUCH), ["organoid_id"], ["minority_pct", "majority_pct", "density_pct"]))
    add("minority_frequency", lambda s, d: compare.minority_frequency(with_meta(s, d, clusters.adjacency(once(s, d), X.TOUCH))))
    add("plot_union", plot_union)
    add("dbscan_sweep", lambda s, d: clusters.dbscan_sweep(C(s, d).where("cell_type = 2"), [(e, X.MIN_SAMPLES) for e in (3.0, 4.0, 5.0, 6.0)]).groupBy("organoid_id", "eps").agg(F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters")))
    add("cluster_status", lambda s, d: clusters.status(C(s, d), clustered(s, d), 2.0, 10))
    add("hull_area_2d", lambda s, d: geometry.hull_areas(C(s, d).where("cell_type IN (2, 3)")))
    add("hull_summary", lambda s, d: compare.summary(with_meta(s, d, geometry.hull_areas(C(s, d).where("cell_type IN (2, 3)"))), ["experiment", "dox"], "area"))
    add("max_biopsy_area", lambda s, d: geometry.max_biopsy_area(C(s, d).where("cell_type IN (2, 3)"), X.HALF))
    add("hull_volume_3d", lambda s, d: geometry.hull_volumes(C(s, d).where("cell_type IN (2, 3)")))
    add("morans_i", lambda s, d: autocorr.morans_i(C(s, d), "ch_546", X.BAND))
    add("morans_p", lambda s, d: autocorr.permutation_p(C(s, d), "ch_546", X.BAND, 19))
    add("lisa_cluster_mean", lambda s, d: autocorr.lisa_cluster_mean(once(s, d, "ch_546"), "ch_546", X.BAND))
    add("spatial_power", lambda s, d: autocorr.spatial_power(C(s, d), "ch_546", "ch_647", X.BAND))
    add("feature_matrix", lambda s, d: features.feature_matrix(C(s, d), X.EPS, X.MIN_SAMPLES, X.RADIUS, X.TOUCH))
    add("normalize_composition", lambda s, d: compare.normalize(X.features(s, d)).select("organoid_id", "total_cells", "pct_endo", "pct_meso"))
    add("residualize", lambda s, d: compare.residualize(X.features(s, d), FS).select("organoid_id", *FS))
    add("impute_two_step", lambda s, d: compare.impute(X.features(s, d), FS).select("organoid_id", *FS))
    add("pca_scores", lambda s, d: pca.project(*space(s, d)))
    add("pca_variance", lambda s, d: pca.variance(s, space(s, d)[1]))
    add("pca_loadings", lambda s, d: pca.loadings(s, space(s, d)[1]))
    add("top_loadings", lambda s, d: pca.top_loadings(pca.loadings(s, space(s, d)[1])))
    add("reconstruct_features", lambda s, d: (lambda f, p: pca.reconstruct(pca.project(f, p), p))(*space(s, d)))
    add("group_separation", lambda s, d: compare.group_separation(X.scores(s, d), PCS))
    add("consecutive_centroid_distance", steps)
    add("dox_step_summary", lambda s, d: compare.step_summary(steps(s, d)))
    add("trajectory_centroids", lambda s, d: X.scores(s, d).groupBy("experiment", "dox").agg(*(F.avg(c).alias(c) for c in PCS)))
    add("axis_limits", lambda s, d: compare.axis_limits(X.scores(s, d), PCS))
    add("kruskal_h", lambda s, d: compare.kruskal(X.features(s, d), FS))
    add("significance_stars", lambda s, d: compare.kruskal(X.features(s, d), FS).select("experiment", "metric", compare.stars(compare.chi2_tail(F.col("h"), F.col("k") - 1)).alias("stars")))
    add("signal_ratio", lambda s, d: compare.signal_ratio(X.features(s, d), FS))
    add("size_ablation", lambda s, d: predict.size_ablation(X.features(s, d), "log1p", "f1").select("organoid_id", "f1"))
    add("origin_anchor", lambda s, d: predict.anchor(X.scores(s, d), PCS).select("organoid_id", *PCS))
    add("experiment_one_hot", lambda s, d: predict.one_hot(meta(s, d), ["exp1", "exp3"]).select("organoid_id", "experiment_id_exp1", "experiment_id_exp3"))
    add("poly_features", lambda s, d: predict.poly_selected(model_table(s, d)).select("organoid_id", "d1", "d2", "d3", "c1", "dc", "d2c"))
    add("fnv1a_seed", lambda s, d: meta(s, d).select("organoid_id", seed_of(F.concat(F.lit("organoid_"), F.col("organoid_id").cast("string"))).alias("seed")))
    add("cn_draws", lambda s, d: predict.cn_draws(meta(s, d), {"exp1": 2.0, "exp3": 6.0}).select("organoid_id", "cn_mean", "cn_std", "cn_p10", "cn_p50", "cn_p90"))
    add("lor_folds", lambda s, d: predict.lor_folds(meta(s, d)))
    add("loex_folds", lambda s, d: predict.loex_folds(meta(s, d)))
    add("random_folds", lambda s, d: predict.random_folds(meta(s, d)))
    add("holdout_fold", lambda s, d: predict.holdout(meta(s, d), ["exp1"], ["exp3"]))
    add("ridge_predictions", ridge_rows)
    add("regression_metrics", lambda s, d: predict.metrics(X.predicted(s, d), PCS))
    add("trajectory_metrics", lambda s, d: predict.trajectory(X.predicted(s, d), PCS))
    add("error_summary", lambda s, d: predict.error_summary(X.predicted(s, d), ["experiment", "dox"], "true_pc1", "pred_pc1"))
    add("prune_samples", lambda s, d: sampling.prune(X.features(s, d).withColumn("group", F.concat_ws("_", "experiment", "dox")), "group", "organoid_id", ["pct_endo", "pct_meso"]))
    add("dose_filter", lambda s, d: compare.at_doses(meta(s, d), [0, 100, 1000]))
    add("condition_order", lambda s, d: compare.in_order(X.samples(s, d)).groupBy("condition", "place").agg(F.count("*").alias("n")))
    add("sweep_summary", lambda s, d: compare.sweep_summary(with_meta(s, d, sweep(s, d))))
    add("dbscan_grid", lambda s, d: sweep(s, d, [(e, m) for e in (4.0, 6.0) for m in (3, 5)]))
    add("bars_ci95", lambda s, d: compare.interval95(compare.summary(compare.long(X.features(s, d), ["experiment", "dox"], FS), ["experiment", "dox", "metric"])))
    add("box_quartiles", lambda s, d: compare.quartiles(compare.long(X.scores(s, d), ["experiment"], PCS), ["experiment", "metric"]))
    add("delta_long", lambda s, d: compare.delta_long(deltas(s, d), ["organoid_id", "dox"]))
    add("fold_means", lambda s, d: predict.fold_means(predict.metrics(X.predicted(s, d), PCS)))
    groups = [("composition", ["pct_endo", "pct_meso"]), ("shape", ["f3", "f1"])]
    add("loading_order", lambda s, d: pca.ordered_loadings(pca.loadings(s, space(s, d)[1]), groups))
    add("feature_errors", lambda s, d: predict.feature_error_summary(rebuilt_errors(s, d)))
    add("random_alpha_tuning", tuning_rows)
    add("tuned_predictions", tuned_rows)
    add("encoded_fold_means", encoded_means)
    add("holdout_report", lambda s, d: predict.holdout_report(X.predicted(s, d), PCS))
    add("kruskal_p", lambda s, d: compare.kruskal(X.features(s, d), FS).select("experiment", "metric", "k", compare.chi2_tail(F.col("h"), F.col("k") - 1).alias("p")))
    add("bootstrap_ci95", lambda s, d: compare.bootstrap95(compare.long(X.features(s, d), ["organoid_id", "experiment", "dox"], FS), ["experiment", "dox", "metric"], "organoid_id", rounds=200))
    add("dbscan_spread", lambda s, d: clusters.dbscan(X.cells(s, d).where(F.col("cell_type").isin(2, 3)), X.EPS, X.MIN_SAMPLES, method="spread").select("organoid_id", "cell_type", "cell_id", "cluster_id"))
    add("touched_clusters", lambda s, d: clusters.touched(once(s, d), X.TOUCH))
    add("adjacency_pct", lambda s, d: clusters.adjacency_pct(once(s, d), X.TOUCH))
    add("name_filter", lambda s, d: compare.named_like(X.files(s, d), "file", ["0dox", "10dox"]))
    add("condition_key", lambda s, d: X.files(s, d).select("organoid_id", sampling.condition_key(F.col("file"), F.col("folder")).alias("condition")))
    add("feature_significance", lambda s, d: compare.significance(X.features(s, d), FS))
    add("axis_break", lambda s, d: compare.axis_break(X.features(s, d), ["experiment", "dox"], "f1", 20.0))
    add("missing_experiments", lambda s, d: predict.missing(meta(s, d), ["exp1", "exp2", "exp3", "exp9"]))
    add("dbscan_all_cells", lambda s, d: clusters.dbscan(C(s, d), X.EPS, X.MIN_SAMPLES, ("organoid_id",)).select("organoid_id", "cell_id", "cluster_id"))
    add("lambda_lookup", lambda s, d: predict.cn_lambda(meta(s, d), {"exp1": 2.5, "other": 9.0}).select("organoid_id", "cn_lambda"))
    return q


def flagship(spark, sf_dir):
    """Mixing scores by experiment and dose: neighbour join, conditional counts, two-level summary."""
    return queries()["trend_summary"](spark, sf_dir)


def queries():
    return build()


def oracle_sql():
    return oracles.build()
