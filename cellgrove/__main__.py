"""python -m cellgrove COMMAND --data NAME=FOLDER --out FOLDER ...: tables of folders of cell files."""
from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove import schema as S
from cellgrove.operators import autocorr, clusters, compare, features, geometry, mixing, pca, predict, sampling
from cellgrove.operators.rounds import intermediates, stored
from cellgrove.sources import csv_cells, sinks

COMMANDS = ["features", "mixing", "clusters", "adjacency", "distances", "geometry", "autocorrelation", "trajectory", "delta", "sweep", "prune", "predict"]


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgrove", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", action="append", required=True, help="name=folder, once for each experiment")
    p.add_argument("--out", required=True)
    p.add_argument("--limit", type=int, default=3, help="samples by replicate, dose and condition; 0: all")
    p.add_argument("--glob", default="*.csv", help="names of the files that are read")
    p.add_argument("--dose-rule", choices=["anywhere", "leading"], default="anywhere", help="where the dose stands in a file's name")
    p.add_argument("--eps", type=float, default=S.EPS)
    p.add_argument("--min-samples", type=int, default=S.MIN_SAMPLES)
    p.add_argument("--radius", type=float, default=S.NMS_RADIUS)
    p.add_argument("--touch", type=float, default=S.TOUCH)
    p.add_argument("--replicate-adjust", choices=["raw", "none", "residualized", "both"], default="raw")
    p.add_argument("--pca-fit-basis", choices=["auto", "all_organoids", "exp_dox_centroids", "exp_centroids"], default="auto")
    p.add_argument("--trajectory-group-by", choices=["dox", "experiment"], default="dox")
    p.add_argument("--size-ablation", choices=["keep", "drop", "log1p"], default="keep")
    p.add_argument("--append-only", action="store_true", help="write only tables that the folder lacks")
    p.add_argument("--group-by-runtime", choices=["yes", "no"], default="yes", help="a folder of its own for each run")
    p.add_argument("--baseline")
    p.add_argument("--treatment")
    p.add_argument("--sweep-eps", type=numbers, default=[float(e) for e in range(10, 100, 5)])
    p.add_argument("--permutations", type=int, default=999)
    p.add_argument("--keep", type=int, default=3, help="samples of a condition that pruning leaves")
    p.add_argument("--cn", default="", help="mean copy number of each experiment, name:value,...")
    p.add_argument("--cn-encoding", action="append", choices=["lambda", "sample_mean", "summary", "all"])
    p.add_argument("--target-pcs", type=int, default=3)
    p.add_argument("--alpha", type=float, default=1.0)
    p.add_argument("--tune-alpha", type=numbers, help="alphas of which inner splits select one for the spline model")
    p.add_argument("--stress-train", nargs="*", default=[], help="experiments of a hold-out's training side")
    p.add_argument("--stress-test", nargs="*", default=[])
    p.add_argument("--seed", type=int, default=42)
    return p


def spaces(f: DataFrame, a):
    """(mode, prepared features, space) of each replicate adjustment asked for."""
    names = [c for c in S.FEATURES if not (a.size_ablation == "drop" and c == "cluster_size_endo")]
    basis = {"all_organoids": "all"}.get(a.pca_fit_basis, a.pca_fit_basis)
    for mode in {"both": ["raw", "residualized"], "none": ["raw"]}.get(a.replicate_adjust, [a.replicate_adjust]):
        ready = stored(pca.prepared(predict.size_ablation(f, a.size_ablation), names, mode), "prepared")
        yield mode, ready, pca.frozen(ready, names, a.target_pcs if a.command == "predict" else 1, basis)


def trajectory(f: DataFrame, a) -> dict[str, DataFrame]:
    out = {"feature_matrix": f, "feature_significance": compare.significance(f, S.FEATURES)}
    for mode, ready, space in spaces(f, a):
        scores = stored(pca.project(ready, space), "scores")
        pcs = pca.component_columns(scores.columns)
        by = ["experiment", "dox"] if a.trajectory_group_by == "dox" else ["experiment"]
        loadings = pca.loadings(f.sparkSession, space)
        out |= {f"{mode}_{n}": t for n, t in {
            "scores": scores, "loadings": loadings, "top_loadings": pca.top_loadings(loadings), "variance": pca.variance(f.sparkSession, space),
            "centroids": scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in pcs)), "separation": compare.group_separation(scores, pcs),
            "steps": compare.dose_steps(scores, pcs[:3]), "step_summary": compare.step_summary(compare.dose_steps(scores, pcs[:3]))}.items()}
    return out


def predictive(f: DataFrame, a) -> dict[str, DataFrame]:
    """Fold metrics and means of every encoding, tuned errors, hold-out rows and feature errors of predicted scores."""
    lambdas = predict.parse_map(a.cn)
    _, ready, space = next(iter(spaces(f, a)))
    pcs = [f"pc{i}" for i in range(1, a.target_pcs + 1)]
    names = [r["experiment"] for r in f.select("experiment").distinct().collect()]  # the experiments of the command line
    hot = [f"experiment_id_{e}" for e in sorted(names)]
    scores = predict.anchor(pca.project(ready, space), pcs)
    t = predict.cn_draws(predict.one_hot(scores, names), lambdas, seed=a.seed).withColumn("dox_log", F.log10(F.col("dox") + 1.0))
    t = stored(t, "model")
    folds = predict.lor_folds(t).unionByName(predict.loex_folds(t)).unionByName(predict.random_folds(t, seed=a.seed))
    run = lambda g: predict.encoded_predictions(t, g, pcs, a.cn_encoding or (), alpha=a.alpha, hot=hot)
    p = stored(run(folds), "predictions")
    m = predict.metrics(p, pcs, ("encoding", "split_type", "fold", "model"))
    out = {"predictions": p, "metrics": m, "fold_means": predict.fold_means(m, ("encoding", "split_type", "model", "pc"))}
    placed = lambda x: x.join(t.select(F.col("organoid_id").alias("row_id"), "experiment", "replicate", "dox"), "row_id")
    out["trajectory"] = predict.trajectory(placed(p), pcs, ("encoding", "split_type", "fold", "model"))
    guess = p.select(F.col("row_id").alias("organoid_id"), "encoding", "split_type", "fold", "model", *(F.col(f"pred_{c}").alias(c) for c in pcs))
    keys = ["organoid_id", "encoding", "split_type", "fold", "model"]
    rebuilt = pca.reconstruct(guess, space, keys)
    seen = ready.join(guess.select(*keys), "organoid_id")
    errors = predict.feature_errors(seen, rebuilt, space.features, keys)
    out["feature_errors"] = errors.groupBy("encoding", "split_type", "model", "feature").agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.count("*").alias("n"))
    if a.tune_alpha:
        for e in predict.encodings(a.cn_encoding or ()):
            out[f"tuning_{e}"] = predict.tune(t, folds, ["dox_log", *predict.ENCODINGS[e], *hot], pcs, "spline", a.tune_alpha, seed=a.seed)
    if a.stress_train and a.stress_test:
        out["missing_experiments"] = predict.missing(t, [*a.stress_train, *a.stress_test])
        out["holdout"] = predict.holdout_report(placed(run(predict.holdout(t, a.stress_train, a.stress_test))), pcs, ("encoding", "model"))
    return out


def tables(cells: DataFrame, a) -> dict[str, DataFrame]:
    lineages = cells.where("cell_type IN (2, 3)")
    clustered = lambda: stored(clusters.dbscan(lineages, a.eps, a.min_samples), "clustered")
    if a.command == "mixing":
        return {"nms": mixing.nms_by_radius(cells, S.NMS_RADII), "local_mixing": mixing.local_mixing(cells), "entropy": mixing.entropy_gradient(cells, range(10, 291, 10))}
    if a.command == "clusters":
        c = clustered()
        return {"metrics": clusters.metrics(c, a.min_samples, "rows"), "intra": clusters.intra_distance(c), "nms": mixing.nms(cells, a.radius, "pooled_gt10_zero")}
    if a.command == "adjacency":
        return {"adjacency": clusters.adjacency(clustered(), a.touch)}
    if a.command == "distances":
        c = clustered()
        return {"intra": clusters.intra_distance(c), "inter": clusters.inter_distance(c)}
    if a.command == "geometry":
        return {"hull_3d": geometry.hull_volumes(lineages), "max_slab": geometry.max_biopsy_area(lineages, S.HALF_SLAB)}
    if a.command == "autocorrelation":
        c = stored(clusters.dbscan(cells, a.eps, a.min_samples, ("organoid_id",)), "clustered")
        out = {"spatial_power": autocorr.spatial_power(cells, *csv_cells.CHANNELS)}
        for ch in csv_cells.CHANNELS:
            out |= {f"morans_i_{ch}": autocorr.permutation_p(cells, ch, rounds=a.permutations), f"lisa_{ch}": autocorr.lisa_cluster_mean(c, ch)}
        return out
    if a.command == "sweep":
        swept = clusters.dbscan_sweep(cells.where("cell_type = 2"), [(e, a.min_samples) for e in a.sweep_eps])
        n = swept.groupBy("organoid_id", "eps").agg(F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))
        rows = stored(cells.select("organoid_id", "experiment", "replicate", "dox").distinct().join(n, "organoid_id"), "swept")
        return {"counts": rows, "summary": compare.sweep_summary(rows, ("experiment", "replicate", "dox", "eps"))}
    if a.command == "prune":
        shares = compare.celltype_pct(cells).groupBy("organoid_id").pivot("cell_type", [0.0, 1.0, 2.0, 3.0]).agg(F.first("pct")).na.fill(0.0).toDF("organoid_id", "p0", "p1", "p2", "p3")
        places = cells.select("organoid_id", "experiment", "replicate").distinct().withColumn("file", F.element_at(F.split("organoid_id", "/"), -1))
        return {"archive": sampling.prune_files(places.join(shares, "organoid_id"), ["p0", "p1", "p2", "p3"], a.keep)}
    f = stored(features.feature_matrix(cells, a.eps, a.min_samples, a.radius, a.touch), "features")
    if a.command == "features":
        return {"feature_matrix": f}
    if a.command == "delta":
        if not (a.baseline and a.treatment):
            raise SystemExit("delta needs --baseline and --treatment")
        return {"delta": compare.delta(f, a.baseline, a.treatment, ["nms_endo", "nms_meso"], ["cluster_count_endo", "cluster_count_meso", "cluster_size_endo", "cluster_size_meso"])}
    return predictive(f, a) if a.command == "predict" else trajectory(f, a)


def main(argv=None) -> str:
    a = parser().parse_args(argv)
    if a.command == "prune":
        a.limit = 0  # pruning judges all samples
    spark = SparkSession.builder.appName("cellgrove").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    folder = sinks.run_folder(a.out) if a.group_by_runtime == "yes" else a.out.rstrip("/")
    with intermediates(spark):
        parts = [csv_cells.read_cells(spark, d.split("=", 1)[1], d.split("=", 1)[0], a.limit, glob=a.glob, dose_rule=a.dose_rule) for d in a.data]
        cells = stored(reduce(DataFrame.unionByName, parts), "cells")
        written = sinks.write_new(tables(cells, a), folder, append_only=a.append_only)
        sinks.write_manifest(folder, vars(a) | {"samples": cells.select("organoid_id").distinct().count(), "cells": cells.count(), "tables": len(written)})
    print(folder)
    return folder


if __name__ == "__main__":
    main()
