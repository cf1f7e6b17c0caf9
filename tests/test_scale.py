"""Operators that replace work inside one task, against the plain forms of the same rules."""
import json
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrove.functions.draws import draw, ranked
from cellgrove.operators import autocorr, closest, clusters, compare, geometry, neighbors, predict, rounds

SHAPE = "organoid_id string, cell_type double, cluster_id int, cell_id long, x double, y double, z double"


def blobs(spark, seed, samples="ab", per=6, size=60, extent=300.0, spread=9.0):
    """Clusters of both lineages in two samples, some of them near each other, and noise of no cluster."""
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for s in samples:
        for t in (2.0, 3.0):
            for c in range(-1, per):
                centre = r.uniform(0, extent, 3)
                for p in centre + r.normal(0, spread, (size if c >= 0 else 7, 3)):
                    rows.append((s, t, c, n, *map(float, p)))
                    n += 1
    return rows, spark.createDataFrame(rows, SHAPE)


def least(rows, same):
    """All pairs of members."""
    groups = {}
    for s, t, c, _, *p in rows:
        if c >= 0:
            groups.setdefault((s, t, c), []).append(p)
    out = {}
    for a, p in groups.items():
        for b, q in groups.items():
            if a[0] == b[0] and ((a[1] == b[1] and a[2] < b[2]) if same else (a[1] == 2.0 and b[1] == 3.0)):
                d = np.sqrt(((np.array(p)[:, None] - np.array(q)[None]) ** 2).sum(-1)).min()
                out[(a[0], a[1], a[2], b[2]) if same else (a[0], a[2], b[2])] = d
    return out


@pytest.mark.parametrize("seed,spread,extent,size", [(1, 9.0, 300.0, 60), (2, 40.0, 100.0, 60), (3, 0.0, 50.0, 30), (4, 9.0, 300.0, 17), (5, 5.0, 90.0, 8)])
def test_closest_pairs_equal_all_pairs(spark, monkeypatch, seed, spread, extent, size):
    monkeypatch.setattr(closest.closest, "__defaults__", (("organoid_id",), False, 16 if seed != 1 else 256))
    rows, c = blobs(spark, seed, spread=spread, extent=extent, size=size)
    want = least(rows, False)
    got = {(r["organoid_id"], r["endo"], r["meso"]): r["min_dist"] for r in clusters.lineage_pairs(c).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    one = least(rows, True)
    mean = {(r["organoid_id"], r["cell_type"]): r["distance"] for r in clusters.intra_distance(c).collect()}
    for s, t in mean:
        assert mean[s, t] == pytest.approx(np.mean([d for k, d in one.items() if k[:2] == (s, t)]), abs=1e-9)


def test_few_pairs_are_compared(spark):
    rows, c = blobs(spark, 5, per=5, size=200)
    m = clusters._members(c)
    a, b = (m.where(F.col("cell_type") == t).drop("cell_type") for t in (2.0, 3.0))
    p = closest.bounds(a, b, ["organoid_id"])
    shown = closest.shown(a, closest.boxes(a, ["organoid_id"]), ["organoid_id"]).count() * closest.shown(b, closest.boxes(b, ["organoid_id"]), ["organoid_id"]).count() / 2
    assert p.where(F.col("largest") <= closest.FEW).count() == 0
    met = shown + closest.met_members(a, b, p.drop("largest"), ["organoid_id"]).count()
    assert met < 0.1 * 2 * (5 * 200) ** 2


def test_clusters_of_one_cell_and_of_shared_places(spark):
    rows = [("a", 2.0, 0, 1, 0.0, 0.0, 0.0), ("a", 3.0, 0, 2, 0.0, 0.0, 0.0), ("a", 3.0, 1, 3, 3.0, 4.0, 0.0), ("b", 2.0, 0, 4, 0.0, 0.0, 0.0)]
    got = {(r["organoid_id"], r["endo"], r["meso"]): r["min_dist"] for r in clusters.lineage_pairs(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {("a", 0, 0): 0.0, ("a", 0, 1): 5.0}


@pytest.mark.parametrize("threshold", [0.0, 12.0, 60.0])
def test_touched_clusters_equal_all_pairs(spark, threshold):
    rows, c = blobs(spark, 7, extent=120.0)
    rows += [("a", 2.0, 90, 10 ** 6, -500.0, 0.0, 0.0), ("a", 3.0, 91, 10 ** 6 + 1, -500.0, 0.0, 0.0), ("b", 2.0, 92, 10 ** 6 + 2, 1e6, 0.0, 0.0), ("n", 2.0, -1, 5, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, SHAPE)
    near = {k for k, d in least(rows, False).items() if d <= threshold}
    got = {(r["organoid_id"], r["cell_type"], r["cluster_id"]) for r in clusters.touched(c, threshold).collect()}
    assert got == {(s, 2.0, e) for s, e, _ in near} | {(s, 3.0, m) for s, _, m in near}
    assert {(r["organoid_id"], r["endo"], r["meso"]) for r in clusters.touching(c, threshold).collect()} == near
    full = {r["organoid_id"]: r["minority_pct"] for r in clusters.adjacency(c, threshold).where("n_endo > 0 AND n_meso > 0").collect()}
    assert {r["organoid_id"]: r["adjacency_pct"] for r in clusters.adjacency_pct(c, threshold).collect()} == full
    plan = clusters.touched(c, threshold)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan


def test_spread_labels_equal_labels_of_one_task(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for s in "abc":
        for t in (2.0, 3.0):
            points = np.concatenate([r.uniform(0, 30, (150, 3)), r.normal(15, 2, (60, 3)), np.column_stack([np.arange(80) * 0.9, np.zeros(80), np.zeros(80)])])
            for p in r.permutation(points):
                rows.append((s, n, t, *map(float, p)))
                n += 1
    c = spark.createDataFrame(rows + [("d", n, 2.0, 0.0, 0.0, 0.0), ("d", n + 1, None, 0.0, 0.0, 0.0)], "organoid_id string, cell_id long, cell_type double, x double, y double, z double")
    params = [(1.0, 2), (3.0, 5), (2.0, 4)]
    one, two = (sorted(map(tuple, clusters.dbscan_sweep(c, params, method=m).collect())) for m in ("task", "spread"))
    assert one == two and len({x[-1] for x in one}) > 5
    monkeypatch.setattr(clusters, "SPREAD_FROM", 200)
    assert sorted(map(tuple, clusters.dbscan_sweep(c, params).collect())) == one
    assert clusters.dbscan_sweep(c.limit(0), params, method="spread").count() == 0


def test_components_of_many_graphs(spark):
    r = np.random.default_rng(4)
    edges = [(g, int(a), int(b)) for g in "xy" for a, b in r.integers(0, 300, (220, 2))] + [("p", i, i + 1) for i in range(100)] + [("s", 500, i) for i in range(60)]
    got = {(x["g"], x["node"]): x["component"] for x in rounds.components(spark.createDataFrame(edges, "g string, src long, dst long"), ["g"], rounds.Rounds(spark)).collect()}
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for g, a, b in edges:
        a, b = sorted((find((g, a)), find((g, b))))
        root[b] = a
    assert got == {n: find(n)[1] for n in root if any(n in ((g, a), (g, b)) and a != b for g, a, b in edges)}


def test_intermediates_are_deleted(spark):
    import os

    with rounds.intermediates(spark) as path:
        df = rounds.stored(spark.range(5))
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_ranks_of_large_and_small_groups(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") < 5, F.lit(1)).otherwise(2).alias("h"))
    got = ranked(df, ["g", "h"], draw(1, F.col("id")), "id").toPandas()
    import hashlib

    got["d"] = [hashlib.md5(f"1:{i}".encode()).hexdigest() for i in got["id"]]
    assert (got["rank"] == (got.sort_values(["d", "id"]).groupby(["g", "h"]).cumcount() + 1).sort_index()).all()


def test_permutation_p_of_order_and_noise(spark):
    r = np.random.default_rng(6)
    rows = [(s, i, float(x), float(y), 0.0, float(x if s == "order" else v if s == "noise" else 1.0)) for s in ("order", "noise", "flat") for i, (x, y, v) in enumerate(np.column_stack([r.uniform(0, 50, (80, 2)), r.normal(size=80)]))]
    rows += [("far", i, 1000.0 * i, 0.0, 0.0, float(i)) for i in range(4)]
    c = spark.createDataFrame(rows, "organoid_id string, cell_id long, x double, y double, z double, v double")
    got = {x["organoid_id"]: x for x in autocorr.permutation_p(c, "v", 12.0, rounds=39).collect()}
    plain = {x["organoid_id"]: x["morans_i"] for x in autocorr.morans_i(c, "v", 12.0).collect()}
    assert got["order"]["p_sim"] == pytest.approx(1 / 40) and got["noise"]["p_sim"] > 1 / 40
    assert got["order"]["morans_i"] == pytest.approx(plain["order"]) and got["noise"]["morans_i"] == pytest.approx(plain["noise"])
    assert got["flat"]["p_sim"] is None and got["far"]["p_sim"] is None and len(got) == 4
    again = {x["organoid_id"]: x["p_sim"] for x in autocorr.permutation_p(c, "v", 12.0, rounds=39).collect()}
    assert again == {k: x["p_sim"] for k, x in got.items()}


@pytest.mark.parametrize("thin", [1, 10 ** 6])
def test_largest_slab_equals_plain_sweep(spark, monkeypatch, thin):
    monkeypatch.setattr(geometry, "THIN_FROM", thin)
    r = np.random.default_rng(8)
    rows = [(s, float(x), float(y), float(z)) for s, heights in (("steps", 9), ("smooth", None)) for x, y, z in np.column_stack([r.normal(0, 20, (400, 2)), r.uniform(0, 60, 400) if heights is None else r.integers(0, heights, 400) * 5.0])]
    rows += [("line", float(i), float(i), float(i % 3)) for i in range(20)] + [("two", 0.0, 0.0, 0.0), ("two", 1.0, 0.0, 0.0), ("tie", 0.0, 0.0, 0.0), ("tie", 1.0, 0.0, 0.0), ("tie", 0.0, 1.0, 0.0), ("tie", 0.0, 0.0, 50.0), ("tie", 1.0, 0.0, 50.0), ("tie", 0.0, 1.0, 50.0)]
    c = spark.createDataFrame(rows, "organoid_id string, x double, y double, z double")
    got = {x["organoid_id"]: (x["z_center"], x["area"]) for x in geometry.max_biopsy_area(c, 5.0).collect()}
    pdf, want = pd.DataFrame(rows, columns=["s", "x", "y", "z"]), {}
    for s, g in pdf.groupby("s"):
        heights = np.unique(g["z"])
        heights = heights if len(heights) <= 81 else heights[[int(i * (len(heights) - 1) / 80) for i in range(81)]]
        found = [(a, h) for h in heights if (a := geometry.area_2d(g[(g["z"] >= h - 5.0) & (g["z"] <= h + 5.0)][["x", "y"]].to_numpy())) is not None]
        if found:
            best = max(a for a, _ in found)
            want[s] = (min(h for a, h in found if a == best), best)
    assert set(got) == set(want) == {"steps", "smooth", "tie"}
    assert all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1]) for s in want)


def test_hulls_of_outer_points_equal_hulls_of_all(spark, monkeypatch):
    monkeypatch.setattr(geometry, "THIN_FROM", 20)
    r = np.random.default_rng(9)
    clouds = {"ball": r.normal(size=(1500, 3)), "box": r.uniform(0, 9, (800, 3)), "plane": np.column_stack([r.uniform(0, 1, (50, 2)), np.zeros(50)]), "few": r.uniform(0, 1, (3, 3)), "far": r.normal(size=(500, 3)) * 1e-3 + 1e4}
    rows = [(s, *map(float, p)) for s, ps in clouds.items() for p in ps]
    c = spark.createDataFrame(rows, "organoid_id string, x double, y double, z double")
    got = {x["organoid_id"]: x for x in geometry.hull_volumes(c).collect()}
    areas = {x["organoid_id"]: x["area"] for x in geometry.hull_areas(c).collect()}
    left = {x["organoid_id"]: x["count"] for x in geometry.outer(c, ["organoid_id"]).groupBy("organoid_id").count().collect()}
    for s, ps in clouds.items():
        want = geometry.hull_3d(ps)
        assert got[s]["n_cells"] == len(ps) and ((got[s]["volume"], got[s]["surface"]) == (None, None) if want is None else (got[s]["volume"], got[s]["surface"]) == pytest.approx(want, rel=1e-9))
        assert areas[s] == pytest.approx(geometry.area_2d(ps[:, :2]), rel=1e-9)
    assert left["ball"] < 500 and left["plane"] == 50


def table(spark, n=48):
    r = np.random.default_rng(12)
    rows = []
    for i in range(n):
        e, d = f"e{i % 3}", [0, 10, 100, 1000][i % 4]
        u = np.log10(d + 1.0)
        rows.append((i, e, f"r{i // 3 % 2}", d, float(u), float(2 + i % 5), float(e == "e0"), float(e == "e1"), float(e == "e2"), float(u * u + r.normal()), float(i % 5 - u)))
    return rows, spark.createDataFrame(rows, "organoid_id long, experiment string, replicate string, dox int, u double, c double, h0 double, h1 double, h2 double, pc1 double, pc2 double")


INPUTS, TARGETS = ["u", "c", "h0", "h1", "h2"], ["pc1", "pc2"]


@pytest.mark.parametrize("kind", ["LOR", "LOEX", "RANDOM", "CUSTOM"])
def test_models_from_sums_equal_models_on_arrays(spark, kind):
    rows, t = table(spark)
    folds = {"LOR": predict.lor_folds, "LOEX": predict.loex_folds, "RANDOM": predict.random_folds, "CUSTOM": lambda f: predict.holdout(f, ["e0"], ["e2"])}[kind](t)
    models = [*predict.MODELS, "poly_selected"]
    got = predict.predictions(t, folds, INPUTS, TARGETS, models, alphas=[0.5, 10.0], hide=["h0", "h1", "h2"]).toPandas()
    side = folds.toPandas()
    by = {r[0]: r for r in rows}
    x = lambda ids: np.array([by[i][4:9] for i in ids])
    y = lambda ids: np.array([by[i][9:] for i in ids])
    assert len(got) == 2 * len(models) * (side["role"] == "test").sum()
    for (fold, model, alpha), g in got.groupby(["fold", "model", "alpha"]):
        s = side[side["fold"] == fold]
        train, test = s[s["role"] == "train"]["row_id"], g["row_id"]
        new = x(test)
        if kind in ("LOEX", "CUSTOM"):
            new[:, 2:] = 0.0
        want = predict.fit_predict(x(train), y(train), new, model, alpha)
        assert np.allclose(g[["pred_pc1", "pred_pc2"]].to_numpy(), want, atol=1e-7) and np.allclose(g[["true_pc1", "true_pc2"]].to_numpy(), y(test))


def test_tuning_selects_the_least_inner_error(spark):
    rows, t = table(spark)
    folds = predict.lor_folds(t)
    grid = [0.01, 1.0, 30.0, 1000.0]
    got = predict.tune(t, folds, INPUTS, TARGETS, "poly_selected", grid).toPandas()
    import hashlib

    by = {r[0]: r for r in rows}
    side = folds.toPandas()
    for fold, g in got.groupby("fold"):
        train = sorted(side[(side["fold"] == fold) & (side["role"] == "train")]["row_id"])
        errors = {a: [] for a in grid}
        for i in range(3):
            order = sorted(train, key=lambda r: hashlib.md5(f"42:{fold}:{i}:{r}".encode()).hexdigest())
            k = max(1, round(0.2 * len(train)))
            x, y = np.array([by[r][4:9] for r in order]), np.array([by[r][9:] for r in order])
            for a in grid:
                p = predict.fit_predict(x[k:], y[k:], x[:k], "poly_selected", a)
                errors[a].append(np.sqrt(((p - y[:k]) ** 2).mean(axis=0)).mean())
        rows_ = g.set_index("alpha")
        for a in grid:
            assert rows_.loc[a, "inner_mean"] == pytest.approx(np.mean(errors[a])) and rows_.loc[a, "inner_sd"] == pytest.approx(np.std(errors[a], ddof=1))
        assert list(rows_.index[rows_["selected"]]) == [min(grid, key=lambda a: (np.mean(errors[a]), grid.index(a)))]
    used = predict.tuned_predictions(t, folds, INPUTS, TARGETS, "poly_selected", grid).select("fold", "alpha").distinct().toPandas()
    assert sorted(map(tuple, used.to_numpy().tolist())) == sorted(map(tuple, got[got["selected"]][["fold", "alpha"]].to_numpy().tolist()))


def test_hold_out_needs_rows_on_both_sides(spark):
    _, t = table(spark)
    few = t.where("experiment <> 'e0' OR organoid_id < 12")
    assert predict.holdout(few, ["e1"], ["e0"]).count() == 20 and predict.holdout(few.where("organoid_id > 0"), ["e1"], ["e0"]).count() == 0
    assert predict.holdout(few, ["e0"], ["e1"]).count() == 0 and predict.holdout(t, ["none"], ["e1"]).count() == 0


def test_encodings_feed_the_models(spark):
    _, t = table(spark)
    t = predict.cn_draws(t, {"e0": 1.0, "e1": 5.0, "e2": 9.0})
    folds = predict.lor_folds(t)
    p = predict.encoded_predictions(t, folds, TARGETS, models=["ridge_linear"], dose="u", hot=["h0", "h1", "h2"])
    sets = {e: sorted((r["row_id"], r["pred_pc1"]) for r in p.where(F.col("encoding") == e).collect()) for e in predict.ENCODINGS}
    assert len({json.dumps(v) for v in sets.values()}) == 3 and all(len(v) == 48 for v in sets.values())
    assert predict.encodings(["summary", "lambda", "summary"]) == ["summary", "lambda"] and predict.encodings(["lambda", "all"]) == list(predict.ENCODINGS)
    with pytest.raises(ValueError):
        predict.encodings(["none"])


def test_hold_out_report_has_a_trajectory_row(spark):
    p = spark.createDataFrame([("m", "e", d, float(d), float(d) + 1, 0.0, 1.0) for d in (0, 1, 2)], "model string, experiment string, dox int, true_pc1 double, pred_pc1 double, true_pc2 double, pred_pc2 double")
    got = {r["pc"]: r for r in predict.holdout_report(p, TARGETS).collect()}
    assert set(got) == {"pc1", "pc2", "TRAJECTORY"} and got["pc2"]["r2"] is None and got["pc1"]["rmse"] == 1.0
    assert (got["TRAJECTORY"]["rmse"], got["TRAJECTORY"]["mae"], got["TRAJECTORY"]["angle"]) == pytest.approx((2 ** 0.5, 2 ** 0.5, 0.0), abs=1e-6)


def tail_by_series(h, df):
    return 1.0 if h <= 0 else 1.0 - sum(exp((df / 2 + n) * log(h / 2) - h / 2 - lgamma(df / 2 + n + 1)) for n in range(3000))


@pytest.mark.parametrize("h,df,p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (67.50480654954123, 50, 0.05), (7.2, 2, exp(-3.6)), (700.0, 3, 0.0), (0.0, 3, 1.0)] + [(h, df, tail_by_series(h, df)) for h in (1e-8, 0.1, 3.0, 200.0) for df in (1, 2, 5, 41, 150)])
def test_chi_squared_tail(spark, h, df, p):
    got = spark.createDataFrame([(h, df)], "h double, k int").select(compare.chi2_tail(F.col("h"), F.col("k")).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=1e-9)


def test_bootstrap_interval(spark):
    r = np.random.default_rng(2)
    v = r.normal(10, 3, 200)
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(v)] + [(0, "one", 4.0), (1, "none", None)], "id long, k string, value double")
    got = {x["k"]: x for x in compare.bootstrap95(df, ["k"], "id", rounds=400).collect()}
    half = 1.96 * v.std(ddof=1) / 200 ** 0.5
    assert got["g"]["mean"] == pytest.approx(v.mean()) and abs(got["g"]["low"] - (v.mean() - half)) < 0.25 * half and abs(got["g"]["high"] - (v.mean() + half)) < 0.25 * half
    assert (got["one"]["low"], got["one"]["high"]) == (4.0, 4.0) and "none" not in got
    assert compare.bootstrap95(df, ["k"], "id", rounds=400, seed=1).where("k = 'g'").first()["low"] != got["g"]["low"]


def test_semi_join_within_a_radius(spark):
    r = np.random.default_rng(1)
    points = [(s, i, *map(float, p)) for s in "ab" for i, p in enumerate(r.uniform(-20, 20, (150, 3)))]
    df = spark.createDataFrame(points, "organoid_id string, cell_id long, x double, y double, z double")
    a, b = df.where("cell_id % 2 = 0"), df.where("cell_id % 2 = 1")
    got = {(x["organoid_id"], x["cell_id"]) for x in neighbors.within(a, b, 6.0).collect()}
    assert got == {(p[0], p[1]) for p in points if p[1] % 2 == 0 and any(q[0] == p[0] and q[1] % 2 and sum((u - w) ** 2 for u, w in zip(p[2:], q[2:])) <= 36 for q in points)} and 10 < len(got) < 140


def test_pruning_by_condition_of_file_names(spark):
    from cellgrove.operators import sampling

    rows = [("exp_BMP4", "Rep1", f"10dox_bmp4_x_{i}.csv", v) for i, v in enumerate((50.0, 51.0, 49.0, 90.0))] + [("exp_BMP4", "Rep1", f"10dox_none_x_{i}.csv", float(i)) for i in range(3)] + [("plain", "Rep1", f"10dox_{k}_{i}.csv", v) for k, i, v in (("a", 1, 5.0), ("b", 2, 5.5), ("c", 3, 4.5), ("d", 4, 99.0))]
    got = sampling.prune_files(spark.createDataFrame(rows, "experiment string, replicate string, file string, v double"), ["v"]).collect()
    assert sorted(tuple(r) for r in got) == [("exp_BMP4", "Rep1", "10dox_bmp4", "10dox_bmp4_x_3.csv", 1), ("plain", "Rep1", "10dox", "10dox_d_4.csv", 1)]


def test_rows_without_a_key_form_no_group(spark):
    rows = [(i, "e", d, "r", float(v)) for i, (d, v) in enumerate([(0, 1), (0, 2), (10, 3), (10, 5)])] + [(9, "e", None, "r", 50.0), (10, None, 0, "r", 60.0), (11, "e", 0, None, 70.0)]
    f = spark.createDataFrame(rows, "organoid_id long, experiment string, dox int, replicate string, v double")
    assert {r["k"] for r in compare.kruskal(f, ["v"]).collect()} == {2}
    assert [r["transition"] for r in compare.dose_steps(f.where("replicate IS NOT NULL").withColumn("w", F.col("v")), ["v", "w"]).collect()] == ["0->10"]
    left = {r["organoid_id"]: r["v"] for r in compare.residualize(f, ["v"]).collect()}
    assert left[9] is None and left[10] is None and left[11] is None and left[2] == 3.0


def test_components_by_number_and_enough_of_them(spark):
    from cellgrove.operators import pca

    assert pca.component_columns(["pc10", "pc2", "x", "pc1", "pca"]) == ["pc1", "pc2", "pc10"]
    r = np.random.default_rng(0)
    f = spark.createDataFrame([(str(i), "e", *map(float, v)) for i, v in enumerate(r.normal(size=(9, 2)))], "organoid_id string, experiment string, a double, b double")
    assert len(pca.frozen(f, ["a", "b"], 2).components) == 2
    with pytest.raises(ValueError):
        pca.frozen(f, ["a", "b"], 3)
