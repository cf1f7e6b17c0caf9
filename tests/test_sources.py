"""Reading folders of cell files, writing tables, streaming, command line."""
import json
import os

import pytest

from cellgrove.__main__ import parser
from cellgrove.sources import csv_cells, sinks
from cellgrove.streaming.ingest import land_stream


@pytest.fixture()
def folder(tmp_path):
    rep = tmp_path / "set" / "Rep1"
    old = tmp_path / "set" / "_archive"
    rep.mkdir(parents=True), old.mkdir()
    good = "X,Y,Z,cell_type_dapi_adjusted\n1,2,3,2\n4,5,nan,3\n7,8,9,\n"
    (rep / "100dox_GATA_001.csv").write_text(good)
    (rep / "100dox_GATA_002.csv").write_text("cell_type_dapi_adusted,Global Z,Global Y,Global X\n3.0,3,2,1\n")
    (rep / "100dox_GATA_003.csv").write_text(good)
    (rep / "100dox_GATA_004.csv").write_text(good)
    (rep / "10dox+bmp4_x_002.csv").write_text(good)
    (rep / "nodose_1.csv").write_text(good)
    (rep / "bad_5dox_1.csv").write_text("A,B\n1,2\n")
    (old / "100dox_GATA_009.csv").write_text(good)
    return str(tmp_path / "set")


def test_headers_and_keys(spark, folder):
    c = csv_cells.read_cells(spark, folder, "exp1").toPandas()
    two = c[c.organoid_id.str.endswith("_002.csv") & (c.dox == 100)]
    assert two[["x", "y", "z", "cell_type"]].values.tolist() == [[1.0, 2.0, 3.0, 3.0]]
    assert not c.organoid_id.str.contains("009").any() and c.z.notna().all()
    assert set(c[c.dox == 10].condition) == {"BMP4"} and set(c[c.dox == 100].condition) == {"BASAL"}
    assert c[c.organoid_id.str.contains("nodose")].dox.isna().all() and set(c.replicate) == {"Rep1"}
    assert csv_cells.rejected(spark, folder).count() == 1


def test_first_three(spark, folder):
    c = csv_cells.read_cells(spark, folder, "exp1", 3)
    names = {r["organoid_id"].split("_")[-1] for r in c.where("dox = 100").collect()}
    assert names == {"001.csv", "002.csv", "003.csv"}


def names(df):
    return sorted({r["organoid_id"] for r in df.collect()})


def test_equal_names_in_two_folders(spark, tmp_path):
    for k, d in enumerate("ab"):
        (tmp_path / d / "Rep1").mkdir(parents=True)
        (tmp_path / d / "Rep1" / "5dox_1.csv").write_text(f"X,Y,Z,cell_type\n{k},0,0,2\n")
    both = csv_cells.read_files(spark, {f"{tmp_path}/a/Rep1/5dox_1.csv": 7, f"{tmp_path}/b/Rep1/5dox_1.csv": 9}, "e")
    assert sorted((r["organoid_id"][-18:], r["dox"], r["x"], r["cell_id"]) for r in both.collect()) == [("/a/Rep1/5dox_1.csv", 7, 0.0, 1), ("/b/Rep1/5dox_1.csv", 9, 1.0, 1)]
    one = csv_cells.read_files(spark, {f"file://{tmp_path}/a/Rep1/5dox_1.csv": 7}, "e").collect()
    assert [(r["dox"], r["replicate"]) for r in one] == [(7, "Rep1")]
    assert len(names(csv_cells.read_cells(spark, str(tmp_path), "e", 1))) == 1 and len(names(csv_cells.read_cells(spark, str(tmp_path), "e"))) == 2


def test_patterns_and_listing(spark, folder):
    got = csv_cells.read_pattern(spark, folder, "e", "{dox}dox_GATA_*.csv", [100, 25], ["Rep1"])
    assert {n.split("_")[-1] for n in names(got)} == {"001.csv", "002.csv", "003.csv", "004.csv"} and {r["dox"] for r in got.collect()} == {100}
    assert len(names(csv_cells.read_cells(spark, folder, "e", glob="*dox*.csv"))) == 5
    assert names(csv_cells.read_cells(spark, f"{folder}/Rep1", "e", glob="100dox*", recursive=False)) == [f"e/100dox_GATA_00{i}.csv" for i in range(1, 5)]
    listed = csv_cells.manifest(spark, folder).collect()
    assert len(listed) == 7 and all(r["header"] is None for r in listed)
    assert {r["header"] for r in csv_cells.manifest(spark, folder, "bad*", "headers").collect()} == {"A,B"}


def test_discovery_of_replicates(spark, tmp_path):
    good = "X,Y,Z,cell_type\n1,2,3,2\n"
    for place in ("exp1/x_Rep1", "exp1/x_Rep2", "exp2_BMP4/Rep1", "exp1/x_Rep1/_archive", "exp1/other", "exp3_Rep1-2/Rep1/deep"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "10dox_a_1.csv").write_text(good)
    got = csv_cells.discover(spark, str(tmp_path)).select("experiment", "replicate").distinct().collect()
    assert sorted(map(tuple, got)) == [("exp1", "x_Rep1"), ("exp1", "x_Rep2"), ("exp2_BMP4", "Rep1")]
    assert csv_cells.manifest(spark, str(tmp_path), discover="*Rep*").count() == 3


def test_leading_dose_rule(spark, folder):
    from pathlib import Path

    Path(folder, "Rep1", "day2_50dox_x_1.csv").write_text("X,Y,Z,cell_type\n1,2,3,2\n")
    anywhere, leading = (csv_cells.read_cells(spark, folder, "e", dose_rule=r).select("organoid_id", "dox").distinct().collect() for r in ("anywhere", "leading"))
    assert {r["organoid_id"].split("/")[-1] for r in anywhere} - {r["organoid_id"].split("/")[-1] for r in leading} == {"day2_50dox_x_1.csv", "nodose_1.csv"}
    with pytest.raises(ValueError):
        csv_cells.read_cells(spark, folder, "e", dose_rule="none")


def test_broken_files_cost_only_themselves(spark, tmp_path):
    (tmp_path / "r").mkdir()
    rows = {"wide_1.csv": "X,Y,Z,cell_type\n1,2,3,2\n1,2,3,2,9\n", "text_2.csv": 'X,Y,Z,"cell_type",note\n1,two,3,2,a\n 4 ,5,inf,2,b\n6,7,8,,"c, d"\n9,9,9,nan,e\n',
            "only_header_3.csv": "X,Y,Z,cell_type", "empty_4.csv": "", "bom_5.csv": "\ufeffX,Y,Z,cell_type\r\n1,2,3,3\r\n"}
    for n, t in rows.items():
        (tmp_path / "r" / n).write_text(t, newline="")
    (tmp_path / "r" / "bytes_6.csv").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "r" / "long_7.csv").write_text(",".join(["X", "Y", "Z", "cell_type"] + [f"c{i}" for i in range(20000)]) + "\n" + ",".join(["1"] * 20004) + "\n")
    got = {r["organoid_id"].split("/")[-1]: r for r in csv_cells.read_cells(spark, str(tmp_path), "e", default_dose=0).collect()}
    assert set(got) == {"text_2.csv", "bom_5.csv", "long_7.csv"} and got["bom_5.csv"]["cell_type"] == 3.0 and got["bom_5.csv"]["dox"] == 0
    assert sorted((r["cell_id"], r["x"], r["cell_type"]) for r in csv_cells.read_cells(spark, str(tmp_path), "e", glob="text*").collect()) == [(3, 6.0, None), (4, 9.0, None)]
    assert {r["path"].rsplit("/", 1)[1] for r in csv_cells.rejected(spark, str(tmp_path)).collect()} == {"wide_1.csv", "empty_4.csv", "bytes_6.csv"}
    assert {r["path"].rsplit("/", 1)[1] for r in csv_cells.rejected(spark, str(tmp_path), content="headers").collect()} == {"empty_4.csv", "bytes_6.csv"}


def test_each_file_is_opened_once(spark, folder, monkeypatch):
    import io

    from cellgrove.sources import cell_files

    opens = []
    real = io.BufferedReader
    monkeypatch.setattr(cell_files.io, "BufferedReader", lambda f, n: opens.append(1) or real(f, n))
    reader = cell_files.CellFilesReader({"path": folder, "packed": "1"})
    parts = reader.partitions()
    assert len(parts) == 7 and sum(b.num_rows for p in parts for b in reader.read(p)) == 17 and len(opens) == 7


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    assert spark.read.parquet(sinks.write_table(df, f"{tmp_path}/t")).count() == 3
    assert sinks.write_new({"a": df, "b": df}, str(tmp_path), ["b"]) == [f"{tmp_path}/b"]
    assert json.load(open(sinks.write_manifest(f"{tmp_path}/m", {"n": 1})))["n"] == 1 and os.path.isdir(f"{tmp_path}/b")


def test_stream(spark, folder, tmp_path):
    import shutil

    src = tmp_path / "in" / "Rep1"
    src.mkdir(parents=True)
    shutil.copy(f"{folder}/Rep1/100dox_GATA_001.csv", src)
    for k in range(2):
        land_stream(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/ck", "e").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * (k + 1)
        shutil.copy(f"{folder}/Rep1/100dox_GATA_003.csv", src)


def test_flags():
    a = parser().parse_args(["features", "--data", "e=f", "--out", "o"])
    assert (a.eps, a.min_samples, a.radius, a.touch, a.limit) == (30.0, 20, 100.0, 30.0, 3)


def experiment(tmp_path, name, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    for rep in (1, 2):
        (tmp_path / name / f"x_Rep{rep}").mkdir(parents=True)
        for dox in (0, 10, 100):
            for k in (1, 2, 3, 4):
                p = np.concatenate([r.normal(c, 6, (30, 3)) for c in (0, 60 + dox / 5)] * 2)
                kind = np.repeat([2.0, 3.0], 60)
                kind[r.random(120) < 0.1] = 0.0
                rows = [f"{x:.3f},{y:.3f},{z:.3f},{t},{x + seed:.3f},{y:.3f}" for (x, y, z), t in zip(p, kind)]
                (tmp_path / name / f"x_Rep{rep}" / f"{dox}dox_x_{k:03d}.csv").write_text("X,Y,Z,cell_type_dapi_adjusted,log1p_normed_546,log1p_normed_647\n" + "\n".join(rows) + "\n")
    return f"{name}={tmp_path}/{name}"


COMMON = ["--eps", "12", "--min-samples", "4", "--radius", "20", "--touch", "15", "--group-by-runtime", "no"]


def test_command_line_of_predictions(spark, tmp_path):
    from cellgrove.__main__ import main

    data = [x for n, s in (("a", 1), ("b", 2), ("c", 3)) for x in ("--data", experiment(tmp_path, n, s))]
    main(["predict", *data, "--out", f"{tmp_path}/out", *COMMON, "--limit", "2", "--cn", "a:2,b:5,c:8", "--cn-encoding", "lambda", "--target-pcs", "2", "--stress-train", "a", "b", "--stress-test", "c", "none"])
    table = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/{n}")
    assert {r["split_type"] for r in table("fold_means").collect()} == {"LOR", "LOEX", "RANDOM"}
    assert {r["pc"] for r in table("holdout").collect()} == {"pc1", "pc2", "TRAJECTORY"} and table("missing_experiments").collect()[0]["experiment"] == "none"
    assert table("feature_errors").where("rmse IS NULL").count() == 0 and table("predictions").where("split_type = 'LOEX'").count() == 3 * 36


def test_command_line_of_sweeps_pruning_and_trajectories(spark, tmp_path):
    from cellgrove.__main__ import main

    data = ["--data", experiment(tmp_path, "a", 1)]
    main(["sweep", *data, "--out", f"{tmp_path}/s", *COMMON, "--sweep-eps", "8,12"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/s/summary").count() == 2 * 3 * 2
    main(["prune", *data, "--out", f"{tmp_path}/p", *COMMON])
    archive = spark.read.option("header", True).csv(f"{tmp_path}/p/archive").collect()
    assert len(archive) == 6 and {(r["replicate"], r["condition"]) for r in archive} == {(f"x_Rep{i}", f"{d}dox") for i in (1, 2) for d in (0, 10, 100)}
    main(["trajectory", *data, "--out", f"{tmp_path}/t", *COMMON, "--replicate-adjust", "both", "--pca-fit-basis", "all_organoids", "--size-ablation", "log1p", "--trajectory-group-by", "experiment"])
    assert {"raw_scores", "residualized_scores", "feature_significance"} <= set(os.listdir(f"{tmp_path}/t")) and spark.read.option("header", True).csv(f"{tmp_path}/t/raw_centroids").count() == 1
    (tmp_path / "t" / "raw_scores" / "mark").write_text("")
    os.rename(f"{tmp_path}/t/raw_variance", f"{tmp_path}/moved")
    main(["trajectory", *data, "--out", f"{tmp_path}/t", *COMMON, "--append-only"])
    assert os.path.exists(f"{tmp_path}/t/raw_scores/mark") and os.path.isdir(f"{tmp_path}/t/raw_variance")


def test_append_only_writes_what_is_missing(spark, tmp_path):
    df = spark.range(3)
    assert sinks.write_new({"a": df, "b": df}, str(tmp_path), ["a"]) == [f"{tmp_path}/a"]
    assert sinks.write_new({"a": spark.range(9), "b": df}, str(tmp_path), append_only=True) == [f"{tmp_path}/b"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").count() == 3


def test_command_line_of_statistics_and_geometry(spark, tmp_path):
    from cellgrove.__main__ import main

    one, two = experiment(tmp_path, "a", 1), experiment(tmp_path, "b", 2)
    table = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/{n}")
    main(["autocorrelation", "--data", one, "--out", f"{tmp_path}/auto", *COMMON, "--limit", "1", "--permutations", "19"])
    assert {r["p_sim"] for r in table("auto/morans_i_ch_546").collect()} == {0.05} and table("auto/lisa_ch_647").count() == table("auto/spatial_power").count() == 6
    main(["geometry", "--data", one, "--out", f"{tmp_path}/geo", *COMMON, "--limit", "1"])
    assert table("geo/hull_3d").where("volume > 0").count() == table("geo/max_slab").where("area > 0").count() == 6
    main(["delta", "--data", one, "--data", two, "--out", f"{tmp_path}/delta", *COMMON, "--baseline", "a", "--treatment", "b"])
    assert table("delta/delta").count() == 18 and not os.path.exists(f"{tmp_path}/delta/feature_matrix")
    with pytest.raises(SystemExit):
        main(["delta", "--data", one, "--out", f"{tmp_path}/none", *COMMON])
