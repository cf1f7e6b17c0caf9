"""Cell tables from folders of CSV files, one file per sample; keys come from the path.

Files are read by the ``cellfiles`` data source: each is opened once, by one task,
and its columns are found by its own header.
"""
from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellgrove.sources.cell_files import AXES, CHANNELS, TYPE_NAMES, CellFiles  # noqa: F401


def path_keys(path) -> dict:
    """Dose, number, condition, replicate and file name from a path column."""
    name = F.element_at(F.split(path, "/"), -1)
    empty = lambda c: F.when(c != "", c)
    condition = F.upper(F.regexp_extract(name, r"\+(.+?)_", 1))
    return {
        "file": name,
        "replicate": F.element_at(F.split(path, "/"), -2),
        "dox": empty(F.regexp_extract(name, r"(\d+)dox", 1)).cast("int"),
        "leading_dox": F.when(F.element_at(F.split(name, "dox"), 1).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.element_at(F.split(name, "dox"), 1))).cast("int"),
        "number": empty(F.regexp_extract(name, r"_(\d+)\.csv$", 1)).cast("int"),
        "condition": F.when(condition != "", condition).otherwise("BASAL"),
    }


def _load(spark: SparkSession, folder: str | None, content: str, **options) -> DataFrame:
    spark.dataSource.register(CellFiles)
    r = spark.read.format("cellfiles").option("content", content)
    for k, v in options.items():
        if v is not None:
            r = r.option(k, v)
    return r.load(folder) if folder else r.load()


def manifest(spark: SparkSession, folder: str, glob: str = "*.csv", content: str = "listing", discover: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, relative, header, problem and the keys of the path) of every file below ``folder``.

    ``content`` of ``listing`` opens no file; ``headers`` reads first lines.
    ``discover`` keeps files that lie directly in directories of such a name, and
    ``experiment`` is then the directory above.
    """
    files = _load(spark, folder, content, glob=glob, discover=discover, recursive=str(recursive).lower())
    out = files.select("path", "relative", "header", "problem").withColumns(path_keys(F.col("path")))
    return out.withColumn("experiment", F.element_at(F.split("path", "/"), -3)) if discover else out


def _shaped(files: DataFrame, experiment, default_dose: int | None, dose_rule: str) -> DataFrame:
    cells = files.where("problem IS NULL").withColumns(path_keys(F.col("path")))
    parsed = F.col("leading_dox" if dose_rule == "leading" else "dox")
    cells = cells.withColumn("dox", F.coalesce("dose", parsed, F.lit(default_dose).cast("int")))
    if dose_rule == "leading":
        cells = cells.where("dox IS NOT NULL")
    cells = cells.withColumn("experiment", experiment).withColumn("organoid_id", F.concat_ws("/", "experiment", "relative"))
    return cells.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(
        (F.col("row") + 1).alias("cell_id"), "organoid_id", "experiment", "replicate", "dox", "condition", "number", "x", "y", "z", "cell_type", *CHANNELS)


def read_cells(spark: SparkSession, folder: str, experiment: str, first_n: int | None = None, default_dose: int | None = None, glob: str = "*.csv", recursive: bool = True, dose_rule: str = "anywhere") -> DataFrame:
    """One row per cell with a full place; ``first_n`` keeps the samples of least number by replicate, dose and condition.

    A sample is named by the experiment and its path below the folder, so equal file
    names in two places stay apart.  ``dose_rule``: ``anywhere`` takes the number
    before "dox" wherever it stands in the name; ``leading`` takes names that begin
    with it and leaves the other files out.  Values that are no finite number read as
    NULL.  Files that cannot be used give no rows (see ``rejected``).
    """
    if dose_rule not in ("anywhere", "leading"):
        raise ValueError(f"unknown dose rule {dose_rule}")
    options = {"glob": glob, "recursive": str(recursive).lower()}
    if first_n and first_n > 0:
        files = manifest(spark, folder, glob, recursive=recursive)
        dose = F.coalesce("dox", F.lit(default_dose).cast("int"))
        place = F.row_number().over(W.partitionBy("replicate", dose, "condition").orderBy("number", "path"))
        kept = files.where(F.col("number").isNotNull() & dose.isNotNull()).withColumn("_p", place).where(F.col("_p") <= first_n)
        # the chosen part of the file list, which the driver lists anyway; only these files are opened
        chosen = [r["path"] for r in kept.select("path").collect()]
        if not chosen:
            raise ValueError(f"no file below {folder} has a number and a dose")
        files = _load(spark, folder, "cells", files=json.dumps(dict.fromkeys(chosen)))
    else:
        files = _load(spark, folder, "cells", **options)
    return _shaped(files, F.lit(experiment), default_dose, dose_rule)


def discover(spark: SparkSession, folder: str, pattern: str = "*Rep*", glob: str = "*.csv") -> DataFrame:
    """Cells of all files that lie directly in directories whose name fits ``pattern``, at any depth; the directory above is the experiment."""
    files = _load(spark, folder, "cells", glob=glob, discover=pattern)
    return _shaped(files, F.element_at(F.split("path", "/"), -3), None, "anywhere")


def read_files(spark: SparkSession, doses: dict[str, int], experiment: str) -> DataFrame:
    """Cells of an explicit map of path to dose."""
    return _shaped(_load(spark, None, "cells", files=json.dumps(doses)), F.lit(experiment), None, "anywhere")


def read_pattern(spark: SparkSession, folder: str, experiment: str, pattern: str, doses: Iterable[int], replicates: Iterable[str]) -> DataFrame:
    """Cells of the files ``replicate/pattern`` for each replicate and dose; ``{dox}`` in the pattern stands for the dose."""
    from fnmatch import fnmatchcase

    listed = [r["path"] for r in manifest(spark, folder).select("path").collect()]
    below = lambda p: p.split("/")[-2:]
    chosen = {p: d for d in doses for p in listed if below(p)[0] in set(replicates) and fnmatchcase(below(p)[1], pattern.replace("{dox}", str(d)))}
    return read_files(spark, chosen, experiment)


def rejected(spark: SparkSession, folder: str, glob: str = "*.csv", content: str = "cells") -> DataFrame:
    """(path, reason) of files that ``read_cells`` gives no rows for; ``content`` of ``headers`` judges them by their first lines only."""
    return _load(spark, folder, content, glob=glob).where("problem IS NOT NULL").select("path", F.col("problem").alias("reason"))


def land(cells: DataFrame, path: str) -> None:
    """Cells as Parquet by experiment, so that later reads prune files and columns."""
    cells.write.mode("overwrite").partitionBy("experiment").parquet(path)
