"""Principal components of a feature table: Spark sums the Gram matrix, only that (at most 17 x 17) is collected."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellgrove.operators import compare


@dataclass
class Space:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    ratio: np.ndarray
    basis: str
    n_fit: int


def basis_rows(f: DataFrame, features, basis: str) -> DataFrame:
    """The rows that a space is fitted on: all, or centroids by experiment and dose, or by experiment."""
    keys = {"all": None, "exp_dox_centroids": ["experiment", "dox"], "exp_centroids": ["experiment"]}[basis]
    return f.select(*features) if keys is None else f.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in features))


def fit(f: DataFrame, features, basis: str = "auto", most: int = 5) -> Space:
    """Standardised by population deviation; the largest loading of each component is positive."""
    found = f.agg(F.count("*").alias("n"), F.countDistinct("experiment").alias("e"), *(F.count(c).alias(c) for c in features)).first()
    features = [c for c in features if found[c]]
    if basis == "auto":
        basis = "exp_dox_centroids" if found["e"] > 1 else "all"
    if found["n"] < 5 or not features:
        raise ValueError("a space needs five rows and one feature")
    rows = basis_rows(f, features, basis).na.drop()
    s = rows.agg(F.count("*").alias("n"), *(g(c).alias(f"{k}_{c}") for c in features for k, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if s["n"] < 2:
        raise ValueError("a space needs two rows to fit")
    mean = np.array([s[f"m_{c}"] for c in features])
    scale = np.array([s[f"s_{c}"] or 1.0 for c in features])
    z = [(F.col(c) - float(m)) / float(d) for c, m, d in zip(features, mean, scale)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    g = rows.agg(*(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    gram = np.zeros((len(z), len(z)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = g[f"g{i}_{j}"]
    value, vector = np.linalg.eigh(gram / max(s["n"] - 1, 1))
    order = np.argsort(value)[::-1]
    value, vector = np.maximum(value[order], 0), vector[:, order].T
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(axis=1)])
    k = min(len(features), s["n"] - 1, most)
    return Space(features, mean, scale, (vector * sign[:, None])[:k], value[:k] / (value.sum() or 1.0), basis, s["n"])


def project(f: DataFrame, space: Space, keep=("organoid_id", "experiment", "replicate", "dox")) -> DataFrame:
    z = [(F.col(c) - float(m)) / float(d) for c, m, d in zip(space.features, space.mean, space.scale)]
    out = [sum((x * float(v) for x, v in zip(z[1:], row[1:])), z[0] * float(row[0])).alias(f"pc{i}") for i, row in enumerate(space.components, 1)]
    return f.select(*keep, *out)


def variance(spark, space: Space) -> DataFrame:
    rows = [(f"pc{i}", float(r), float(c)) for i, (r, c) in enumerate(zip(space.ratio, np.cumsum(space.ratio)), 1)]
    return spark.createDataFrame(rows, "pc string, ratio double, cumulative double")


def loadings(spark, space: Space) -> DataFrame:
    rows = [(c, f"pc{i}", float(row[j])) for i, row in enumerate(space.components, 1) for j, c in enumerate(space.features)]
    return spark.createDataFrame(rows, "feature string, pc string, loading double")


def top_loadings(table: DataFrame, n: int = 3) -> DataFrame:
    place = F.row_number().over(W.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "feature"))
    return table.withColumn("place", place).where(F.col("place") <= n)


def ordered_loadings(table: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """Loadings with ``place`` on the axis from 1 and the ``group`` it lies in: features of the groups in their order, then the rest by name."""
    known = [(f, g, i) for i, (f, g) in enumerate(((f, g) for g, names in groups for f in names), 1)]
    order = table.sparkSession.createDataFrame(known or [("", "", 0)], "feature string, `group` string, fixed int")
    joined = table.join(F.broadcast(order), "feature", "left")  # one row for each named feature
    place = F.row_number().over(W.partitionBy("pc").orderBy(F.col("fixed").asc_nulls_last(), "feature"))
    return joined.select("feature", "pc", "loading", F.coalesce("group", F.lit("other")).alias("group"), place.alias("place"))


def reconstruct(scores: DataFrame, space: Space, keep=("organoid_id",)) -> DataFrame:
    """Features back from scores; missing components are zero."""
    have = [i for i in range(len(space.components)) if f"pc{i + 1}" in scores.columns]
    out = []
    for j, c in enumerate(space.features):
        z = F.lit(0.0)
        for i in have:
            z = z + F.col(f"pc{i + 1}") * float(space.components[i, j])
        out.append((z * float(space.scale[j]) + float(space.mean[j])).alias(c))
    return scores.select(*keep, *out)


def prepared(f: DataFrame, features, mode: str = "raw") -> DataFrame:
    """The table a space is fitted on: normalised, residualised on demand, imputed."""
    if mode not in ("raw", "none", "residualized"):
        raise ValueError(mode)
    f = compare.normalize(f)
    if mode == "residualized":
        f = compare.residualize(f, features)
    return compare.impute(f, features)


def component_columns(names) -> list[str]:
    """The columns ``pc1``, ``pc2``, ... by number, so that ``pc10`` follows ``pc9``."""
    return sorted((n for n in names if n[:2] == "pc" and n[2:].isdigit()), key=lambda n: int(n[2:]))


def frozen(f: DataFrame, features, targets: int, basis: str = "auto", most: int = 5) -> Space:
    """A space that models are trained in; an error where it has fewer components than targets."""
    space = fit(f, features, basis, max(most, targets))
    if len(space.components) < targets:
        raise ValueError(f"{len(space.components)} components, {targets} are needed")
    return space
