"""The 17-feature vector of a sample, on a spine of all samples so that empty lineages survive."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import clusters, compare, mixing
from cellgrove.operators.rounds import stored
from cellgrove.schema import ENDO, EPS, FEATURES, META, MIN_SAMPLES, NMS_RADIUS, TOUCH


def feature_matrix(cells: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, radius: float = NMS_RADIUS, touch: float = TOUCH) -> DataFrame:
    keep = ["organoid_id", *[c for c in META if c in cells.columns]]
    out = cells.select(*keep).distinct()
    lineages = cells.where(F.col("cell_type").isin(2.0, 3.0)).select("organoid_id", "cell_type", "cell_id", "x", "y", "z")
    clustered = stored(clusters.dbscan(lineages, eps, min_samples), "clustered")

    def wide(df, value, name):
        e, m = (F.max(F.when(F.col("cell_type") == t, F.col(value))) for t in (ENDO, 3.0))
        return df.groupBy("organoid_id").agg(e.alias(f"{name}_endo"), m.alias(f"{name}_meso"))

    m = clusters.metrics(clustered, min_samples)
    parts = [
        compare.composition(cells).drop("n_endo", "n_meso"), compare.radial(cells), mixing.nms(cells, radius, "mean_of_ratios"),
        wide(m, "n_clusters", "cluster_count"), wide(m, "avg_size", "cluster_size"), wide(clusters.intra_distance(clustered), "distance", "intra"),
        clusters.inter_distance(clustered).select("organoid_id", F.col("distance").alias("inter")), clusters.adjacency_pct(clustered, touch),
    ]
    for p in parts:
        out = out.join(p, "organoid_id", "left")
    return out.select(*keep, *FEATURES)
