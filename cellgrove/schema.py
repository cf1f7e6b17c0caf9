"""Column names, cell types and default parameters of the point-pattern engine."""
from __future__ import annotations

from pyspark.sql import types as T

NEGATIVE, SINGLE, ENDO, MESO = 0.0, 1.0, 2.0, 3.0
LINEAGES = {"Endo": ENDO, "Meso": MESO}

EPS, MIN_SAMPLES = 30.0, 20
NMS_RADIUS, TOUCH, BAND = 100.0, 30.0, 30.0
NMS_RADII = (30.0, 50.0, 100.0)
MIXING_RADIUS, HALF_SLAB = 50.0, 20.0
DOSES = (0, 10, 25, 50, 100, 250, 500, 1000)

#: One row per cell; ``cell_id`` is the row's place in its sample.
CELLS = T.StructType([
    T.StructField("cell_id", T.LongType()),
    T.StructField("organoid_id", T.StringType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("replicate", T.StringType()),
    T.StructField("dox", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("cell_type", T.DoubleType()),
])

META = ["experiment", "replicate", "dox"]
FEATURES = [
    "total_cells", "pct_endo", "pct_meso", "radial_mean_endo", "radial_std_endo", "radial_mean_meso", "radial_std_meso",
    "nms_endo", "nms_meso", "cluster_count_endo", "cluster_count_meso", "cluster_size_endo", "cluster_size_meso",
    "intra_endo", "intra_meso", "inter", "adjacency_pct",
]
