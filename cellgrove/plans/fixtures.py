"""Stand-in point cloud over the supplied tables: one supplier's line items are one sample."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parameters of the queries, scaled to the stand-in's box of about 50 x 52 x 50.
EPS, MIN_SAMPLES, RADIUS, RADII, TOUCH = 6.0, 4, 10.0, (4.0, 6.0, 10.0), 6.0
MIXING, HALF, BAND, ENTROPY = 6.0, 5.0, 6.0, tuple(float(r) for r in range(2, 21, 2))


def cells(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.col("l_suppkey").cast("long")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
    return l.select(
        F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)).cast("long").alias("cell_id"), s.alias("organoid_id"),
        F.when(F.floor(s / 4) % 2 == 0, "exp1").otherwise("exp3").alias("experiment"),
        F.concat(F.lit("Rep"), (F.floor(s / 8) % 3 + 1).cast("string")).alias("replicate"),
        F.when(s % 4 == 0, 0).when(s % 4 == 1, 10).when(s % 4 == 2, 100).otherwise(1000).alias("dox"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2e3).alias("y"), (F.col("l_discount") * 5e2).alias("z"),
        F.when(F.col("l_returnflag") == "A", 2.0).when(F.col("l_returnflag") == "R", 3.0).otherwise(0.0).alias("cell_type"),
        (F.col("l_tax") * 1e2).alias("ch_546"), (F.col("l_discount") * F.col("l_extendedprice") / 1e3).alias("ch_647"))


def samples(spark, sf_dir):
    """One row per sample, with its number and condition."""
    c = cells(spark, sf_dir).select("organoid_id", "experiment", "replicate", "dox").distinct()
    condition = F.when(F.col("experiment") == "exp1", "BASAL").when(F.col("organoid_id") % 3 == 0, "BMP4").when(F.col("organoid_id") % 3 == 1, "WNT5A").otherwise("BASAL")
    return c.withColumn("number", F.col("organoid_id")).withColumn("condition", condition)


def files(spark, sf_dir):
    """A file name and a folder for each sample; doses are taken from the eight of the format."""
    n = F.col("organoid_id")
    dose = F.element_at(F.array(*map(F.lit, (0, 10, 25, 50, 100, 250, 500, 1000))), (n % 8 + 1).cast("int"))
    name = F.concat(dose.cast("string"), F.lit("dox_"), F.when(n % 3 == 0, "BMP4").otherwise("GATA"), F.lit("_"), n.cast("string"), F.lit(".csv"))
    return samples(spark, sf_dir).select("organoid_id", F.when(n % 2 == 0, "exp3_Bmp4_set").otherwise("exp1_set").alias("folder"), name.alias("file"))


def features(spark, sf_dir):
    """A small feature table with gaps: every seventh sample lacks f2."""
    f = cells(spark, sf_dir).groupBy("organoid_id", "experiment", "replicate", "dox").agg(
        F.count("*").alias("total_cells"), (F.count_if(F.col("cell_type") == 2) / F.count("*")).alias("pct_endo"), (F.count_if(F.col("cell_type") == 3) / F.count("*")).alias("pct_meso"),
        F.avg("x").alias("f1"), F.avg("y").alias("f2"), F.avg("ch_546").alias("f3"))
    return f.withColumn("f2", F.when(F.col("organoid_id") % 7 != 0, F.col("f2")))


def scores(spark, sf_dir):
    """Three columns that stand for component scores."""
    return cells(spark, sf_dir).groupBy("organoid_id", "experiment", "replicate", "dox").agg(
        (F.avg("x") - 25.5).alias("pc1"), (F.avg("y") - 26).alias("pc2"), (F.avg("z") - 25).alias("pc3"))


def predicted(spark, sf_dir):
    """Scores with stand-in predictions, by fold."""
    s = scores(spark, sf_dir).withColumn("fold", F.concat_ws("::", "experiment", "replicate")).withColumn("model", F.lit("stand_in"))
    pcs = ("pc1", "pc2", "pc3")
    return s.select("organoid_id", "experiment", "replicate", "dox", "fold", "model", *(F.col(c).alias(f"true_{c}") for c in pcs), *((F.col(c) * 0.9 + (F.col("organoid_id") % 5) * 0.01).alias(f"pred_{c}") for c in pcs))
