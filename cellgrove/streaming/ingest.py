"""New sample files into the cells table as they arrive; a sample is complete in its file."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellgrove.sources.csv_cells import path_keys


def land_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, experiment: str, schema: str = "X double, Y double, Z double, cell_type_dapi_adjusted double"):
    """A started query that appends new files (all of one header) to Parquet and ends when it has caught up."""
    raw = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)
    cells = raw.select("*", F.col("_metadata.file_path").alias("path")).withColumns(path_keys(F.col("path")))
    cells = cells.withColumn("experiment", F.lit(experiment)).withColumn("organoid_id", F.concat_ws("/", "experiment", "replicate", "file"))
    cells = cells.withColumnsRenamed({"X": "x", "Y": "y", "Z": "z", "cell_type_dapi_adjusted": "cell_type"}).drop("path")
    return cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
