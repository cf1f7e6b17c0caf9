"""Tables between the rounds of an iteration, and components of many graphs at once."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of ``intermediates`` inside such a block; one of our own only where that is unset and all runs on one machine."""
    if _folder.get():
        return _folder.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cellgrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession):
    """Tables stored inside the block (by this thread) are deleted at its end; results are written before."""
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
        _delete(spark, path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back, so its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Named tables of one iteration: storing a name again deletes the table that had it, once the new one is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.at = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        before, path = self.at.get(name), f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.at[name] = path
        if before:
            _delete(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, keys, rounds: Rounds) -> DataFrame:
    """(keys, node, component) of the nodes of ``edges`` (keys, src, dst), graph by graph of ``keys``; the component is its least node.

    Each round every node takes its least neighbour as parent, pointers are doubled
    until they reach roots, and edges are contracted to roots.  No node with a smaller
    neighbour is a root, so at least half of the nodes go in a round, while the least
    node of a component always stays.  Nothing but whether rows are left reaches the driver.
    """
    k = list(keys)
    e = edges.where("src <> dst").select(*k, "src", "dst")
    e = rounds.store("edges", e.unionByName(e.select(*k, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    found = rounds.store("found", e.select(*k, F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    while not e.isEmpty():
        parent = rounds.store("parent", e.groupBy(*k, F.col("src").alias("v")).agg(F.min("dst").alias("p")).select(*k, "v", F.least("v", "p").alias("p")))
        moved = True
        while moved:
            up = parent.select(*k, F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = rounds.store("parent", parent.join(up, [*k, "p"]).select(*k, "v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.drop("moved")
        found = rounds.store("found", found.join(parent.withColumnsRenamed({"v": "component", "p": "root"}), [*k, "component"], "left").select(*k, "node", F.coalesce("root", "component").alias("component")))
        for side in ("src", "dst"):
            e = e.join(parent.withColumnsRenamed({"v": side, "p": "root"}), [*k, side]).drop(side).withColumnRenamed("root", side)
        e = rounds.store("edges", e.where("src <> dst").select(*k, "src", "dst").distinct())
    return found
