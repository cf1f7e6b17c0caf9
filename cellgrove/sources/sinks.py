"""Tables and run records to files."""
from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame


def run_folder(base: str, prefix: str = "run", now: datetime | None = None) -> str:
    return f"{base.rstrip('/')}/{prefix}_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def write_table(df: DataFrame, path: str, kind: str = "parquet", single: bool = False) -> str:
    """``single`` makes one file, for exports of small tables only."""
    w = (df.coalesce(1) if single else df).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)
    return path


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_new(tables: dict[str, DataFrame], folder: str, only=None, kind: str = "csv", append_only: bool = False) -> list[str]:
    """The chosen tables below a folder; with ``append_only`` only those that are not there yet, and nothing is overwritten."""
    out = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if (only is None or name in only) and not (append_only and exists(df.sparkSession, path)):
            out.append(write_table(df, path, kind, True))
    return out


def write_manifest(folder: str, facts: dict) -> str:
    """A run's parameters and counts, as JSON and as a readable list, on the driver's file system."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/run_manifest.json", "w", encoding="utf-8") as f:
        json.dump(facts, f, indent=2, sort_keys=True, default=str)
    with open(f"{folder}/summary.md", "w", encoding="utf-8") as f:
        f.write("# Run\n\n" + "".join(f"- {k}: {v}\n" for k, v in sorted(facts.items())))
    return f"{folder}/run_manifest.json"
