"""Seeded draws that need no generator and no driver: a draw is the digest of what it is for."""
from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(*parts) -> Column:
    """32 hex digits that look random and are the same wherever they are computed: MD5 of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts)))


def digests(seed, turn: int, rows, known: dict) -> np.ndarray:
    """``draw(seed, turn, row)`` of whole numbers, as bytes that sort alike.  Samples number their cells alike, so up to 200,000 draws are kept in ``known``."""
    out = []
    for r in rows.tolist():
        d = known.get((turn, r))
        if d is None:
            d = md5(f"{seed}:{turn}:{r}".encode()).hexdigest()
            if len(known) < 200_000:
                known[turn, r] = d
        out.append(d)
    return np.array(out, "S32")


def ranked(rows: DataFrame, groups, by: Column, tie: str, name: str = "rank") -> DataFrame:
    """``rows`` with the place from 1 of each row among those of its group, in the order of ``by`` (a draw) and ``tie``.

    Ranks are made in 256 parts of a group, by the first digits, so a large group is not one task.
    """
    g = list(groups)
    rows = rows.withColumn("_draw", by).withColumn("_part", F.substring("_draw", 1, 2))
    before = F.sum("_n").over(W.partitionBy(*g).orderBy("_part")) - F.col("_n")
    parts = rows.groupBy(*g, "_part").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    inside = F.row_number().over(W.partitionBy(*g, "_part").orderBy("_draw", tie))
    return rows.withColumn("_inside", inside).join(parts, [*g, "_part"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_draw", "_part", "_inside", "_before")
