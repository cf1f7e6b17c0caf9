"""Approximate nearest neighbours: a hash-prefix forest.

1. Vectors are lifted by one coordinate so that the largest inner product is the
   smallest angle.  In each of ``TREES`` trees a vector's hash string has
   ``DEPTH`` letters; a letter is the one of ``AXES`` random orthogonal axes, with
   its sign, that lies nearest.  Near vectors share long prefixes.
2. A tree is its sorted strings, cut into blocks: ranges of strings under one first
   letter, of about ``BLOCK`` rows; more rows with one string are dealt to several
   blocks.  Every row is in one block of every tree, so what is shuffled grows with
   the rows, and a query visits only the blocks under its prefixes.
3. Down: a query's whole string in each tree.  Up: the prefix is shortened in all
   trees at once, then further first letters are taken, nearest axes first, until
   the rows under it in all trees are ``need`` together (a row may count in several).
   Beyond the last step a query visits all blocks of one tree.
4. ``need`` is fitted: for up to ``SAMPLE`` queries the true neighbours are found
   among all rows, and the least ``need`` is taken that finds ``AIM`` of them.  So
   vectors with structure are searched narrowly, and those without it widely.
5. Rows under a query's prefixes are scored exactly, in double precision, on the
   original vectors, and the best of all blocks are merged.  Equal vectors travel
   once, with their ``k + 1`` least ids, which is all that a result can hold.

Every row is indexed; recall against brute force is measured in the tests.

Defined cases: vectors that are null, empty, zero, of another length than most,
or hold null or non-finite numbers take no part; ties go to the smaller id; of
repeated ids each row counts; fewer candidates than ``k`` are all returned; ids
are whole numbers; other columns are ignored; an empty table gives an empty
result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgrove.llm.common import stored

TREES, DEPTH, AXES = 16, 3, 64
#: Bits of a letter, and the first letters that a query may take in a tree.
LETTER, PROBES = 7, 6
BLOCK = 8192
#: Queries that ``need`` is fitted on, and the share of their neighbours that it must find.
SAMPLE, AIM = 128, 0.95
#: Steps upwards: the depths but one, the numbers of first letters, everything.
STEPS = DEPTH - 1 + PROBES + 1


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (most["d"] if most else 0))


def axes(dim: int) -> np.ndarray:
    """(dim, TREES * DEPTH * AXES): random axes, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(11)
    parts = []
    for _ in range(TREES * DEPTH):
        own = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-AXES // dim))]
        parts.append(np.concatenate(own, axis=1)[:, :AXES])
    return np.concatenate(parts, axis=1)


def coded(reps: DataFrame, dim: int, longest: float) -> DataFrame:
    """(id, v, data, query): strings of a row as data (one of each tree) and as query (with ``PROBES`` first letters of each tree)."""
    def letters(y):
        at = np.abs(y).argmax(axis=-1)
        return at * 2 + (np.take_along_axis(y, at[..., None], -1)[..., 0] > 0)

    def run(batches):
        planes = axes(dim + 1)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                x = np.asarray(part.column(1).flatten()).reshape(-1, dim)
                rest = np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(axis=1), 0.0))[:, None]
                flat = x @ planes[:dim]
                y = (flat + rest * planes[dim]).reshape(-1, TREES, DEPTH, AXES)
                data = (letters(y).astype(np.int64) << (LETTER * np.arange(DEPTH - 1, -1, -1))).sum(axis=-1)
                y = flat.reshape(-1, TREES, DEPTH, AXES)
                tail = (letters(y).astype(np.int64) << (LETTER * np.arange(DEPTH - 1, -1, -1)))[:, :, 1:].sum(axis=-1)
                first = y[:, :, 0]
                near = np.argsort(-np.abs(first), axis=-1, kind="stable")[..., :PROBES]
                sign = np.take_along_axis(first, near, -1) > 0
                query = ((near * 2 + sign).astype(np.int64) << (LETTER * (DEPTH - 1))) + tail[..., None]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(c.size // max(len(x), 1))), pa.array(c.ravel())) for c in (data, query)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["id", "v", "data", "query"])

    return reps.mapInArrow(run, "id long, v array<double>, data array<long>, query array<long>")


def prefixes(asked: DataFrame) -> DataFrame:
    """(q, step, tree, lo, hi): the ranges of strings that each step up adds or replaces, for each query and tree.

    Steps below ``DEPTH - 1`` are longer prefixes of the query's own string; step ``DEPTH - 1 + p``
    adds the p-th first letter; the last step, everything, has no rows here.
    """
    spans = []
    for step in range(STEPS - 1):
        probe, free = max(step - (DEPTH - 1), 0), LETTER * min(step, DEPTH - 1)
        for tree in range(TREES):
            code = F.get(F.col("query"), F.lit(tree * PROBES + probe))
            lo = F.shiftleft(F.shiftright(code, free), free)
            spans.append(F.struct(F.lit(step).alias("step"), F.lit(tree).alias("tree"), lo.alias("lo"), (lo + ((1 << free) - 1)).alias("hi")))
    return asked.select("q", F.inline(F.array(*spans)))


def counted(leaves: DataFrame, ranges: DataFrame) -> DataFrame:
    """(q, step, n): rows under a query's ranges at each step, over all trees."""
    free = F.when(F.col("step") < DEPTH - 1, F.col("step") * LETTER).otherwise((DEPTH - 1) * LETTER)
    cells = None
    for d in range(DEPTH):
        lo = F.shiftleft(F.shiftright("code", d * LETTER), d * LETTER)
        one = leaves.groupBy("tree", lo.alias("lo"), F.lit(d * LETTER).alias("free")).agg(F.sum("n").alias("n"))
        cells = one if cells is None else cells.unionByName(one)
    found = ranges.withColumn("free", free).join(cells, ["tree", "lo", "free"]).groupBy("q", "step").agg(F.sum("n").alias("n"))
    # from the first letters on, steps add to those before
    grown = F.sum(F.when(F.col("step") >= DEPTH - 1, F.col("n")).otherwise(0)).over(W.partitionBy("q").orderBy("step"))
    return found.select("q", "step", F.when(F.col("step") < DEPTH - 1, F.col("n")).otherwise(grown).alias("n"))


def true_neighbours(index: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, id): the ``k`` nearest rows of each of a bounded list of queries, from all rows."""
    names = np.array([r["q"] for r in sample], np.int64)
    wanted = np.array([r["v"] for r in sample], np.float64)

    def run(batches):
        for b in batches:
            x, ids = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), np.asarray(b.column(0))
            for start in range(0, len(ids), 4096):
                s, own = wanted @ x[start:start + 4096].T, ids[start:start + 4096]
                s[names[:, None] == own[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], ["q", "id", "score"])

    rows = index.select("id", "v").mapInArrow(run, "q long, id long, score double").where("q <> id")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return rows.withColumn("r", rank).where(F.col("r") <= k).select("q", "id")


def fitted_need(index: DataFrame, asked: DataFrame, counts: DataFrame, k: int, n: int) -> int:
    """The least number of rows in reach at which the sampled queries find ``AIM`` of their neighbours."""
    sample = asked.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect()
    if not sample:
        return 0
    spark = index.sparkSession
    names = spark.createDataFrame([(r["q"],) for r in sample], "q long")
    reach: dict = {}
    for r in counts.join(F.broadcast(names), "q").collect():  # at most SAMPLE x STEPS rows
        reach.setdefault(r["q"], {})[r["step"]] = r["n"]
    truth = true_neighbours(index, sample, k).join(index.select("id", "data"), "id").collect()  # at most SAMPLE x k rows
    own = {r["q"]: np.array(r["query"], np.int64).reshape(TREES, PROBES) for r in sample}
    found = []  # (query, first step that reaches the neighbour)
    for r in truth:
        data, query = np.array(r["data"], np.int64), own[r["q"]]
        step = STEPS - 1
        for s in range(STEPS - 2, -1, -1):
            free = LETTER * min(s, DEPTH - 1)
            hit = (data >> free == query[:, max(s - (DEPTH - 1), 0)] >> free).any()
            step = s if hit else step
        found.append((r["q"], step))
    need = k + 1
    while need < 2 * TREES * n:
        # a query stops at the first step in whose reach are so many rows
        stop = {q: min((s for s in range(STEPS - 1) if reach.get(q, {}).get(s, 0) >= need), default=STEPS - 1) for q in own}
        if sum(s <= stop[q] for q, s in found) >= AIM * len(found):
            return need
        need *= 2
    return need


def blocks_of(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, first, code, block) of every string, and (tree, first, block, lo, hi, parts) of every block."""
    first = F.shiftright("code", LETTER * (DEPTH - 1)).alias("first")
    before = W.partitionBy("tree", "first").orderBy("code").rowsBetween(W.unboundedPreceding, -1)  # strings under one letter: 2 ** (LETTER * (DEPTH - 1)) at most
    leaves = leaves.select("tree", first, "code", "n")
    placed = stored(leaves.withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK).cast("int")), "strings")
    blocks = placed.groupBy("tree", "first", "block").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.ceil(F.sum("n") / (2 * BLOCK)).cast("int").alias("parts"))
    return placed, stored(blocks, "blocks")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` (a condition on ``id``) picks."""
    rows = usable(df, id_col, vec_col)
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    members = stored(rows.withColumn("place", place).where(F.col("place") <= k + 1), "members")
    reps = members.where("place = 1").select("id", "v")
    facts = reps.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    n, dim = facts["n"], facts["d"] or 0
    # a query's class: rows of equal vectors share their neighbours
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("v"))
    index = stored(coded(reps, dim, math.sqrt(facts["m"] or 0.0)), "forest")
    asked = stored(queries.select("v").distinct().join(index.select("v", "id", "query"), "v").select(F.col("id").alias("q"), "v", "query"), "asked")
    entries = index.select("id", F.posexplode("data").alias("tree", "code"))
    leaves = stored(entries.groupBy("tree", "code").agg(F.count("*").alias("n")), "leaves")
    ranges = stored(prefixes(asked), "ranges")
    counts = stored(counted(leaves, ranges), "counts")
    need = fitted_need(index, asked, counts, k, n)
    strings, blocks = blocks_of(leaves)
    stops = asked.select("q").join(counts.where(F.col("n") >= need).groupBy("q").agg(F.min("step").alias("stop")), "q", "left")
    stops = stored(stops.select("q", F.coalesce("stop", F.lit(STEPS - 1)).alias("stop")), "stops")
    # a longer prefix stands alone, first letters add up; the last step takes all of tree 0
    used = ranges.join(stops, "q").where(F.when(F.col("stop") < DEPTH - 1, F.col("step") == F.col("stop")).otherwise((F.col("step") >= DEPTH - 1) & (F.col("step") <= F.col("stop")) & (F.col("stop") < STEPS - 1)))
    used = used.select("q", "tree", F.shiftright("lo", LETTER * (DEPTH - 1)).alias("first"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    letters = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << LETTER) - 1).cast("long"))).alias("first")
    free = LETTER * (DEPTH - 1)
    wide = stops.where(F.col("stop") == STEPS - 1).select("q", F.lit(0).alias("tree"), letters)
    wide = wide.select("q", "tree", "first", F.shiftleft("first", free).alias("from"), (F.shiftleft("first", free) + ((1 << free) - 1)).alias("to"))
    visits = used.unionByName(wide).join(blocks, ["tree", "first"]).where("lo <= to AND hi >= from")
    visits = visits.select("q", "tree", "first", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "from", "to")
    ask = visits.join(asked.select("q", "v"), "q").select("tree", "first", "block", "part", "q", "from", "to", "v")
    held = entries.join(strings.select("tree", "first", "code", "block"), ["tree", "code"]).join(blocks.select("tree", "first", "block", "parts"), ["tree", "first", "block"])
    held = held.select("id", "tree", "first", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "code").join(index.select("id", "v"), "id")

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        out: list = [[], [], []]
        if rows.num_rows and asks.num_rows:
            rows = rows.sort_by([("code", "ascending"), ("id", "ascending")])
            x, names, code = matrix(rows), rows["id"].to_numpy(), rows["code"].to_numpy()
            low, high = np.searchsorted(code, asks["from"].to_numpy()), np.searchsorted(code, asks["to"].to_numpy(), side="right")
            for q, v, a, b in zip(asks["q"].to_pylist(), matrix(asks), low.tolist(), high.tolist()):
                s = x[a:b] @ v
                near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k + 1 else np.arange(len(s))
                near = near[np.lexsort((names[a:b][near], -s[near]))][:k + 1]
                out[0].append(np.full(len(near), q, np.int64))
                out[1].append(names[a:b][near])
                out[2].append(s[near])
        join = lambda i, t: pa.array(np.concatenate(out[i]) if out[i] else np.zeros(0), t)
        return pa.table({"q": join(0, pa.int64()), "id": join(1, pa.int64()), "score": join(2, pa.float64())})

    block = ("tree", "first", "block", "part")
    found = held.groupBy(*block).cogroup(ask.groupBy(*block)).applyInArrow(search, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    rank = lambda by, least: F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), least))
    found = stored(found.withColumn("r", rank("q", "id")).where(F.col("r") <= k + 1).select("q", "id", "score"), "found")
    # back to rows: the queries of a class, and the members of each class found
    same = queries.join(asked.select("q", "v"), "v").select("query_id", "q")
    firsts = members.where("place = 1").select("v", F.col("id").alias("rep"))
    copies = members.join(firsts, "v").select(F.col("id").alias("vec_id"), F.col("rep").alias("id"))
    full = same.join(found, "q").join(copies, "id").where("vec_id <> query_id")
    full = full.withColumn("rank", rank("query_id", "vec_id")).where(F.col("rank") <= k)
    return full.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
