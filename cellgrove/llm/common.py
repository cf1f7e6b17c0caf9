"""Shared folder, numpy text hashing and connected components."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a task's Python memory.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cellgrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{_under[-1]}" if _under else found.rstrip("/")


_under: list[str] = []


@contextmanager
def intermediates(spark: SparkSession):
    """Tables stored inside the block go to one folder, which is deleted at its end; write results before."""
    _under.append(f"tables-{uuid.uuid4().hex}")
    path = shared_dir(spark)
    try:
        yield path
    finally:
        _under.pop()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Stored tables get no mark of success: on a local file system Hadoop sets a mark's rights by processes forked off the
#: driver, each with the driver's whole memory for a moment.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Spark's own settings while a table is written: shuffle files go as soon as the execution that made them is over,
#: and a worker gets so many rows at a time, which bounds its memory and the executor's where texts are long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**UNMARKED).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Ids that a broadcast may hold (about 100 MB); beyond it the join is shuffled.
BROADCAST_IDS = 4_000_000


def picked(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the rows of a stored table of ids, by its columns."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return df.join(side, ids.columns, how)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, rows) of runs of about ``most`` bytes; a longer text stands alone."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end - at
        at = end


def give_back() -> None:
    """Gives back the memory that earlier stages freed in a worker that Spark uses again."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def forget_others() -> None:
    """Gives back what the tokenizers of earlier stages remember in a worker that Spark uses again, and freed memory."""
    import sys

    for n in [n for n in list(sys.modules) if n.startswith("_") and n.endswith("_of_worker")]:
        del sys.modules[n]
    give_back()


def plain(column: pa.Array) -> pa.Array:
    """A string column with 32-bit offsets, nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sign_values(at: np.ndarray) -> np.ndarray:
    """A number for every (place in the word, byte), given as place * 256 + byte."""
    return mix((at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x6A09E667F3BCC909))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, hashed without a Python loop.

    A word's hash is the sum of one mixed number for each byte at its place in
    the word (tabulation, so no algebra of bytes makes two words meet), mixed
    with the length.  ``doc`` is the row in the slice that each word belongs to.
    Hashes only find candidates: callers confirm on the words.
    """

    #: Places of a word whose numbers are looked up; later ones are computed.
    PLACES = 64
    _table = None

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        n = len(data)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        begins = word & (~before | edge[:n])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        if Words._table is None:
            Words._table = _sign_values(np.arange(self.PLACES * 256))
        place = np.arange(n, dtype=np.int32)
        place -= np.maximum.accumulate(np.where(begins, place, 0))
        at = (place << 8) + data
        sums = np.zeros(n + 1, np.uint64)
        far = np.flatnonzero(place >= self.PLACES)
        value = Words._table.take(at, mode="clip")
        if len(far):
            value[far] = _sign_values((place[far].astype(np.int64) << 8) + data[far])
        np.cumsum(value, out=sums[1:])
        self.hash = mix(sums[self.end] - sums[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def runs(self, k: int, salt: int = 1) -> np.ndarray:
        """Hash of the ``k`` words from each word on; it is meaningful where ``fits(k)``."""
        n = max(len(self.hash) - k + 1, 0)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hash[j:j + n] * np.uint64(pow(0xA24BAED4963EE407 + 2 * salt, j + 1, 1 << 64) | 1)
        return mix(out + np.uint64(salt))

    def fits(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on stand in one text."""
        n = max(len(self.hash) - k + 1, 0)
        return self.doc[:n] == self.doc[k - 1:k - 1 + n]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component: the least node.

    Alternating large-star and small-star rounds on DataFrames, until every edge
    joins a node to the centre of its star.  Each round is written to the shared
    folder, so lost executors cost one round and nothing but counts reaches the
    driver.  Minima are pre-aggregated and hubs reach a join only, which adaptive
    execution can split.
    """
    def stars(e):
        """Whether every node but the centres has one edge, to a centre."""
        if e.groupBy("src").count().where("count > 1").limit(1).count():
            return False
        return not e.select(F.col("dst").alias("src")).distinct().join(e.select("src"), "src", "left_semi").limit(1).count()

    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = stored(e, "edges")
    for _ in range(most_rounds):
        if stars(e):
            break
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # an edge (src > dst): src learns the least neighbour of dst, dst is the hub
        large = e.select(F.col("src").alias("v"), F.col("dst").alias("src")).join(least, "src").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = stored(large.distinct(), "large")
        joined = large.join(large.groupBy("src").agg(F.min("dst").alias("m")), "src")
        ends = F.array(*(F.struct(F.col(c).alias("src"), F.col("m").alias("dst")) for c in ("dst", "src")))
        small = joined.select(F.inline(ends))
        e = stored(small.where("src <> dst").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("src").agg(F.min("dst").alias("component")).select(F.col("src").alias("node"), "component")
    return nodes.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
