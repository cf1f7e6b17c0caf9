"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

Fingerprints are split into a ring of segments.  If two of them differ in at most
``budget`` bits, some segment starts a chain in which every prefix of ``l``
segments differs in at most ``l * budget / segments`` bits.  The first two
segments of such a chain make the key of an equi-join (the second one with every
pattern of flipped bits that the budget leaves it); the rest of the chain prunes
what meets there, and the Hamming distance of the whole confirms it.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.common import connected_components, picked, plain, slices, stored

SHINGLE, SEED, BITS = 4, 42, 64
BUDGET, SEGMENTS = 4, 5
#: Prints that share two segments beyond which they are not compared in pairs.
CROWD = 256
#: Shingles whose bits one numpy step unpacks (64 bytes each); bounds a task's memory on long texts.
STEP = 1 << 17


def _joined(texts: pa.Array):
    """(bytes, starts, ends, texts of the words): lower-cased words of a slice, one space after each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:n]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    size = end - start
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    low = data[word]
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    out[np.arange(len(low)) + np.repeat(np.arange(len(size)), size)] = low
    first = np.cumsum(size + 1) - size - 1
    return out.tobytes(), first, first + size, np.searchsorted(offsets, start, side="right") - 1


def fingerprints_of(texts: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text (32-bit offsets, no nulls), unsigned."""
    found = np.zeros(len(texts), np.uint64)
    for at, rows in slices(texts):
        data, first, last, doc = _joined(texts.slice(at, rows))
        words = np.bincount(doc, minlength=rows)
        base = np.cumsum(words) - words
        # a shingle starts at every word that has k - 1 behind it; a shorter text is one shingle
        count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        owner = np.repeat(np.arange(rows), count)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + base[owner]
        end = begin + np.minimum(words[owner], k) - 1
        ones = np.zeros((rows, BITS), np.int64)
        for i in range(0, len(owner), STEP):
            b, e, o = first[begin[i:i + STEP]].tolist(), last[end[i:i + STEP]].tolist(), owner[i:i + STEP]
            h = np.array([xxhash.xxh64_intdigest(data[x:y], seed) for x, y in zip(b, e)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            ones[o[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = (2 * ones > count[:, None]).astype(np.uint64)
        found[at:at + rows] = (over << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return found


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, print long) of every row; null, empty and wordless texts have the print zero."""
    def run(batches):
        for b in batches:
            value = fingerprints_of(plain(b.column("text")), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value)], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(column, low: int, width: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, most: int) -> list[int]:
    """Masks of ``most`` bits or fewer of ``width``."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _keys(parts, flips=None):
    """Array of (segment, its bits, bits of the next one) as longs; with ``flips`` the next one under each of these masks."""
    out = []
    for i, (low, width) in enumerate(parts):
        nlow, nwidth = parts[(i + 1) % len(parts)]
        a, b = _part(F.col("print"), low, width), _part(F.col("print"), nlow, nwidth)
        for m in (0,) if flips is None else flips(nwidth):
            out.append(F.lit(i << 52) + a * F.lit(1 << nwidth) + b.bitwiseXOR(F.lit(m)))
    return F.array(*out)


def links(prints: DataFrame, budget: int = BUDGET, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(src, dst), src > dst, that connect all distinct prints (column ``print``, each once) that differ in ``budget`` bits or fewer.

    A print meets what shares a segment with it and is near in the next one.  Where
    more than ``crowd`` prints share both segments, the prints that would meet them
    are not paired with one another: each is sent to all patterns within half the
    budget of it, and those that meet at a pattern, all linked by the triangle
    inequality, get a link to the least of them.  So work is linear in the prints,
    and two prints are connected if and only if a chain of near prints leads from
    one to the other; pairs of which one is not crowded are all returned.
    """
    if budget % 2 or segments <= max(budget, 2):
        raise ValueError("the budget is even, and a ring needs more segments than it has bits")
    parts = ring(segments)
    allowed = [budget * n // segments for n in range(1, segments + 1)]
    flips = lambda width: _flips(width, allowed[1])
    exact = prints.select(F.col("print").alias("dst"), F.explode(_keys(parts)).alias("key"))
    crowded = stored(exact.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    light, heavy = prints, None
    if not crowded.isEmpty():
        meets = prints.select("print", F.explode(_keys(parts, flips)).alias("key"))
        heavy = stored(picked(meets, crowded).select("print").distinct(), "heavy")
        light = prints.join(heavy.hint("merge"), "print", "left_anti")
    asked = light.select(F.col("print").alias("src"), F.explode(_keys(parts, flips)).alias("key"))
    apart = F.col("src").bitwiseXOR(F.col("dst"))
    differs = [F.bit_count(_part(apart, *p)) for p in parts]
    # the rest of the chain from the segment of the key, then the whole distance
    chain = F.lit(False)
    for i in range(segments):
        holds, total = F.shiftrightunsigned("key", 52) == i, F.lit(0)
        for n in range(segments):
            total = total + differs[(i + n) % segments]
            holds = holds & (total <= allowed[n])
        chain = chain | holds
    met = asked.hint("merge").join(exact, "key").where("src <> dst").where(chain & (F.bit_count(apart) <= budget))
    found = met.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    if heavy is not None:
        # a table of masks: as expressions they are code that the compiler gives up on, after it took hundreds of MB of the driver
        spark = prints.sparkSession
        masks = spark.createDataFrame([(m - (1 << BITS) if m >> (BITS - 1) else m,) for m in _flips(BITS, budget // 2)], "mask long")
        dealt = heavy.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "print")
        near = dealt.crossJoin(F.broadcast(masks)).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("at"))
        # no pattern has more prints than there are masks
        near = near.withColumn("dst", F.min("print").over(Window.partitionBy("at")))
        found = found.unionByName(near.where("print <> dst").select(F.col("print").alias("src"), "dst"))
    return found.distinct()


def classes(docs: DataFrame, k: int = SHINGLE, budget: int = BUDGET, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and wordless texts have the fingerprint zero and are linked like any
    other.  Rows without an id are linked but never name a component; a component
    of such rows only has the id NULL.  Rows that share an id keep their own
    fingerprints, and the id does not join their components.
    """
    rows = stored(fingerprints(docs, k), "prints")
    ids = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(ids.select("print"), budget, segments, crowd)).select(F.col("node").alias("print"), "component")
    named = stored(ids.join(found, "print", "left").withColumn("component", F.coalesce("component", "print")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select("print", "component_id"), "components")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return rows.hint("merge").join(named, "print").select("doc_id", shown, "component_id")
