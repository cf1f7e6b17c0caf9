"""Near-duplicate classes by b-bit MinHash.

1. One Arrow pass makes each document's word shingles, their minima under
   ``PERMUTATIONS`` permutations, a hash of every band of ``ROWS`` minima, and a
   signature that keeps ``BITS`` bits of every mixed minimum, packed in longs.
2. Documents of equal word sequences (SHA-256) form one class, grouped, never
   paired; the least doc_id stands for it.
3. Bands give candidates.  Each member of a band bucket meets the bucket's hub
   only; Jaccard similarity is estimated from equal packed slots by bit counts,
   corrected for chance collisions, and clear misses go.  Pairs of sizes that
   cannot reach the limit go too; pairs of sets of up to ``SMALL`` shingles are
   judged on all their hashes instead.  The rest are confirmed on the shingles' words, not on hashes, and components
   are formed.
4. A bucket that still holds several components has the pairs across them
   estimated, in blocks of ``BLOCK`` members so that no task holds a bucket, and
   confirmed likewise, so no link between classes is lost.  Members of one
   component are not paired again.  In buckets of over ``CROWD`` members a pair's
   intersection is also bounded by the bits in which bitmaps of the two sets
   differ, which rules out most pairs of far-edited copies and no true link.

At similarity 0.75 one pair in 3,700,000 shares no band, and about one in a
million has an estimate lower by ``SLACK``; both fall fast above 0.75.

Defined cases: null or empty texts, or texts without words, have an empty set
and are linked with nothing; fewer words than a shingle: the whole sequence is
one shingle; rows with a null id are kept, alone; rows that share a doc_id count
as one node with the links of either; other columns are ignored; an empty table
gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import Words, connected_components, mix, picked, plain, signed, slices, stored

PERMUTATIONS, BITS = 512, 2
#: Bands are made of the first BANDS * ROWS minima; the estimate uses all.
BANDS, ROWS = 40, 4
LONGS = PERMUTATIONS * BITS // 64
#: How far below the limit an estimate may lie before a candidate is given up: 4.7 standard deviations.
SLACK = 0.11
#: Sets of so many shingles at most travel whole (as hashes); their pairs need no estimate.
SMALL = 48
SHINGLE, PERCENT = 5, 75
#: What a representative shows of its set when pairs are judged.
CARRIED = ("n", "sig", "small")
#: Words of a text beyond which shingles are compared as ranks, not as tuples.
LONG = 200_000
#: Members of a bucket that are compared at a time; members beyond which a bucket's pairs are bounded first.
BLOCK, CROWD = 2000, 64
#: Longs of a bitmap.
WORDS = 32


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode().lower().split()


def exact_set(words: list[bytes], k: int) -> set:
    """The distinct shingles of a word sequence, as word tuples."""
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def exact_ranks(a: list[bytes], b: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for two sequences of ``k`` words or more, as numbers that are equal where shingles are: little memory for very long texts."""
    ids: dict[bytes, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for w in a + b], np.int64)
    rank = word
    for j in range(1, k):
        rank = np.unique(rank[:-1] * len(ids) + word[j:], return_inverse=True)[1]
    return np.unique(rank[:len(a) - k + 1]), np.unique(rank[len(a):])


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text of a slice, sorted."""
    w = Words(texts, lower=True)
    s, out = w.runs(k), []
    for d in range(len(texts)):
        a, n = int(w.first[d]), int(w.count[d])
        if n >= k:
            out.append(np.unique(s[a:a + n - k + 1]))
        elif n:
            h = np.uint64(n)
            for x in w.hash[a:a + n]:
                h = mix(np.array([h * np.uint64(31) + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def multipliers() -> np.ndarray:
    """Odd numbers; multiplying by one permutes the 32-bit numbers."""
    return (np.random.default_rng(20240229).integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def minima(values: np.ndarray, by: np.ndarray, block: int = 256) -> np.ndarray:
    """Least value of the set under each permutation."""
    least, room = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.empty((PERMUTATIONS, block), np.uint32)
    v = (values >> np.uint64(32)).astype(np.uint32)[None, :]
    for i in range(0, v.shape[1], block):
        part = v[:, i:i + block]
        x = np.multiply(part, by, out=room[:, :part.shape[1]])
        np.minimum(least, x.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """``BITS`` bits of every minimum, mixed with a salt of its permutation: products keep low bits, so unmixed ones collide alike in all."""
    salt = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))
    shift = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    out = np.zeros((len(least), LONGS), np.uint64)
    for i in range(0, len(least), 256):
        bits = mix(least[i:i + 256].astype(np.uint64) + salt) & np.uint64((1 << BITS) - 1)
        out[i:i + 256] = (bits.reshape(-1, LONGS, 64 // BITS) << shift).sum(axis=2)
    return out


def signatures(df: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, text_a, text_b, bands, sig, small): one row per row of ``df``.

    text_a and text_b are of the word sequence's SHA-256; small has the shingle hashes of a set that is not large.
    """
    def run(batches):
        with np.errstate(over="ignore"):
            salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            weight = mix(np.arange(101, 101 + ROWS, dtype=np.uint64))
            by = multipliers()
            for b in batches:
                texts, ids = plain(b.column(1)), b.column(0)
                for at, m in slices(texts):
                    sets = shingle_sets(texts.slice(at, m), k)
                    n = np.array([len(s) for s in sets], np.int64)
                    sums = np.array([np.frombuffer(hashlib.sha256(b" ".join(words_of(x))).digest()[:16], "<i8") for x in texts.slice(at, m).to_pylist()], np.int64).reshape(len(sets), 2)
                    least = np.array([minima(s, by) for s in sets], np.uint32).reshape(len(sets), PERMUTATIONS).astype(np.uint64)
                    bands = mix((least[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS) * weight).sum(axis=2) + salt)
                    sig = packed(least)
                    rows = np.arange(len(sets) + 1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(at, m).cast(pa.int64()), pa.array(n), pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1])),
                        pa.ListArray.from_arrays(pa.array(rows * np.int32(BANDS)), pa.array(signed(bands).ravel())),
                        pa.ListArray.from_arrays(pa.array(rows * np.int32(LONGS)), pa.array(signed(sig).ravel())),
                        pa.array([signed(x) if len(x) <= SMALL else None for x in sets], pa.list_(pa.int64())),
                    ], ["doc_id", "n_shingles", "text_a", "text_b", "bands", "sig", "small"])

    return df.select(id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, text_a long, text_b long, bands array<long>, sig array<long>, small array<long>")


def estimate(a: str, b: str):
    """Jaccard similarity from two packed signatures, corrected for chance collisions of low bits."""
    low = sum(1 << (BITS * i) for i in range(64 // BITS))
    low = low - (1 << 64) if low >= 1 << 63 else low
    def folded(i):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x
        for j in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, j))
        return F.bit_count(any_bit.bitwiseAND(F.lit(low)))
    differ = sum((folded(i) for i in range(1, LONGS)), folded(0))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / float(PERMUTATIONS) - chance) / (1.0 - chance)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the limit; the texts are fetched for these only."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = stored(picked(docs, stored(ids, "wanted")).distinct(), "texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches):
        last, words, own = None, [], set()
        for batch in batches:
            keep = []
            for hub, text in zip(batch.column(2), batch.column(3)):
                hub, other = hub.as_py(), words_of(text.as_py())
                if hub != last:  # rows of one hub follow each other
                    last, words = hub, words_of(hub)
                    own = exact_set(words, k) if len(words) <= LONG else None
                if own is not None and len(other) <= LONG:
                    found = exact_set(other, k)
                    sizes, both = len(own) + len(found), len(own & found)
                else:
                    found = exact_ranks(words, other, k) if min(len(words), len(other)) >= k else (np.zeros(0), np.zeros(0))
                    sizes, both = len(found[0]) + len(found[1]), len(np.intersect1d(*found, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (sizes - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(check, "a long, b long").distinct()


def may_be_near(percent: int):
    """Whether the sets of a pair, in columns that end in _a and _b, may reach the limit."""
    few, many = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    shared = F.size(F.array_intersect("small_a", "small_b"))
    whole = F.col("small_a").isNotNull() & F.col("small_b").isNotNull()
    by_set = 100 * shared >= percent * (few + many - shared)
    return (100 * few >= percent * many) & F.when(whole, by_set).otherwise(estimate("sig_a", "sig_b") >= percent / 100 - SLACK)


def bucketed(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, id) of every member of a bucket of two or more, and (band, hub) of each bucket.

    The hub is the member whose buckets are the fullest: in a group of edited copies that is the text they were made from.
    """
    members = reps.select("id", F.explode("bands").alias("band"))
    sizes = stored(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = stored(members.join(sizes, "band"), "members")
    weights = stored(members.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    hubs = members.join(weights, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("best"))
    return members.select("band", "id"), stored(hubs.select("band", (-F.col("best.id")).alias("hub")), "buckets")


def bitmaps(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, bits): a bitmap of each text's shingle hashes; not for ids that stand at several texts."""
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                texts, own = plain(b.column(1)), b.column(0)
                for at, m in slices(texts):
                    bits = np.zeros((m, 64 * WORDS), np.uint8)
                    for row, found in zip(bits, shingle_sets(texts.slice(at, m), k)):
                        row[(found % np.uint64(64 * WORDS)).astype(np.int64)] = 1
                    flat = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([own.slice(at, m), pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * np.int32(WORDS)), pa.array(flat))], ["id", "bits"])

    texts = picked(docs, ids.select(F.col("id").alias("doc_id"))).distinct()
    rows = texts.select("doc_id", "text").mapInArrow(run, "id long, bits array<long>")
    return stored(rows.groupBy("id").agg(F.count("*").alias("texts"), F.first("bits").alias("bits")).where("texts = 1").select("id", "bits"), "bitmaps")


def across_components(members: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, but of several components, that may be near.

    In a crowded bucket pairs are bounded first: every bit in which two bitmaps differ stands for a shingle that only one of them has.
    """
    placed = members.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")).select("band", "id", "component")
    placed = stored(placed, "placed")
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    split = stored(split.select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), (F.col("size") > CROWD).alias("crowded")), "split")
    open_ = stored(placed.join(split, "band"), "open-members")
    maps = bitmaps(docs, stored(open_.where("crowded").select("id").distinct(), "crowded"), k)
    open_ = open_.join(reps.select("id", *CARRIED, "bands"), "id").join(maps, "id", "left").withColumn("bits", F.when(F.col("crowded"), F.col("bits")))
    open_ = stored(open_.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "open")
    # block pairs (i, j), i <= j: a block meets itself and every other once
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    shown = ("id", "component", "bits", *CARRIED, "bands")
    left = open_.select("band", F.col("own").alias("i"), every(F.col("own"), F.col("blocks") - 1).alias("j"), *(F.col(c).alias(f"{c}_a") for c in shown))
    right = open_.select(F.col("band").alias("of"), every(F.lit(0), F.col("own")).alias("i2"), F.col("own").alias("j2"), *(F.col(c).alias(f"{c}_b") for c in shown))
    # inside a block a pair is met in both orders, across blocks in one; one that shares several bands counts in the least of them
    once = F.when(F.col("i") == F.col("j"), F.col("component_a") < F.col("component_b")).otherwise(F.col("component_a") != F.col("component_b"))
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(1, WORDS)), F.bit_count(F.col("bits_a")[0].bitwiseXOR(F.col("bits_b")[0])))
    both = F.col("n_a") + F.col("n_b")
    bound = F.col("bits_a").isNull() | F.col("bits_b").isNull() | (100 * (both - apart) >= percent * (both + apart))
    first = F.col("band") == F.array_min(F.array_intersect("bands_a", "bands_b"))
    met = left.join(right, (F.col("band") == F.col("of")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & once & may_be_near(percent) & bound & first)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def classes(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), one row per row of ``df``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sigs = stored(signatures(docs, k), "signatures")
    real = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = stored(real.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = real.select("doc_id", "n_shingles", "text_a", "text_b", *CARRIED[1:], "bands").join(
        same.withColumnRenamed("class_id", "doc_id"), ["doc_id", "text_a", "text_b"], "left_semi").dropDuplicates(["doc_id", "text_a", "text_b"])
    reps = stored(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", *CARRIED[1:]), "representatives")
    members, buckets = bucketed(reps)
    near = may_be_near(percent)
    stars = members.join(buckets, "band").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda of: reps.select(F.col("id").alias(of), *(F.col(c).alias(f"{c}_{of}") for c in CARRIED))
    stars = stars.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b")
    links = stored(confirmed(stored(stars, "stars"), docs, k, percent), "links")
    found = stored(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")
    across = stored(across_components(members, found, reps, docs, k, percent), "across")
    if across.limit(1).count():
        more = stored(confirmed(across, docs, k, percent), "links")
        found = stored(connected_components(links.unionByName(more).select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")
    of_set = same.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    of_set = stored(of_set.select("text_a", "text_b", "class_id", F.coalesce("component", "class_id").alias("component_id")), "membership")
    shown = sigs.select("doc_id", "n_shingles", "text_a", "text_b")
    placed = shown.where("n_shingles > 0 AND doc_id IS NOT NULL").join(of_set, ["text_a", "text_b"])
    alone = shown.where("n_shingles = 0 OR doc_id IS NULL").select("*", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n_shingles", "class_id", "component_id").unionByName(alone.select("doc_id", "n_shingles", "class_id", "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` (doc_id, text, ...) that stay: one of each group, the least doc_id."""
    gone = classes(df, k, percent).where("NOT kept").select("doc_id").distinct()
    return picked(df, stored(gone, "gone"), "left_anti")


#: The same rows in DuckDB, by comparing every pair of documents that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d WHERE len(words) >= 5),
s AS (SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle, lead(word, 4) OVER o AS last
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE last IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(least.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""
