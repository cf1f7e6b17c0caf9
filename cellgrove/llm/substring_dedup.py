"""Substring dedup by De Bruijn compaction.

Nodes are runs of ``WIDTH - 1`` words, edges the windows of ``WIDTH`` consecutive
words.  A window belongs to the least doc_id in which it starts; every later
document loses the words that such a window covers.

1. Exact copies collapse first: of equal texts only the least doc_id enters the
   graph, the others lose every window.
2. Which edges can repeat: windows are cut into runs by their minimizer, the
   ``KMER``-word string of least hash that a window holds.  Equal windows have
   equal minimizers, so a minimizer in one document only cannot lie in a repeat;
   those runs stop here.  Minimizers are counted with map-side minima, so a
   frequent one is no hot key.  Equal runs, wherever they stand, become one row.
3. The graph: edges that start in several documents, each with its source, the
   least (document, place) where it starts.  Nodes get their in- and out-degrees
   by grouping.  An edge continues the one before it if a join at their node
   finds both degrees one and neighbouring sources; such chains compact to paths,
   each an interval of one source document.
4. Runs meet the paths they walk through, as (place in the run, source document,
   source place, length).
5. Verification: the words at the source coordinates and those of the later
   document are compared by BLAKE2b digests of either.  Hashes only propose;
   where a digest differs, the windows concerned are grouped anew by their words.
6. Verified spans close up and are cut from the text.

Defined cases: null or empty texts have no words; rows with a null id lose
nothing; of rows that share an id none counts as earlier than another, and each
loses its own repeats; other columns are ignored; an empty table gives an empty
result; texts of any length are read whole.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgrove.llm.common import Words, picked, plain, signed, slices, stored

WIDTH, KMER = 13, 5
KEY = ["doc_id", "tid"]
#: Rows that a task unpacks at a time.
ROWS = 256
RANGES = "array<struct<start:bigint,stop:bigint>>"


def minimizers(w: Words, width: int, k: int):
    """Of each window start: (ok, position of its least k-mer, hash of that)."""
    kmer = w.runs(k, salt=3)
    n = max(len(w.hash) - width + 1, 0)
    span = width - k + 1
    views = np.lib.stride_tricks.sliding_window_view(kmer, span)[:n] if n else np.zeros((0, span), np.uint64)
    at = views.argmin(axis=1) + np.arange(n)
    return w.fits(width), at, kmer[at] if n else np.zeros(0, np.uint64)


def runs_of(w: Words, width: int, k: int):
    """Runs of windows of one text with one minimizer occurrence: (first window, number of windows, minimizer)."""
    ok, at, key = minimizers(w, width, k)
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    # a run ends before the next start or the next window that does not fit
    stop = np.flatnonzero(new | ~ok)
    after = np.searchsorted(stop, first, side="right")
    end = np.append(stop, len(ok))[after]
    return first, end - first, key[first]


def edge_hashes(w: Words, width: int) -> np.ndarray:
    return w.runs(width, salt=7)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the BLAKE2b digest of words joined by blanks."""
    found = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def text_facts(docs: DataFrame, hashed: bool) -> DataFrame:
    """(doc_id, tid, n_words, text_a, text_b, whole) of each row; whole: the words joined by blanks, or its SHA-256."""
    def run(batches):
        for b in batches:
            texts = plain(b.column(2))
            for at, m in slices(texts):
                words = [words_of(x) for x in texts.slice(at, m).to_pylist()]
                joined = [b" ".join(x) for x in words]
                sums = [hashlib.sha256(x) for x in joined]
                ab = np.array([np.frombuffer(s.digest()[:16], "<i8") for s in sums], np.int64).reshape(m, 2)
                whole = [s.hexdigest() for s in sums] if hashed else [x.decode() for x in joined]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, m), b.column(1).slice(at, m), pa.array([len(x) for x in words], pa.int64()),
                    pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1])), pa.array(whole, pa.string()),
                ], [*KEY, "n_words", "text_a", "text_b", "whole"])

    return docs.select(*KEY, "text").mapInArrow(run, "doc_id long, tid long, n_words long, text_a long, text_b long, whole string")


def minimizer_rows(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(key, doc_id): the distinct minimizers of each text."""
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                texts, ids = plain(b.column(1)), np.asarray(b.column(0))
                for at, m in slices(texts):
                    w = Words(texts.slice(at, m))
                    first, _, key = runs_of(w, width, k)
                    doc = w.doc[first]
                    order = np.lexsort((key, doc))
                    key, doc = key[order], doc[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key[new])), pa.array(ids[at + doc[new]])], ["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long")


def run_rows(flagged: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, tid, start, n, run_a, run_b, edges, nodes) of the runs whose minimizer is shared; n edges, n + 1 nodes."""
    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                texts, ids, tids, keys = plain(b.column(2)), np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(3)
                for at, m in slices(texts):
                    w = Words(texts.slice(at, m))
                    first, n, key = runs_of(w, width, k)
                    doc = w.doc[first]
                    # a shared minimizer is looked up together with its document
                    wanted = keys.slice(at, m)
                    flat = np.asarray(wanted.flatten()).view(np.uint64)
                    owner = np.repeat(np.arange(m, dtype=np.uint64), np.asarray(pa.compute.list_value_length(wanted)))
                    tag = np.uint64(0x9E3779B97F4A7C15)
                    hit = np.isin(key + doc.astype(np.uint64) * tag, flat + owner * tag)
                    first, n, doc = first[hit], n[hit], doc[hit]
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    index = np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])
                    e = edge_hashes(w, width)[index]
                    turn = (index - np.repeat(first, n)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                    if len(n):
                        run_a = np.add.reduceat(e * turn, offsets[:-1])
                        run_b = np.add.reduceat((e ^ (e >> np.uint64(29))) * (turn * np.uint64(0xBF58476D1CE4E5B9)), offsets[:-1]) + n.astype(np.uint64)
                    else:
                        run_a = run_b = np.zeros(0, np.uint64)
                    node_offsets = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)
                    nodes = w.runs(width - 1, salt=9)[np.repeat(first - node_offsets[:-1], n + 1) + np.arange(node_offsets[-1])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[at + doc]), pa.array(tids[at + doc]), pa.array((first - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(signed(run_a)), pa.array(signed(run_b)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(e))), pa.ListArray.from_arrays(pa.array(node_offsets), pa.array(signed(nodes))),
                    ], [*KEY, "start", "n", "run_a", "run_b", "edges", "nodes"])

    import pyarrow.compute  # noqa: F401

    return flagged.select(*KEY, "text", "keys").mapInArrow(run, "doc_id long, tid long, start int, n int, run_a long, run_b long, edges array<long>, nodes array<long>")


def shared_runs(docs: DataFrame, width: int, k: int) -> DataFrame:
    """The runs of ``run_rows`` that may lie in a repeat, stored."""
    pairs = minimizer_rows(docs, width, k)
    shared = stored(pairs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "minimizers")
    wanted = pairs.join(shared.hint("merge"), "key").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    return stored(run_rows(docs.join(wanted.hint("merge"), "doc_id"), width, k), "runs")


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, source, place, head): each edge's path, which starts at ``head`` of its source.

    ``edges``: (edge, source, place, prefix, suffix), one row per distinct edge.
    """
    ends = edges.select(F.col("suffix").alias("node"), "source", "place", F.lit(1).alias("into")).unionByName(edges.select(F.col("prefix").alias("node"), "source", "place", F.lit(0).alias("into")))
    only = lambda c, into: F.max(F.when(F.col("into") == into, F.col(c)))
    nodes = ends.groupBy("node").agg(
        F.sum("into").alias("n_in"), F.count("*").alias("n"), *(only(c, into).alias(f"{c}_{into}") for c in ("source", "place") for into in (0, 1)))
    # a node that does not branch joins its edge in to its edge out if they follow each other in one source
    joined = nodes.where("n_in = 1 AND n = 2 AND source_0 = source_1 AND place_0 = place_1 + 1").select(F.col("source_0").alias("source"), F.col("place_0").alias("place"))
    marked = edges.select("edge", "source", "place", F.lit(1).alias("real")).unionByName(joined.select(F.lit(None).cast("long").alias("edge"), "source", "place", F.lit(0).alias("real")))
    # in a source, a mark stands just before the edge that goes on
    order = W.partitionBy("source").orderBy("place", "real")
    begins = (F.col("real") == 1) & ~F.coalesce((F.lag("real").over(order) == 0) & (F.lag("place").over(order) == F.col("place")), F.lit(False))
    marked = marked.withColumn("begin", F.when(begins, F.col("place")))
    return marked.withColumn("head", F.last("begin", True).over(order)).where("real = 1").select("edge", "source", "place", "head")


def proposed(runs: DataFrame) -> DataFrame:
    """(piece, i, length, source, place): what the edges of each distinct run repeat, by hash."""
    pieces = stored(runs.groupBy("run_a", "run_b").agg(
        F.min(F.struct("doc_id", "start")).alias("lo"), F.max("doc_id").alias("hi"), F.first("edges").alias("edges"), F.first("nodes").alias("nodes")), "pieces")
    zipped = F.arrays_zip("edges", F.slice("nodes", F.lit(1), F.size("edges")).alias("prefix"), F.slice("nodes", F.lit(2), F.size("edges")).alias("suffix"))
    edges = pieces.select(F.xxhash64("run_a", "run_b").alias("piece"), "lo", "hi", F.posexplode(zipped).alias("i", "e"))
    edges = edges.select("piece", "i", "hi", F.struct(F.col("lo.doc_id").alias("source"), (F.col("lo.start") + F.col("i")).alias("place")).alias("at"), F.col("e.edges").alias("edge"), "e.prefix", "e.suffix")
    owned = edges.groupBy("edge").agg(F.min("at").alias("at"), F.max("hi").alias("last"), F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"))
    owned = stored(owned.where("at.source < last").select("edge", "at.source", "at.place", "prefix", "suffix"), "edges")
    paths = stored(compacted(owned), "paths")
    walked = edges.select("piece", "i", "hi", "edge").join(paths, "edge").where("source < hi")
    found = walked.groupBy("piece", "source", "head", (F.col("place") - F.col("i")).alias("shift")).agg(F.min("i").alias("i"), F.count("*").cast("int").alias("length"))
    return stored(found.select("piece", "i", "length", "source", (F.col("shift") + F.col("i")).alias("place")), "proposed")


def source_digests(asked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(source, place, length, da, db): digests of the words at the source coordinates.

    A source is asked for ``length`` up to a run's windows at each of its places, so its list is bounded by its text.
    """
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                (place, length), bounds = fields(part.column(2), "place", "length")
                proofs = []
                for text, lo, hi in zip(part.column(1), bounds, bounds[1:]):
                    words = words_of(text.as_py())
                    proofs += [digest(words[p:p + n + width - 1]) for p, n in zip(place[lo:hi].tolist(), length[lo:hi].tolist())]
                da, db = zip(*proofs) if proofs else ((), ())
                source = np.repeat(np.asarray(part.column(0)), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(place, pa.int32()), pa.array(length, pa.int32()), pa.array(da, pa.int64()), pa.array(db, pa.int64())], ["source", "place", "length", "da", "db"])

    lists = stored(asked.groupBy(F.col("source").alias("doc_id")).agg(F.collect_set(F.struct("place", "length")).alias("asks")), "asked")
    at = picked(docs.select("doc_id", "text"), lists.select("doc_id")).join(lists.hint("merge"), "doc_id").select("doc_id", "text", "asks")
    return at.mapInArrow(run, "source long, place int, length int, da long, db long")


def repeats(docs: DataFrame, width: int = WIDTH, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, spans of struct<start, length, da, db>) of each distinct text, to be verified; and the runs."""
    runs = shared_runs(docs, width, k)
    found = proposed(runs)
    # of a source id that several rows share, each text gives a proof; one that fits is enough
    proofs = source_digests(found, docs, width)
    walks = found.join(proofs, ["source", "place", "length"]).groupBy("piece").agg(F.collect_list(F.struct("i", "length", "source", "da", "db")).alias("walk"))
    walks = stored(walks, "walks")
    placed = runs.select(*KEY, "start", F.xxhash64("run_a", "run_b").alias("piece")).join(walks, "piece")
    placed = placed.select(*KEY, "start", F.filter("walk", lambda x: x["source"] < F.col("doc_id")).alias("walk")).where(F.size("walk") > 0)
    spans = placed.groupBy(*KEY).agg(F.flatten(F.collect_list(F.expr("transform(walk, x -> struct(start + x.i AS start, x.length AS length, x.da AS da, x.db AS db))"))).alias("spans"))
    return stored(spans, "spans"), runs


def fields(lists: pa.Array, *names: str) -> tuple[list[np.ndarray], list[int]]:
    """Fields of a column of struct lists as flat arrays, and where each row's part begins and ends."""
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).tolist()
    return [np.asarray(flat.field(n)) for n in names], bounds


def proved(words: list[bytes], spans: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose words are those at the source, and windows of spans that no proof fits; spans: start, length, da, db."""
    good, bad = np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, bool)
    for at, n, da, db in zip(*(x.tolist() for x in spans)):
        (good if digest(words[at:at + n + width - 1]) == (da, db) else bad)[at:at + n] = True
    return np.flatnonzero(good), np.flatnonzero(bad & ~good)


def cut(docs: DataFrame, spans: DataFrame, width: int, hashed: bool) -> DataFrame:
    """(doc_id, tid, gone, ranges, kept, odd): verified spans cut from each text; odd: edge hashes of windows that failed."""
    def one(text, spans):
        words = words_of(text)
        at, bad = proved(words, spans, width)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        gone = np.cumsum(change)[:len(words)] > 0
        left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
        hashes = signed(edge_hashes(Words(pa.array([text], pa.string())), width)) if len(bad) else []
        return (int(gone.sum()), [{"start": int(s), "stop": int(e)} for s, e in edges], hashlib.sha256(left).hexdigest() if hashed else left.decode(),
                [int(hashes[x]) for x in bad if x < len(hashes)])

    kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.list_(pa.int64()))

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                for start in range(0, b.num_rows, ROWS):
                    part = b.slice(start, ROWS)
                    found, bounds = fields(part.column(3), "start", "length", "da", "db")
                    rows = [one(text.as_py(), [x[lo:hi] for x in found]) for text, lo, hi in zip(part.column(2), bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, zip(*rows), kinds)], [*KEY, "gone", "ranges", "kept", "odd"])

    joined = picked(docs, spans.select(*KEY)).join(spans.hint("merge"), KEY).select(*KEY, "text", "spans")
    return joined.mapInArrow(run, f"doc_id long, tid long, gone long, ranges {RANGES}, kept string, odd array<long>").dropDuplicates(KEY)


def by_words(docs: DataFrame, runs: DataFrame, odd: DataFrame, width: int) -> DataFrame:
    """(doc_id, tid, spans): the repeated windows among those with the given edge hashes, grouped by their words; each has its own digest."""
    at = runs.select(*KEY, "start", F.posexplode("edges").alias("i", "edge")).join(odd, "edge", "left_semi")
    at = at.groupBy(*KEY).agg(F.collect_set(F.col("start") + F.col("i")).alias("starts"))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            for doc, tid, text, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                words = words_of(text.as_py())
                rows = [(doc, tid, x, b" ".join(words[x:x + width]).decode(), *digest(words[x:x + width])) for x in starts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*KEY, "start", "words", "da", "db"])

    windows = docs.select(*KEY, "text").join(at, KEY).select(*KEY, "text", "starts").mapInArrow(run, "doc_id long, tid long, start int, words string, da long, db long")
    windows = stored(windows.distinct(), "windows")
    owners = windows.groupBy("words").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    hit = windows.join(owners, "words").where("owner < doc_id")
    return hit.groupBy(*KEY).agg(F.collect_list(F.struct("start", F.lit(1).alias("length"), "da", "db")).alias("spans"))


def remove_repeats(df: DataFrame, width: int = WIDTH, k: int = KMER, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, text), one row per row of ``df``.

    removed: the cut ranges as array<struct<start, stop>> of word numbers; text: the
    words that are left, joined by blanks.  ``hashed`` gives kept_sha256, the
    SHA-256 of that text, in its place.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    facts = stored(text_facts(docs, hashed), "facts")
    usable = facts.where("doc_id IS NOT NULL").where(F.col("n_words") >= width)
    first = usable.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    copied = stored(first.where("copies > 1").select("text_a", "text_b", "first"), "copies")
    later = stored(usable.join(copied, ["text_a", "text_b"]).where("doc_id > first").select(*KEY).distinct(), "later")
    alone = picked(docs.where("doc_id IS NOT NULL"), later, "left_anti")
    spans, runs = repeats(alone, width, k)
    changed = stored(cut(alone, spans, width, hashed), "changed")
    odd = stored(changed.select(F.explode("odd").alias("edge")).distinct(), "odd")
    if odd.limit(1).count():
        spans = spans.unionByName(by_words(alone, runs, odd, width)).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
        changed = stored(cut(alone, stored(spans, "spans"), width, hashed), "changed")
    changed = changed.where("gone > 0").select(*KEY, "gone", "ranges", "kept")
    nothing = F.lit(hashlib.sha256(b"").hexdigest() if hashed else "")
    changed = changed.unionByName(later.select(*KEY, F.lit(None).cast("long").alias("gone"), F.lit(None).cast(RANGES).alias("ranges"), nothing.alias("kept")))
    out = facts.join(changed, KEY, "left")
    hit, n = F.col("kept").isNotNull(), F.col("n_words")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop")))
    return out.select(
        "doc_id", "n_words", F.when(hit, F.coalesce("gone", n)).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.coalesce("ranges", whole)).otherwise(F.array().cast(RANGES)).alias("removed"),
        F.coalesce("kept", "whole").alias("kept_sha256" if hashed else "text"))


#: The digests of the same rows in DuckDB, every window grouped by its words.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
x AS (SELECT doc_id, i, word, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o,
             lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o, lead(word, 10) OVER o, lead(word, 11) OVER o, lead(word, 12) OVER o) AS run, lead(word, 12) OVER o IS NOT NULL AS fits
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
owner AS (SELECT run, min(doc_id) AS owner FROM x WHERE fits GROUP BY run HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT x.doc_id, x.i, x.word, coalesce(x.fits AND owner.owner < x.doc_id, false) AS hit FROM x LEFT JOIN owner ON owner.run = x.run),
gone AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
