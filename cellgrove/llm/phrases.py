"""Phrase collocations: contiguous phrases that are more frequent than their parts let expect.

All 1..max_n-grams become rows and are counted by hash aggregation, one length at
a time, so that the shuffle of one length is on disk at once; a task sends each
phrase of a slice of texts once, with its count.  A phrase can only be frequent
where the phrases that are one word shorter are, so it becomes a row only if a bit
table of those (of fixed size, as large for any input) has both: a full table lets
more rows through and never holds back a frequent phrase.  Candidates are joined with the
counts of every first and last part, scored in Decimal, and dropped where a
candidate that is one word longer holds them often enough.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellgrove.llm.common import mix, plain, signed, slices, stored

#: Bytes that end a piece (``.,;:!?`` and \\x0A-\\x0D) and bytes between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
MAX_N, LEAST, PERCENT, FIRST = 3, 10, 50, 2000
NO_LANGUAGE = "und"
#: Bytes of text that are counted at a time in a task: repeats inside a slice cost nothing to shuffle.
SLICE = 2 << 20
#: The bit table has two to this power of bits (4 MB), whatever it is made from.
BITS = 25


def _words(texts: pa.Array):
    """(words, piece of each, text of each) of a slice of texts, lower-cased; pieces never cross texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(ENDS)] = 1, 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    n, kinds = len(data), kind[data]
    word = kinds == 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:n]))
    size = np.flatnonzero(word & (~after | edge[1:])) + 1 - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    room = pa.py_buffer(lower[data[word]].tobytes())
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int32).tobytes()), room)
    # a piece is named by the number of ends and edges before it
    piece = np.cumsum(((kinds == 2) | edge[:n]).astype(np.int8), dtype=np.int32)[start]
    return words, piece, np.searchsorted(offsets, start, side="right") - 1


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def _chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words before the last (of its language, for one word) and of the last."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def marks(phrases: DataFrame, n: int, bits: int = BITS) -> np.ndarray:
    """A bit table of the phrases of ``n`` words (lang, phrase): at most ``2 ** (bits - 6)`` longs reach the driver."""
    def run(batches):
        for b in batches:
            words = pc.split_pattern(plain(b.column("phrase")), " ").flatten().dictionary_encode()
            word = _hashes(words.dictionary)[words.indices.to_numpy()].reshape(-1, n)
            tongue = plain(b.column("lang")).dictionary_encode()
            h = _hashes(tongue.dictionary)[tongue.indices.to_numpy()]
            for j in range(n):
                h = _chained(h, word[:, j])
            at = h >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(signed(at >> np.uint64(6))), pa.array(signed(np.uint64(1) << (at & np.uint64(63))))], names=["at", "mask"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def _marked(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(table).bit_length() + 5))
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counted(texts: pa.Array, langs: pa.Array, n: int, table: np.ndarray | None = None):
    """(lang, phrase, count) arrays of the distinct phrases of ``n`` words of a slice whose first and last ``n`` - 1 words are in the table."""
    words, piece, text = _words(texts)
    if len(words) < n:
        return None
    coded, tongue = words.dictionary_encode(), langs.dictionary_encode()
    code, lang = coded.indices.to_numpy(), tongue.indices.to_numpy()[text]
    at = np.flatnonzero(piece[:len(code) - n + 1] == piece[n - 1:])
    if table is not None and n > 1:
        word, h = _hashes(coded.dictionary)[code], _hashes(tongue.dictionary)[lang]
        size = len(code) - n + 2
        h = h[:size]
        for j in range(n - 1):
            h = _chained(h, word[j:j + size])
        known = _marked(h, table)
        at = at[known[at] & known[at + 1]]
    if not len(at):
        return None
    ids = lang[at].astype(np.int64)
    for j in range(n):  # pairs of (what came before, next word) are numbered anew, so keys never pass 64 bits
        ids = pa.array(ids * len(coded.dictionary) + code[at + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
    count = np.bincount(ids)
    sample = np.zeros(len(count), np.int64)
    sample[ids] = at
    parts = [coded.dictionary.take(pa.array(code[sample + j])) for j in range(n)]
    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    return tongue.dictionary.take(pa.array(lang[sample])), phrase, pa.array(count)


def _cut(text: bytes, most: int, n: int):
    """Parts of a text of about ``most`` bytes, each but the first beginning with the last ``n`` - 1 words before it: every phrase of ``n`` words is in one part."""
    at, size = 0, most
    while len(text) - at > size:
        end = max(text.rfind(bytes([b]), at, at + size) for b in BLANKS + ENDS)
        before = text[at:end].rsplit(None, n - 1) if end > at else []
        if len(before) < n or not before[0]:
            size *= 2  # words too long for a cut
            continue
        yield text[at:end]
        at, size = at + len(before[0]), most
    yield text[at:]


def ngrams(docs: DataFrame, n: int, slice_bytes: int = SLICE, table: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, c) rows whose counts sum to the occurrences of every phrase of ``n`` words (that ``table`` lets through)."""
    shared = docs.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches):
        known = shared.value if shared is not None else None

        def rows(texts, langs):
            found = _counted(pa.concat_arrays(texts), pa.concat_arrays(langs), n, known)
            if found:
                yield pa.RecordBatch.from_arrays(list(found), names=["lang", "phrase", "c"])

        texts, langs, held = [], [], 0
        for b in batches:
            text, lang = plain(b.column("text")), b.column("lang").cast(pa.string()).fill_null(NO_LANGUAGE)
            for at, size in slices(text, slice_bytes):
                part = text.slice(at, size)
                total = int(pc.sum(pc.binary_length(part)).as_py() or 0)
                if total > slice_bytes and size == 1:
                    for cut in _cut(part[0].as_py().encode(), slice_bytes, n):
                        yield from rows([pa.array([cut.decode()])], [lang.slice(at, 1)])
                    continue
                texts.append(part)
                langs.append(lang.slice(at, size))
                held += total
                if held >= slice_bytes // 2:
                    yield from rows(texts, langs)
                    texts, langs, held = [], [], 0
        if texts:
            yield from rows(texts, langs)

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, c long")


def counts(docs: DataFrame, n: int, least: int = 1, table: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``n`` words that occur ``least`` times or more; ``table``: the marks of those with one word less."""
    return ngrams(docs, n, table=table).groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def _floor_ratio(a, l, r):
    """floor(1000000 * a * a / (l * r)) without a rounding step; l * r has up to 38 digits."""
    a, l, r = (c.cast("decimal(15,0)") for c in (a, l, r))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, l * r)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, percent: int = PERCENT, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``first`` phrases of 2 to ``max_n`` words.

    ``docs`` has text and lang; other columns are ignored.  A null language is
    ``und``; null, empty and wordless texts hold no phrases; repeated rows count
    each time; a table without candidates gives no rows.  Counts may have 15 digits.
    """
    single = stored(counts(docs, 1), "words")
    levels = [single.where(F.col("f") >= least)]
    for n in range(2, max_n + 1):
        levels.append(stored(counts(docs, n, least, marks(levels[-1], n - 1, bits)), f"phrases{n}"))
    known = levels[0].withColumn("n", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        known = known.unionByName(level.withColumn("n", F.lit(n)))
    known = stored(known, "known")
    wide = known.where("n > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, b: F.array_join(F.slice(F.col("w"), a, b), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("n") - k).alias("tail")))
    cut = wide.select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    # parts of a candidate are as frequent as it is, so they are all among the known
    cut = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")).hint("merge"), ["lang", "head"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")).hint("merge"), ["lang", "tail"])
    best = F.min(F.struct(_floor_ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("best")
    scored = cut.groupBy("lang", "phrase", "a").agg(best)
    # what holds a phrase at any length holds it with one more word at least as often
    longer = wide.where("n > 2").select("lang", F.col("f"), F.explode(F.array(part(F.lit(1), F.col("n") - 1), part(F.lit(2), F.col("n") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = (F.col("s.lang") == F.col("o.lang")) & (F.col("s.phrase") == F.col("o.phrase")) & (100 * F.col("o.f") >= percent * F.col("s.a"))
    kept = scored.alias("s").join(longer.alias("o").hint("merge"), held, "left_anti")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", place).where(F.col("rank") <= first)
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


#: The same rows by DuckDB, in 128-bit whole numbers.
SQL = """
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS MATERIALIZED (
 SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), known AS MATERIALIZED (
 SELECT lang, g.n, g.phrase, count(*)::HUGEINT AS f FROM (
  SELECT lang, unnest([{'n': 1, 'phrase': w[i]} for i in range(1, len(w) + 1)]
    || [{'n': 2, 'phrase': w[i] || ' ' || w[i + 1]} for i in range(1, len(w))]
    || [{'n': 3, 'phrase': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]} for i in range(1, len(w) - 1)]) AS g FROM split)
 GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM known WHERE n = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE n > 1 AND f >= 10),
cut AS (
 SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (1000000 * c.f * c.f) // (x.f * y.f) AS score
 FROM (SELECT *, unnest(range(1, n)) AS k FROM cand) c
 JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
 JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'k': k}) AS b FROM cut GROUP BY ALL),
kept AS (
 SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM cand q WHERE q.n = 3 AND q.lang = best.lang AND 100 * q.f >= 50 * best.a
  AND (best.phrase = q.w[1] || ' ' || q.w[2] OR best.phrase = q.w[2] || ' ' || q.w[3]))
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, totals.n, b.score::BIGINT AS score
FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
