"""Spelling variants: words one edit apart, each joined to the frequent form it is a variant of.

Every word emits itself and its distinct single deletions; words one code point
apart share one of these keys, so an equi-join finds them and the exact distance
confirms them.  What meets at a key is bounded by the letters there are, not by
the table.  Words of over ``LONG`` code points emit hashes of the same strings
(made from prefix sums), so no word costs the square of its length.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import mix, signed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: One occurrence in so many loses a letter, chosen by a checksum; 0: none does.
MODULUS = 97
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Code points of a word beyond which deletions are emitted as hashes.
LONG = 64
#: The base of the polynomial hash of code points (odd, so that it has an inverse).
BASE = 0x9E3779B97F4A7C15


def vocabulary(docs: DataFrame, modulus: int = MODULUS, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of ``letters`` code points and ``count`` occurrences or more.

    A word is a run of letters, A-Z lower-cased.  Where ``modulus`` divides the
    CRC-32 of ``<doc_id>:<run>``, the run's code point number crc % length is
    deleted; a null id reads as empty.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    size = F.char_length("run")
    runs = runs.where(size >= letters)
    word = F.col("run")
    if modulus:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % size).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
        word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def hashed_deletions(word: str) -> np.ndarray:
    """Hashes of a word and of its distinct single deletions: equal strings have equal hashes."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.full(len(c), BASE, np.uint64)
    power[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c) * np.cumprod(power), dtype=np.uint64)])
    cut = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(BASE, -1, 1 << 64))
    return np.unique(np.append(cut, sums[-1]))


def _hashed_keys(words: DataFrame) -> DataFrame:
    """(id, key) of the words (id, word): rows carry numbers only, so they are as long as the text, not its square."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys = signed(hashed_deletions(b.column("word")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("id")[i], len(keys)), pa.array(keys)], names=["id", "key"])

    return words.mapInArrow(run, "id long, key long")


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of distinct words (word, n) that differ by one inserted, deleted or replaced code point.

    Such words share just one key, so no pair comes twice.
    """
    size = F.char_length("word")
    sides = [[F.col("word").alias(x), F.col("n").alias(f"n{x}")] for x in "ab"]
    one = F.levenshtein("a", "b", 1) == 1
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, size)))
    keys = words.where(size.between(1, long)).select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("key"))
    short = keys.select("key", *sides[0]).hint("merge").join(keys.select("key", *sides[1]), "key").where("a < b").where(one).drop("key")
    # words of just ``long`` code points emit both kinds; pairs of two such words belong to the first
    wide = stored(words.where(size >= long).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "long")
    hashed = _hashed_keys(wide.select("id", "word"))
    met = hashed.withColumnRenamed("id", "ida").hint("merge").join(hashed.withColumnRenamed("id", "idb"), "key").where("ida < idb").select("ida", "idb").distinct()
    for x, side in zip("ab", sides):
        met = met.join(wide.select(F.col("id").alias(f"id{x}"), *side).hint("merge"), f"id{x}")
    met = met.where(one).where((F.char_length("a") > long) | (F.char_length("b") > long))
    low = F.col("a") < F.col("b")
    ordered = [F.least("a", "b").alias("a"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb")]
    met = met.select(*ordered)
    return short.unionByName(met)


def variants(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word of a vocabulary: how many near words it has and the most frequent of them, where that has ``times`` its count.

    Ties go to the least word in code-point order.
    """
    pairs = stored(near_pairs(words, long), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w"))).alias("best"))
    found = words.join(best, "word", "left")
    frequent = -F.col("best.m") >= times * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.w")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms from it on.

    Counts grow along forms, so there are no cycles.  Each round every word takes
    the root of its root, which doubles the way that is followed; rounds are stored.
    """
    now = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.hint("merge").join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def groups(docs: DataFrame, modulus: int = MODULUS, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and letterless texts hold no words; repeated rows count each time;
    a table without words gives no rows.
    """
    words = stored(vocabulary(docs, modulus, letters, count), "words")
    forms = stored(variants(words, times, long), "forms")
    found = forms.hint("merge").join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows by DuckDB; CRC-32 is its bitwise definition.
SQL = """
WITH RECURSIVE runs AS (
 SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
 SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
 SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted
), crc AS (
 SELECT doc_id, run, times, xor(list_reduce(
   list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
   lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS h
 FROM bytes
), words AS MATERIALIZED (
 SELECT word, sum(times)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM crc)
 WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), keys AS MATERIALIZED (
 SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i::INT - 1) || substr(word, i::INT + 1))))) AS key FROM words
), near AS MATERIALIZED (
 SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  AND (length(a.word) <> length(b.word)
       OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i::INT, 1) <> substr(b.word, i::INT, 1))) = 1)
), best AS (
 SELECT word, count(*) AS n_near, arg_min(other, {'m': -m, 'w': other}) AS other, max(m) AS m FROM near GROUP BY word
), forms AS MATERIALIZED (
 SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
 SELECT word, form AS here, 1 AS step FROM forms WHERE form IS NOT NULL
 UNION ALL
 SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
