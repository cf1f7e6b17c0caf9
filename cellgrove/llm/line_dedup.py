"""Line dedup: content-defined chunks of lines, built-in SQL functions only.

1. Every line gets a 32-bit hash.  Boundaries come from several rules, each of which
   cuts a text into chunks: a rolling hash over three line hashes that is lower than
   at both neighbours, and bits of a line's own hash, which end a chunk with the line
   or begin one.  A boundary depends on nearby lines only, so an inserted line shifts
   few chunks; rules of one line align inside short blocks, where one side of a rule
   lies in other text, and what any rule finds goes.
2. Chunks of two lines or more are counted by digest, with map-side sums, so a chunk
   that stands in a third of all texts is one row per task.  The least doc_id owns it.
3. The bytes of all chunks whose digest repeats are compared; a digest that two
   different chunks share removes nothing.
4. Every later chunk goes: in documents after the owner, and in the owner after the
   first time.  A line that goes has an equal line before it, in this document or an
   earlier one, so the first of equal lines stays.

Defined cases: null texts stay null and empty texts stay empty; one-line texts
and chunks without a visible character stay; rows with a null id lose nothing;
rows that share an id are one document, of which neither row is earlier; other
columns pass through, but columns named n_lines or n_removed are replaced; a text
of any number of lines costs time in proportion (but for sorting its chunks); an
empty table gives an empty result.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import stored

PRIME = 4294967291
#: Bits of a line's hash that end a chunk with the line, and bits that begin one.
ENDS, BEGINS = (0, 1), (2, 3)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text) of the texts of several lines; ``row`` tells texts that share an id apart."""
    df = df.where(F.col(id_col).isNotNull() & F.contains(F.col(text_col), F.lit("\n")))
    return df.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text_col)).alias("_row"), F.col(text_col).alias("_text"))


def chunked(df: DataFrame) -> DataFrame:
    """(id, row, lines, cuts): lines of each text and, for each rule, the last line number of each chunk."""
    lines = df.select("_id", "_row", F.split("_text", "\n", -1).alias("_lines"))
    hashed = lines.withColumn("_h", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    rolled = hashed.select("*", F.transform("_h", lambda h, i: (h * 961 + F.coalesce(F.get("_h", i - 1), F.lit(0)) * 31 + F.coalesce(F.get("_h", i - 2), F.lit(0))) % PRIME).alias("_r"))
    last = F.size("_lines") - 1
    inner = F.when(last >= 3, F.sequence(F.lit(1), last - 2)).otherwise(F.array().cast("array<int>"))
    low = F.filter(inner, lambda i: (F.get("_r", i) < F.get("_r", i - 1)) & (F.get("_r", i) < F.get("_r", i + 1)))
    before_last = F.sequence(F.lit(0), last - 1)  # there are two lines at least

    def cut(bit, ahead):
        return F.filter(before_last, lambda i: F.shiftright(F.get("_h", i + ahead), bit).bitwiseAND(F.lit(1)) == 1)

    ends, begins = [cut(b, 0) for b in ENDS], [cut(b, 1) for b in BEGINS]
    return rolled.select("_id", "_row", "_lines", F.array(*(F.concat(e, F.array(last)) for e in (low, *ends, *begins))).alias("_cuts"))


def _chunk(lines: str, start, stop):
    """The text of a range of lines, taken one by one: a slice would copy the whole array."""
    return F.array_join(F.transform(F.sequence(start, stop), lambda i: F.get(F.col(lines), i)), "\n")


def chunks(df: DataFrame) -> DataFrame:
    """(id, row, digest, start, stop, again) of every chunk that may go."""
    # a range is one long, start and stop: distinct longs are found by hashing, structs by comparing each with each
    def ranges(ends):
        first = F.transform(ends, lambda e, i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1) * F.lit(1 << 32) + e)
        return F.filter(first, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)) > F.shiftright(x, 32))

    def shown(x):
        start, stop = F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(_chunk("_lines", start, stop).alias("chunk"), start.alias("start"), stop.alias("stop"))

    c = chunked(df).select("_id", "_row", "_lines", F.array_distinct(F.flatten(F.transform("_cuts", ranges))).alias("_ranges"))
    c = c.select("_id", "_row", F.transform("_ranges", shown).alias("_texts"))
    seen = F.transform(F.filter("_texts", lambda x: x["chunk"].rlike(r"\S")), lambda x: F.struct(F.unhex(F.md5(x["chunk"])).alias("digest"), x["start"].alias("start"), x["stop"].alias("stop")))
    # in the order of digests, then places, a repeated chunk follows its first time
    c = c.select("_id", "_row", F.array_sort(seen).alias("_sorted"))
    again = F.transform("_sorted", lambda x, i: F.struct(x["digest"].alias("digest"), x["start"].alias("start"), x["stop"].alias("stop"), x["digest"].eqNullSafe(F.get("_sorted", i - 1)["digest"]).alias("again")))
    return c.select("_id", "_row", F.inline(again))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, gone): the numbers of the lines that each text loses, from 0."""
    texts = _texts(df, id_col, text_col)
    found = stored(chunks(texts), "chunks")
    owners = found.groupBy("digest").agg(F.min("_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(found.join(owners.select("digest", "owner").hint("merge"), "digest"), "repeated")
    # the bytes of what repeats: only texts that hold some of it give them
    held = repeated.groupBy(F.col("_id").alias("_of"), F.col("_row").alias("_of_row")).agg(F.collect_set(F.struct("digest", "start", "stop")).alias("_held"))
    bytes_of = texts.join(held.hint("merge"), (F.col("_id") == F.col("_of")) & (F.col("_row") == F.col("_of_row"))).select(F.split("_text", "\n", -1).alias("_lines"), "_held")
    shown = bytes_of.select(F.inline(F.transform("_held", lambda x: F.struct(x["digest"].alias("digest"), _chunk("_lines", x["start"], x["stop"]).alias("chunk")))))
    differ = shown.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("digest")
    differ = stored(differ, "differ")
    later = repeated.where("again OR _id > owner").join(differ.hint("merge"), "digest", "left_anti")
    lines = later.select("_id", "_row", F.explode(F.sequence("start", "stop")).alias("line"))
    return lines.groupBy("_id", "_row").agg(F.collect_set("line").alias("gone"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text cut, and columns n_lines, n_removed (lines)."""
    of, row, gone = (f"_{name}_{uuid.uuid4().hex}" for name in ("of", "row", "gone"))
    found = stored(removals(df, id_col, text_col), "gone").select(F.col("_id").alias(of), F.col("_row").alias(row), F.col("gone").alias(gone))
    joined = df.join(found.hint("merge"), (F.col(id_col) == F.col(of)) & (F.unhex(F.md5(F.col(text_col))) == F.col(row)), "left").drop(of, row)
    # the outer transform splits a text once, not once for each line
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    kept = F.array_join(F.get(F.transform(F.array(F.split(text_col, "\n", -1)), left), F.lit(0)), "\n")
    return joined.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
        text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept),
    }).drop(gone)


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, len(lines) AS n, i - 1 AS i, lines[i] AS line,
             ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE doc_id IS NOT NULL AND contains(text, chr(10)))),
r AS (SELECT *, (h * 961 + coalesce(lag(h, 1) OVER w, 0) * 31 + coalesce(lag(h, 2) OVER w, 0)) % 4294967291 AS r, lead(h) OVER w AS next
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, i BETWEEN 1 AND n - 3 AND r < lag(r) OVER w AND r < lead(r) OVER w AS low FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT doc_id, i, line, rule, CASE WHEN CASE rule WHEN 0 THEN low WHEN 1 THEN h & 1 = 1 WHEN 2 THEN (h >> 1) & 1 = 1 WHEN 3 THEN (next >> 2) & 1 = 1 ELSE (next >> 3) & 1 = 1 END THEN 1 ELSE 0 END AS cut
      FROM b, range(0, 5) t(rule)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM u),
c AS (SELECT DISTINCT doc_id, min(i) AS start, max(i) AS stop, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, rule, no HAVING count(*) > 1),
m AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) AS place FROM c WHERE regexp_matches(chunk, '\S')),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM m WHERE place > 1),
kept AS (SELECT l.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
         FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(kept.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, d.text)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
