"""Benchmark decontamination by templates, built-in SQL functions only.

1. Numbers, numbers with a unit, and names (capitalised words) become typed
   placeholders that keep their value; placeholders next to each other are one, so
   a name of two words fills the same slot as a name of one, and a table of
   numbers is one token.  Everything else is lower-cased and split at anything but
   letters.
2. Every window of ``WIDTH`` template tokens is hashed, placeholders by type only;
   half of a window or more is literal.  An item of fewer tokens is one window of its
   own length, if it has a placeholder and two literal tokens, and is also looked for
   in plain lower-case words, verbatim, in windows of ``WIDTH`` words at most; windows
   of all short lengths come from one pass.  The benchmark's windows meet those of
   the documents in a hash join.  The benchmark side is broadcast only if its
   counted windows stay under ``BROADCAST_WINDOWS``; beyond that it is an ordinary
   shuffled join.
3. Hits are gathered by (document, item) at one offset, and also in bands of
   ``DRIFT`` offsets, twice so that offsets up to half a band apart share one: words
   that were put in or left out move what follows.  A group that covers ``COVER`` of
   an item's windows is a candidate.
4. Slot consistency: over the tokens of the windows that were hit, one value of the
   item must always stand for one value of the document and the other way round.
   Equal values are a verbatim leak, others a re-parameterised one; inconsistent
   slots are no leak, nor are other values of an item of ``WIDTH`` tokens or more with
   fewer than ``LITERALS`` literal tokens.
5. Every leak is reported.  ``decontaminate`` removes documents by items of ``removes``
   words or more (a parameter, ``REMOVES`` unless given), with or without an id; the
   pipeline gives 1, so that every item counts.

Defined cases: null or empty texts and items leak nothing; items without a token
are matched by nothing; rows with a null id are ignored; repeated rows count once;
rows that share an id are judged each for itself; other columns are ignored; texts
of any length are read whole; an empty table on either side gives an empty result.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import picked, stored

WIDTH, COVER, LITERALS, DRIFT = 8, 0.5, 6, 16
#: Words of an item from which it removes documents, unless a caller says otherwise.
REMOVES = 8
BROADCAST_WINDOWS = 1_000_000
#: Units that count as such after a number (fixed values).
UNITS = (
    "kilometers kilometres kilograms kilogram centimeters meters metres minutes seconds dollars percent "
    "inches pounds ounces liters litres gallons hours months miles weeks years euros cents grams yards "
    "days feet hour mile kmh mph km kg cm mm mg ml lb lbs oz ft in m g l h s"
).split()


def tokens(text):
    """Template tokens of a text column; #a.. (names), #n.. (numbers) and #q.. (with a unit) are placeholders with their values."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"\p{Lu}(?<!\p{L}\p{Lu})\p{Ll}+(?!\p{L})", " #a$0~ ")
    number = F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9])[.,](?=[0-9])", "_"), r"[0-9][0-9_]*", " #n$0~ ")
    number = F.regexp_replace(number, r"#n([0-9_]+)~ +(" + "|".join(UNITS) + r")(?!\p{L})", "#q$1_$2~")
    t = F.when(F.rlike(t, F.lit("[0-9]")), number).otherwise(t)
    # one placeholder's end, no token between, the next one's start
    t = F.lower(F.regexp_replace(t, r"~[^\p{L}#0-9_~]*#[anq]", "_"))
    return F.filter(F.split(t, r"[^\p{L}#0-9_]+"), lambda x: x != "")


def plain_words(text):
    """Lower-case words and numbers, without placeholders."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}0-9]+"), lambda x: x != "")


def kinds(name: str):
    """The tokens with placeholders reduced to their type."""
    return F.transform(name, lambda x: F.when(F.startswith(x, F.lit("#")), F.substring(x, 1, 2)).otherwise(x))


def windows(df: DataFrame, keys: list[str], words, width: int, typed: bool) -> DataFrame:
    """(keys, width, typed, at, h): hash of each window of ``words``, placeholders by type."""
    t = df.select(*keys, words.alias("_t")).where(F.size("_t") >= width)
    t = t.select(*keys, (kinds("_t") if typed else F.col("_t")).alias("_k"))
    starts = F.sequence(F.lit(1), F.size("_k") - width + 1)
    return t.select(*keys, F.lit(width).alias("width"), F.lit(typed).alias("typed"), F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice("_k", i, width)))).alias("at", "h"))


def short_windows(df: DataFrame, keys: list[str], typed: list[int], plain: list[int]) -> DataFrame:
    """(keys, width, typed, at, h) of windows of several lengths, of template tokens and of plain words, from one pass."""
    t = df.select(*keys, kinds("_t").alias("_k"), "_p") if typed else df.select(*keys, "_p")

    def every(name, width, is_typed):
        starts = F.when(F.size(name) >= width, F.sequence(F.lit(1), F.size(name) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(width).alias("width"), F.lit(is_typed).alias("typed"), (i - 1).alias("at"), F.xxhash64(F.slice(name, i, width)).alias("h")))

    return t.select(*keys, F.inline(F.concat(*(every("_k", n, True) for n in typed), *(every("_p", n, False) for n in plain))))


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, verbatim), one row per leaked item of a document."""
    found = leaks_of_texts(docs, items, width, cover)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("verbatim").alias("verbatim"))


def leaks_of_texts(docs: DataFrame, items: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """(doc_id, doc_text, item_id, n_windows, n_slots, verbatim), with a row for each candidate group; doc_text: hash of the text."""
    of_doc, of_item = ["doc_id", "doc_text"], ["item_id", "item_text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_text"), text.alias("text")).where("doc_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("item_text"), text.alias("text")).where("item_id IS NOT NULL").dropDuplicates(of_item)
    items = stored(items.select(*of_item, tokens(F.col("text")).alias("ti"), plain_words(F.col("text")).alias("pi")).where(F.size("pi") > 0), "items")
    long, short = items.where(F.size("ti") >= width), items.where(F.size("ti") < width)
    known, probe = windows(long, of_item, F.col("ti"), width, True), windows(docs, of_doc, tokens(F.col("text")), width, True)
    slots = F.size(F.filter("ti", lambda x: F.startswith(x, F.lit("#"))))
    template = short.where((slots > 0) & (F.size("ti") - slots >= 2))
    lengths = F.least(F.size("pi"), F.lit(width))
    listed = lambda df, n: sorted(r[0] for r in df.select(n).distinct().collect())  # noqa: E731  ``width`` numbers at most
    of_template, of_words = listed(template, F.size("ti")), listed(short, lengths)
    for n in of_template:
        known = known.unionByName(windows(template.where(F.size("ti") == n), of_item, F.col("ti"), n, True))
    for n in of_words:
        known = known.unionByName(windows(short.where(lengths == n), of_item, F.col("pi"), n, False))
    if of_words:
        split = docs.select(*of_doc, tokens(F.col("text")).alias("_t"), plain_words(F.col("text")).alias("_p"))
        probe = probe.unionByName(short_windows(split, of_doc, of_template, of_words))
    known = stored(known.withColumnRenamed("at", "q"), "item-windows")
    sizes = known.groupBy(*of_item, "typed").agg(F.count("*").alias("n_item"))
    side = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    hits = probe.join(side, ["width", "typed", "h"]).select(*of_doc, *of_item, "width", "typed", "q", (F.col("at") - F.col("q")).alias("shift"))
    band = lambda tag, by: F.struct(F.lit(tag).alias("tag"), by.cast("long").alias("no"))
    shift = F.col("shift")
    hits = hits.withColumn("group", F.explode(F.array(band(0, shift), band(1, F.floor(shift / DRIFT)), band(2, F.floor((shift + DRIFT // 2) / DRIFT)))))
    # a window that was hit at several offsets of a band counts at the least
    hits = hits.groupBy(*of_doc, *of_item, "width", "typed", "group", "q").agg(F.min("shift").alias("shift"))
    hits = hits.groupBy(*of_doc, *of_item, "width", "typed", "group").agg(F.collect_list(F.struct("q", "shift")).alias("hits"))
    hits = hits.join(sizes, [*of_item, "typed"]).where(F.size("hits") >= cover * F.col("n_item"))
    hits = stored(hits.select(*of_doc, *of_item, "width", "typed", "hits").distinct(), "hits")
    doc_tokens = picked(docs, stored(hits.select(*of_doc).distinct(), "hit-documents")).dropDuplicates(of_doc).select(*of_doc, tokens(F.col("text")).alias("td"))
    both = hits.join(items.select(*of_item, "ti"), of_item).join(doc_tokens, of_doc)
    steps = F.sequence(F.lit(0), F.col("width") - 1)
    pairs = F.flatten(F.transform("hits", lambda x: F.transform(steps, lambda j: F.struct((x["q"] + j).alias("at"), F.get("ti", x["q"] + j).alias("i"), F.get("td", x["q"] + x["shift"].cast("int") + j).alias("d")))))
    pairs = F.when(F.col("typed"), pairs).otherwise(F.array().cast("array<struct<at:int,i:string,d:string>>"))
    both = both.select(*of_doc, "item_id", F.size("hits").cast("long").alias("n_windows"), (F.col("width") < width).alias("whole"), pairs.alias("pairs"))
    slot = lambda p: F.startswith(p["i"], F.lit("#"))
    slots = F.array_distinct(F.transform(F.filter("pairs", slot), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    literals = F.size(F.array_distinct(F.transform(F.filter("pairs", lambda p: ~slot(p)), lambda p: p["at"])))
    both = both.select(*of_doc, "item_id", "n_windows", "whole", slots.alias("slots"), literals.alias("literals"))
    both = both.withColumn("verbatim", F.forall("slots", lambda p: p["i"] == p["d"]))
    one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda p: p[side])))
    good = both.where((one("i") == F.size("slots")) & (one("d") == F.size("slots")) & ((F.col("literals") >= LITERALS) | F.col("verbatim") | F.col("whole")))
    return good.select(*of_doc, "item_id", "n_windows", F.size("slots").cast("long").alias("n_slots"), "verbatim")


def decontaminate(df: DataFrame, items: DataFrame, removes: int = REMOVES) -> DataFrame:
    """The rows of ``df`` (doc_id, text, ...) that leak no item of ``removes`` words or more; of rows that share an id each is judged by its text."""
    of, id_ = (f"_{name}_{uuid.uuid4().hex}" for name in ("text", "id"))
    items = items.where(F.size(plain_words(F.col("text"))) >= removes).select(F.xxhash64("text").alias("item_id"), "text")
    gone = stored(leaks_of_texts(df, items).select(F.col("doc_id").alias(id_), F.col("doc_text").alias(of)).distinct(), "leaked")
    rows = df.withColumns({id_: F.col("doc_id").cast("long"), of: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return picked(rows, gone, "left_anti").drop(of, id_)
