"""Language identification of web pages by Bayesian evidence fusion.

1. Text likelihoods: a naive Bayes model over hashed character trigrams, counted
   over all labelled documents in tasks and summed by (language, bin).  Every
   labelled language is kept; the model has ``BINS`` numbers for each (64 KB), however
   much text there is, and tasks hold it.  More than ``MODEL_BYTES`` of it, some
   16,000 languages, raises an error: nothing is left out in silence.
2. Each page gives its visible text, the markup language that it declares, its
   host and its address suffix.
3. Text posteriors are summed over the corpus, by suffix and by host (grouped
   aggregation).  The host's prior is smoothed towards its suffix's, that towards
   the corpus's.  A page's own share is taken out of its host's sums.
4. How often each language declares each code is counted the same way, smoothed.
5. The logarithms of tempered text likelihood, declaration and host prior add up.

Defined cases: null or empty pages, or pages without text, keep the prior and
the declaration; a null or bad address has the host ''; declared codes that are
no known language count as 'other'; ties go to the language first in the
alphabet; rows with a null id give a row; other columns are ignored; without
labelled documents the language is null; a page of any length is read whole, but
its text weighs at most as ``MOST`` says; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import plain, slices, stored

BINS, MODEL_BYTES = 1 << 14, 1 << 30
#: Weight of one trigram's evidence (neighbours are not independent), and the most that text may weigh in all.
TEMPER, MOST = 0.2, 200.0
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 10.0
#: Pages of a language that are taken to declare it, and each other code, before any is seen.
HONEST, OTHERWISE = 5.0, 0.5


def trigrams(texts: pa.Array):
    """(text number, bin) of every byte trigram of a slice, ASCII letters lower-cased."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    d = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    d = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = (doc[:-2] == doc[2:]) & (d[1:-1] > 32)
    return doc[:-2][inside], h[inside].astype(np.int64)


def likelihoods(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each bin."""
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), plain(b.column(1))
            for at, m in slices(texts):
                doc, h = trigrams(texts.slice(at, m))
                names = sorted(set(langs[at:at + m]))
                own = np.array([names.index(x) for x in langs[at:at + m]], np.int64)
                n = np.bincount(own[doc] * BINS + h, minlength=len(names) * BINS).reshape(-1, BINS)
                for x, row in zip(names, n):
                    held[x] = held.get(x, 0) + row
        for x, row in held.items():
            bins = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(bins), pa.string()), pa.array(bins), pa.array(row[bins].astype(np.int64))], ["lang", "bin", "n"])

    rows = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "lang string, bin long, n long")
    counts = stored(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "trigrams")
    known = counts.select("lang").distinct()
    n = known.count()
    if 4 * BINS * n > MODEL_BYTES:
        raise ValueError(f"{n} labelled languages: their model of {4 * BINS * n} bytes is more than tasks may hold ({MODEL_BYTES})")
    langs = sorted(r["lang"] for r in known.collect())
    number = {x: i for i, x in enumerate(langs)}
    table = np.full((len(langs), BINS), 0.5, np.float32)
    rows = counts.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("n"))
    for r in rows.toLocalIterator():  # one row of at most BINS numbers for each language
        table[number[r["lang"]], r["bins"]] += np.array(r["n"], np.float64)
    return langs, np.log(table / table.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32) if langs else table


def features(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row, page_id, host, suffix, declared, text): text is the tempered log likelihood of each language."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    code = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    declared = F.when(code == "", "none").when(code.isin(langs), code).otherwise("other")
    t = F.coalesce(F.col(html_col), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style|nav)\b[^>]*+>.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    t = F.regexp_replace(t, r"&[A-Za-z0-9#]{1,10};", " ")
    page = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), declared.alias("declared"), t.alias("t"))
    page = page.withColumn("suffix", F.substring_index("host", ".", -1))

    def run(batches):
        for b in batches:
            texts = plain(b.column(5))
            for at, m in slices(texts):
                doc, h = trigrams(texts.slice(at, m))
                n = np.bincount(doc, minlength=m)
                total = np.stack([np.bincount(doc, weights=row[h].astype(np.float64), minlength=m) for row in table], axis=1) * TEMPER
                # beyond MOST trigrams' worth of evidence, more text adds no more
                total *= (np.minimum(n, MOST / TEMPER) / np.maximum(n, 1))[:, None]
                total -= total.max(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * np.int32(len(table))), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(at, m) for i in range(5)] + [lists], ["row", "page_id", "host", "suffix", "declared", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return stored(page.select("row", "page_id", "host", "suffix", "declared", "t").mapInArrow(run, f"row long, page_id {kind}, host string, suffix string, declared string, text array<double>"), "features")


def identify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, lang, probability, declared, host), one row per page."""
    langs, table = likelihoods(labelled)
    if not langs:
        return pages.select(F.col(id_col).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit("none").alias("declared"), F.lit("").alias("host"))
    size = range(len(langs))
    f = features(pages, langs, table, id_col, url_col, html_col)
    weight = F.transform("text", lambda x: F.exp(x))
    share = F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b))
    f = f.withColumn("share", share)
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in size]
    array = lambda name: F.array(*(F.col(f"s{i}") for i in size)).alias(name)
    n = lambda name: F.aggregate(name, F.lit(0.0), lambda a, b: a + b)
    overall = f.agg(*sums).select(array("all_sum"))
    prior = F.transform("all_sum", lambda x: (x + 1.0) / (n("all_sum") + len(langs)))
    overall = overall.select(prior.alias("prior"))
    suffixes = f.groupBy("suffix").agg(*sums).select("suffix", array("suffix_sum")).join(F.broadcast(overall))
    suffixes = suffixes.select("suffix", F.transform("suffix_sum", lambda x, i: (x + SUFFIX_WEIGHT * F.get("prior", i)) / (n("suffix_sum") + SUFFIX_WEIGHT)).alias("suffix_prior"))
    hosts = stored(f.groupBy("host", "suffix").agg(*sums).select("host", "suffix", array("host_sum")).join(suffixes, "suffix").select("host", "host_sum", "suffix_prior"), "hosts")
    # P(declared | language), at most (languages + 2) rows
    codes = f.groupBy("declared").agg(*sums).select("declared", array("code_sum"))
    totals = f.agg(*sums).select(array("lang_sum"))
    codes = codes.join(F.broadcast(totals)).select("declared", F.transform("code_sum", lambda x, i: F.ln((x + F.when(F.col("declared") == F.get(F.array(*map(F.lit, langs)), i), HONEST).otherwise(OTHERWISE)) / (F.get("lang_sum", i) + HONEST + OTHERWISE * (len(langs) + 1)))).alias("says"))
    g = f.join(hosts, "host").join(F.broadcast(codes.limit(len(langs) + 2)), "declared")
    rest = F.transform("host_sum", lambda x, i: F.greatest(x - F.get("share", i), F.lit(0.0)))
    g = g.withColumn("others", rest)
    logs = F.transform("others", lambda x, i: F.get("text", i) + F.get("says", i) + F.ln((x + HOST_WEIGHT * F.get("suffix_prior", i)) / (n("others") + HOST_WEIGHT)))
    g = g.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    names = F.array(*map(F.lit, langs))
    total = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, b: a + b)
    return g.select("page_id", F.get(names, F.array_position("logs", F.col("best")).cast("int") - 1).alias("lang"), (1.0 / total).alias("probability"), "declared", "host")
