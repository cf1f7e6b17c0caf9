"""The corpus pipeline: five stages, each over all that the stage before kept.

Each stage reads (doc_id, text, lang, source, n_chars); columns beyond these do not
pass the first one.  Rows are judged one by one, also where they share an id or
have none; tables without rows give tables without rows.
"""
from __future__ import annotations

import uuid

from cellgrove.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from cellgrove.llm.common import UNMARKED, documents, picked, shared_dir
from cellgrove.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs, sf_dir):
    """Rows that the classifier rejects go: null, empty and wordless texts, too high a perplexity, labels bad or toxic."""
    bad = quality.rejected(docs, documents(spark, sf_dir, "labels"))
    return picked(docs.select(*COLUMNS, quality.row_key().alias("key")), bad, "left_anti").select(*COLUMNS)


def line_stage(spark, docs, sf_dir):
    """Later copies of multi-line chunks go; a text of which nothing visible is left goes with them.

    Null and empty texts, and rows without an id, lose nothing and stay.
    """
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    cut = cut.where("n_removed = 0 OR text RLIKE '\\\\S'")
    return cut.selectExpr("doc_id", "text", "lang", "source", "CASE WHEN n_removed = 0 THEN n_chars ELSE CAST(length(text) AS BIGINT) END AS n_chars")


def near_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays, the least doc_id.

    Texts without words are copies of nothing; rows without an id stay; rows that share an id are one document.
    """
    return near_dedup.deduplicate(docs.select(*COLUMNS))


def leak_stage(spark, docs, sf_dir):
    """Rows that leak a benchmark item go, however short it is; rows without an id, and null or empty texts, stay."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), documents(spark, sf_dir, "benchmark"), removes=1)


def bpe_stage(spark, docs, sf_dir):
    """Token ids of what is left, the text that they decode to, and digests of both; a null text has none."""
    return bpe.encode_all(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("bpe", bpe_stage),
]


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.options(**UNMARKED).parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Perplexity, MinHash and merges have no SQL form.
ORACLE_SQL = None
