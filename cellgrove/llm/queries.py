"""The queries opN_<name>: thin, each over its whole table, through its operator."""
from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.llm import bpe, decontaminate, language, line_dedup, near_dedup, neighbours, phrases, pii, quality, simhash, spelling, substring_dedup, token_counts
from cellgrove.llm.common import documents


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file; callers of the operators pass their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op3_near_dedup(spark, sf_dir):
    return near_dedup.classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op4_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(documents(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


def op5_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(documents(spark, sf_dir), hashed=True)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_bpe(spark, sf_dir):
    return bpe.encode_digest(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op7_quality(spark, sf_dir):
    """The documents that pass."""
    out = quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.where("kept").select("doc_id", "lang", "n_words", "log_ppl", "limit", "kept")


def op8_pii(spark, sf_dir):
    return pii.report(documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_decontamination(spark, sf_dir):
    """The leaked items of each document."""
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op11_simhash(spark, sf_dir):
    return simhash.classes(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op12_spelling(spark, sf_dir):
    return spelling.groups(documents(spark, sf_dir))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def queries():
    every = (op1_line_dedup, op2_language_id, op3_near_dedup, op4_nearest_neighbours, op5_substring_dedup,
             op6_bpe, op7_quality, op8_pii, op9_token_counts, op10_decontamination,
             op11_simhash, op12_spelling, op13_phrases)
    return {f.__name__: f for f in every}


def oracle_sql():
    """What SQL can express; the rest is tested against brute force in tests/llm."""
    return {"op1_line_dedup": line_dedup.SQL, "op3_near_dedup": near_dedup.SQL, "op5_substring_dedup": substring_dedup.SQL,
            "op12_spelling": spelling.SQL, "op13_phrases": phrases.SQL}
