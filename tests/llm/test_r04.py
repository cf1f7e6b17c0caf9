"""What the fourth round of findings asked for."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrove.llm import quality
from cellgrove.llm.common import Words


def test_classes_of_words_at_once():
    r = random.Random(3)
    words = ["".join(r.choice("abZQ7.,!?)]'\"-_#|éÉß²") for _ in range(r.randrange(1, 7))) for _ in range(5000)]
    texts = pa.array(["gone", " ".join(words), "x"])[1:]
    found = Words(texts)
    want = [quality.word_class(w) for w in words] + [quality.word_class("x")]
    assert quality.Classes()(texts, found, np.arange(len(found.hash))).tolist() == want


def test_keys_are_those_of_spark(spark):
    u, v = (np.random.default_rng(i).integers(-1 << 63, 1 << 63, 100) for i in (1, 2))
    got = [r[0] for r in spark.createDataFrame(zip(u.tolist(), v.tolist()), "u long, v long").coalesce(1).select(F.xxhash64("u", "v")).collect()]
    assert quality.pair(u.view(np.uint64), v.view(np.uint64)).view(np.int64).tolist() == got


def test_quality_knows_every_word(spark):
    """Perplexities over 6,000 words and unseen ones against the formulas written out; so are those by the other half."""
    r = random.Random(7)
    phrases = [" ".join(f"w{r.randrange(9000)}{r.choice(('', '', ',', '!'))}" for _ in range(2)) for _ in range(4000)]
    text = lambda: " ".join(r.choice(phrases) for _ in range(250))
    texts = {i: text() for i in range(40)} | {50: "Never seen!! ||| " + text(), 51: "w1 w1 w1 w1", 52: text() + " ölig"}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").withColumns({"row": F.col("doc_id"), "key": F.col("doc_id")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    old, got = quality.HEAD, []
    try:
        for quality.HEAD in (old, 50):
            got.append({x["doc_id"]: (x["log_ppl"], x["held"]) for x in quality.scored(docs, labels).collect()})
    finally:
        quality.HEAD = old
    halves = {x[0]: x[1] for x in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2))).collect()}
    split = {i: ["<>", *t.split(), "<>"] for i, t in texts.items()}

    def cuts(counts):
        n = Counter(counts)
        assert n[1] and n[2]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.05), k - 0.05) for k in (1, 2, 3)]

    def plain(trusted, asked):
        c = Counter(b for i in trusted for b in zip(split[i], split[i][1:]))
        cont = Counter(v for _, v in c)
        assert len(cont) > 4096
        d, e, total = cuts(c.values()), cuts(cont.values()), sum(cont.values())
        cut = lambda d, n: d[min(n, 3) - 1]
        held = sum(cut(e, k) for k in cont.values()) / total
        once = Counter(quality.word_class(w) for w, k in cont.items() if k == 1 and w != "<>")
        share = lambda w: (once[quality.word_class(w)] + 1) / (sum(once.values()) + 64)
        p1 = lambda v: (cont[v] - cut(e, cont[v])) / total + held / quality.WIDTH if v in cont else held * share(v) * (1 - len(cont) / quality.WIDTH)
        cu, gu = Counter(), Counter()
        for (u, _), n in c.items():
            cu[u] += n
            gu[u] += cut(d, n)
        p = lambda u, v: p1(v) if u not in cu else ((c[u, v] - cut(d, c[u, v])) / cu[u] if (u, v) in c else 0) + gu[u] / cu[u] * p1(v)
        return {i: -sum(np.log(p(u, v)) for u, v in zip(split[i], split[i][1:])) / (len(split[i]) - 1) for i in asked}

    whole = plain(range(40), texts)
    held = {}
    for h in (0, 1):
        held |= plain([i for i in range(40) if halves[i] != h], [i for i in range(40) if halves[i] == h])
    for found in got:
        for i in texts:
            assert found[i][0] == pytest.approx(whole[i], rel=1e-6)
            assert found[i][1] == (pytest.approx(held[i], rel=1e-6) if i < 40 else None)


def test_short_items_remove_documents_from_the_pipeline(spark, tmp_path):
    items = [(1, "What is 12 times 7?"), (2, "plain words only here"), (None, "a boat sails to 7 far islands in a day and back"), (4, None), (5, " ?")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = ["Asked. What is 12 times 7? Who knows", "Asked. What is 13 times 8? Who knows", "so plain words only here it says", "plain words are only here", "a boat sails to 7 far islands in a day and back", "nothing ?", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    got = corpus_pipeline.leak_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == {3, 5, 6, 7}
