"""The pipeline's rows against its stages' contracts on the smallest tables."""
import hashlib
import random

import numpy as np

import corpus_pipeline as P
from cellgrove.llm import bpe
from cellgrove.llm.common import stored
from cellgrove.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own, sizes = bpe.Encoder(tokenizer("word_bpe_49k.json")), [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
    assert sizes[0] > sizes[1] > sizes[3] >= sizes[4] == sizes[5] > 0.5 * sizes[0]
    texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
    for r in docs.collect():
        ids = bpe.numbers(own.encode(texts[r["doc_id"]])).tolist()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)
    ran = {r["doc_id"]: r["ids_sha256"] for r in P.run(spark, SF).collect()}
    assert ran == {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}


def words(seed, n, size=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def tables(spark, folder, docs, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, key long"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_and_ties(spark, tmp_path):
    block = "\n".join(words(900 + i, 6) for i in range(40))
    item = "every morning the old farmer feeds 12 hens with corn and asks how long it will last"
    docs = [(i, words(i, 80)) for i in range(50)]
    docs += [
        (100, docs[0][1]), (101, None), (102, ""), (103, " \n "), (None, words(60, 80)), (None, None), (None, "Q! " * 80),  # copies, nothing, no id
        (104, words(61, 80)), (104, words(61, 80)), (104, words(62, 80)),  # one id, repeated rows and another text
        (105, words(63, 30) + "\n" + block), (106, words(64, 30) + "\n" + block),  # a shared run of lines
        (107, words(65, 20) + " " + item), (108, words(66, 4000)), (40, "Z?? " * 50),
    ]
    sf = tables(spark, tmp_path, docs, [(i, 1, 0) for i in range(40)] + [(45, 0, 0), (46, 1, 1), (None, 1, 0), (107, 1, 0), (105, 1, 0)], [(1, item), (2, None), (3, "")])
    now, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        now = stored(stage(spark, now, sf), name)
        left[name] = now.collect()
    rows = {name: [(r["doc_id"], r["text"]) for r in left[name]] for name, _ in P.STAGES[:-1]}
    kept = rows["quality"]
    assert not {101, 102, 103, 45, 46} & {i for i, _ in kept} and [t for i, t in kept if i is None] == [words(60, 80)]  # a bad row does not take its id along
    assert [t for i, t in kept if i == 40] == [words(40, 80)] and sum(i == 104 for i, _ in kept) == 3
    cut = dict(r for r in rows["line_dedup"] if r[0] != 104)
    assert block in cut[105] and block not in cut[106] and len(rows["line_dedup"]) == len(kept)
    near = [i for i, _ in rows["near_dedup"]]
    assert 100 not in near and 0 in near and None in near and near.count(104) == 3
    clean = [i for i, _ in rows["decontamination"]]
    assert set(near) - set(clean) == {107} and len(left["bpe"]) == len(clean)
    assert sorted(r["n_tokens"] for r in left["bpe"]) == sorted(len(r["ids"]) for r in left["bpe"]) and all((r["decoded"] != "") == (r["n_tokens"] > 0) for r in left["bpe"])


def test_tables_without_rows(spark, tmp_path):
    for k, (docs, labels, items) in enumerate([([], [], []), ([(1, words(1, 30)), (2, None)], [], []), ([], [(1, 1, 0)], [(1, "a b c")])]):
        sf = tables(spark, tmp_path / str(k), docs, labels, items)
        assert {r["doc_id"] for r in P.run(spark, sf).collect()} == ({1} if docs else set())
