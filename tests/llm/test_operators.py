"""Each operator against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import bpe, decontaminate, language, line_dedup, near_dedup, neighbours, pii, quality, substring_dedup, token_counts
from cellgrove.llm.queries import oracle_sql, queries, tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def corpus():
    long_text = words(9, 6000, 3000)
    base, passage = words(1, 120), words(2, 40)
    edited = " ".join(w if i % 37 else "X" for i, w in enumerate(base.split()))
    lines = "\n".join(words(100 + i, 8) for i in range(12))
    return [
        (1, base), (2, base), (3, edited), (4, None), (5, ""), (6, "one two"), (7, "One TWO"), (8, " \n\t "), (9, long_text), (10, long_text + " tail"),
        (11, words(3, 60) + " " + passage + " " + words(4, 20)), (12, passage), (13, words(5, 10) + " " + passage), (14, lines), (15, "new line here\n" + lines), (16, lines + "\n" + lines),
        (None, base), (17, "é ü x  y"), (17, "é ü x  y"),
    ]


def frame(spark, rows=None):
    """With extra columns whose names clash with results."""
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("n_tokens", "kept", "component_id", "n_lines", "start", "key", "row", "_id", "gone", "digest", "h", "at", "bands", "sig", "text_a", "lo", "n")})


def empty(spark):
    return frame(spark, [])


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(frame(spark)).orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 19 and got[4]["text"] is None and got[5]["text"] == ""
    assert got[14]["n_removed"] == 0 and got[1]["n_removed"] == 0
    assert got[15]["text"].startswith("new line here") and got[15]["n_removed"] >= 6
    assert got[16]["n_removed"] >= 18
    assert got[16]["n_lines"] == 24 and line_dedup.dedup_lines(empty(spark)).count() == 0
    for i in (15, 16):  # what is left is lines of the text, in order
        left, all_ = got[i]["text"].split("\n"), iter(dict(corpus())[i].split("\n"))
        assert all(x in all_ for x in left if x)


def test_line_dedup_of_long_texts_and_clashing_columns(spark):
    import time

    block = [f"line {i} {i * i % 97}" for i in range(60000)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["start", *block, *block[:500]])), (3, "alone\ntext")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("n_lines", "N_removed", "__gone", "__of", "extra")})
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.time() - began < 60
    assert got[1]["n_removed"] == 0 and got[2]["n_lines"] == 60501 and got[2]["n_removed"] > 60400 and got[2]["text"].startswith("start")
    assert got[3]["text"] == "alone\ntext" and (got[3]["extra"], got[3]["__gone"], got[3]["__of"], got[3]["n_lines"]) == (7, 7, 7, 2)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    def find(x):
        return x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = near_dedup.classes(frame(spark)).collect()
    expected = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected
    assert len(got) == len(corpus()) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.classes(empty(spark)).count() == 0
    assert {r["doc_id"] for r in near_dedup.deduplicate(frame(spark).select("doc_id", "text")).collect()} == {i for i, (_, c) in expected.items() if i == c} | {None}


def test_near_dedup_chain(spark):
    # neighbours at 0.8, ends far apart: one component
    w, rows = words(7, 200, 10 ** 6).split(), []
    for i in range(8):
        rows.append((i + 1, " ".join(w)))
        w = w[10:] + [f"n{i}_{k}" for k in range(10)]
    got = near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got} == {1} and brute_components(rows)[8][1] == 1


def test_near_dedup_of_short_pairs_at_the_limit(spark):
    # every pair shares exactly three quarters of its shingles
    rows, expected = [], {}
    for n in (4, 8, 12, 20, 40):
        for k in range(150):
            i, w = len(rows), [f"p{n}_{k}_{j}" for j in range(n + 4)]
            rows += [(i, " ".join(w)), (i + 1, " ".join(w[:len(w) - n // 4]))]
            expected.update({i: i, i + 1: i})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == expected


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_near_dedup_compares_words(spark):
    # words that polynomial hashes of bytes take for equal
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, f"x y z {one}"), (2, f"x y z {two}"), (3, f"x y z {one}")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_near_dedup_in_blocks(spark, monkeypatch):
    # one template, many fillings: buckets hold many documents that are not near, in blocks of three
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LONG", 70)
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    r, base, rows = random.Random(6), words(30, 90, 10 ** 6).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice((1, 2, 6))):
            w[r.randrange(90)] = f"f{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w[:r.choice((60, 90))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 3


def brute_repeats(rows):
    own, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if own.setdefault(tuple(w[j:j + 13]), i) < i:
                gone[j:j + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_dedup(spark):
    rows = [(i, t) for i, t in corpus()]
    got = substring_dedup.remove_repeats(frame(spark), hashed=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == brute_repeats(rows)
    assert len(got) == len(rows) and [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    texts = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark)).collect()}
    assert all(hashlib.sha256(texts[r["doc_id"]]["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert texts[2]["removed"] == [(0, 120)] and texts[1]["removed"] == [] and sum(r["stop"] - r["start"] for r in texts[10]["removed"]) == texts[10]["n_removed"] > 0
    r = random.Random(4)
    few = [(i, " ".join(f"w{r.randrange(2)}" for _ in range(r.randrange(60)))) for i in range(40)]  # windows overlap in every way
    few += [(i + 40, " ".join(f"v{r.randrange(30)}" for _ in range(20)) + " " + few[i % 7][1]) for i in range(20)]
    def check():
        got = substring_dedup.remove_repeats(spark.createDataFrame(few, DOCS), hashed=True).collect()
        assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute_repeats(few)
    check()


def test_substring_dedup_verifies_words(spark):
    # words that polynomial hashes of bytes take for equal
    one, two, start = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a"), words(40, 12)
    rows = [(1, f"{start} {one}"), (2, f"{start} {two}"), (3, f"x {start} {one} y")]
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_substring_dedup_when_hashes_meet(spark, monkeypatch):
    # every proposal is moved, so no proof fits: all windows are then grouped by their words
    r = random.Random(8)
    rows = [(i, words(r.randrange(30), 40, 50) + " " + words(60 + i, 5)) for i in range(60)]
    df, old, fell_back = spark.createDataFrame(rows, DOCS), substring_dedup.repeats, []
    def moved(docs, width, k):
        spans, runs = old(docs, width, k)
        wrong = F.transform("spans", lambda x: F.struct(x["start"], x["length"], F.when(F.col("doc_id") % 3 > 0, x["da"] + 1).otherwise(x["da"]).alias("da"), x["db"]))
        return spans.withColumn("spans", wrong), runs
    plain = substring_dedup.by_words
    monkeypatch.setattr(substring_dedup, "repeats", moved)
    monkeypatch.setattr(substring_dedup, "by_words", lambda *a: fell_back.append(1) or plain(*a))
    got = substring_dedup.remove_repeats(df, hashed=True).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute_repeats(rows) and fell_back


def test_substring_dedup_compacts_paths(spark):
    # sources 1 and 2; an edge that two lead to starts a new path
    e = [(10, 1, 0, 100, 101), (11, 1, 1, 101, 102), (12, 1, 2, 102, 103), (13, 1, 4, 104, 105), (20, 2, 7, 200, 102)]
    got = {r["edge"]: r["head"] for r in substring_dedup.compacted(spark.createDataFrame(e, "edge long, source long, place int, prefix long, suffix long")).collect()}
    assert got == {10: 0, 11: 0, 12: 2, 13: 4, 20: 7}


def test_substring_dedup_of_rows_that_share_an_id(spark):
    a, b = words(50, 60, 10 ** 6), words(51, 60, 10 ** 6)
    rows = [(1, a), (5, a), (5, "p q r " + b), (7, b), (7, "s " + a), (7, b)]
    got = sorted((r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(1, a), (5, ""), (5, "p q r " + b), (7, ""), (7, "s"), (7, "")])


def odd_texts():
    r = random.Random(1)
    return [t for _, t in corpus()] + ["a    x <|endoftext|> b<|endoftext|>c  ", "ΑΣ ΣΑΣ. I'd've 's 12３ ½", "\x1c!\x1d x\x85y", " \n", "x<|startoftext|>Y '"] + [
        "".join(r.choice("ab'sdt \n\t .<|>12éÉΣ́ \U0001f600") for _ in range(60)) for _ in range(300)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t, rows = Tokenizer.from_file(path), list(enumerate(odd_texts()))
    encoded = bpe.encode(spark.createDataFrame(rows, DOCS), path)
    out = {r["doc_id"]: r for r in encoded.join(bpe.decode(encoded, path).withColumnRenamed("text", "decoded"), "doc_id").collect()}
    both = {r["doc_id"]: r for r in bpe.round_trip(spark.createDataFrame(rows, DOCS), path).collect()}
    dig = {r["doc_id"]: r for r in bpe.encode_digest(spark.createDataFrame(rows, DOCS), path).collect()}
    own = bpe.Encoder(path)
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert out[i]["ids"] == both[i]["ids"] == ids and out[i]["decoded"] == both[i]["decoded"] == back == own.decode(ids)
        assert dig[i]["n_tokens"] == len(ids) and dig[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert dig[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_digest(empty(spark), path).count() == 0 and bpe.round_trip(empty(spark), path).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first()["text"] == ""


def test_bpe_forgets_and_refuses(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "GENERATION", 7)  # words leave the memory while texts are encoded
    own, library = bpe.Encoder(path), Tokenizer.from_file(path)
    long_text = words(9, 60000, 30000) + " " + "é" * 5000 + "".join(map(chr, range(32, 700)))
    for x in [*odd_texts(), long_text]:
        assert bpe.numbers(own.encode(x or "")).tolist() == library.encode(x or "", add_special_tokens=False).ids
    assert len(own.words) <= 7 and len(own.words.older) <= 7
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Encoder(tokenizer("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    path, rows = tokenizer(name), list(enumerate(odd_texts()))
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(m.encode(x))
    got = {r["doc_id"]: r for r in token_counts.token_counts(spark.createDataFrame(rows, DOCS), path).collect()}
    assert all((got[i]["n_tokens"], got[i]["n_bytes"]) == (count(x or ""), len((x or "").encode())) for i, x in rows)
    assert got[8]["over_limit"] and not got[0]["over_limit"]
    assert token_counts.token_counts(empty(spark), path).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(k, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum((x - 9 if x > 9 else x) for i, c in enumerate(reversed(d)) for x in [int(c) * (1 + i % 2)]) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[k]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_pii_base(spark):
    r = random.Random(3)
    texts = ["", None, "a@b.c", "x a@b..c a@b.c. a@b.c.d_e@f.g", "é1.2.3.4.5.6.7.8 \U0001f600 256.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1111-", "+1 (456) 555-2186 +12",
             "1" * 3000, "a" * 20000, "a@b" + ".c" * 4000, "1 " * 5000, "4111111111111111", "4111111111111111"]
    texts += ["".join(r.choice("ab1234567890 .-@+()é\x01\n") for _ in range(80)) for _ in range(300)] + ["".join(r.choice("a.@-1 ") for _ in range(60)) for _ in range(300)]
    out = {x["doc_id"]: x for x in pii.report(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        base = brute_spans(t)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [out[i][f"n_{k}"] for k in PII] == [sum(b.startswith(k + ":") for b in base) for k in PII]
        assert set(base) <= set(filter(None, out[i]["spans"].split(",")))
    assert pii.report(empty(spark)).count() == 0


def test_pii_bootstraps_from_context(spark):
    rows = [(i, f"please call me +1 (555) 555-{1000 + i} soon") for i in range(30)] + [(100, "please call me 555-0123-456 soon"), (101, "order number 555-0123-999 soon")]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[100]["spans"] == "phone:15:27" and out[100]["n_phone"] == 0 and out[101]["spans"] == ""


def plain_added(texts):
    """The discovered spans by plain loops."""
    base_of = {i: [(list(PII).index(b.split(":")[0]), *map(int, b.split(":")[1:])) for b in brute_spans(t)] for i, t in enumerate(texts)}
    def contexts(t, kind_spans, s, e):
        left = t[max([0] + [y for _, y in kind_spans if y <= s]):s]
        right = t[e:min([len(t)] + [x for x, _ in kind_spans if x >= e])]
        p = re.search(r"(?<!\S)(\S++\s++\S++)\s*+\Z", left, re.A)
        q = re.search(r"\A\S*+\s++(\S++\s++\S++)", right, re.A)
        return (["< " + p[1].lower()] if p else []) + (["> " + q[1].lower()] if q else [])
    links, seeds, free = set(), set(), []
    for i, t in enumerate(texts):
        for k, kind in enumerate(PII):
            own = [m.span() for m in re.finditer(PII[kind], t or "")]
            for kk, s, e in base_of[i]:
                if kk == k:
                    seeds.add((t[s:e], k))
                    links |= {(p, t[s:e]) for p in contexts(t, own, s, e)}
        own = [m.span() for m in re.finditer(pii.INSTANCE, t or "", re.A)]
        for s, e in own:
            if not any(x < e and s < y for _, x, y in base_of[i]):
                m = t[s:e]
                while m and not (m[-1].isalnum() or m[-1] == ")"):
                    m = m[:-1]
                links |= {(p, m) for p in contexts(t, own, s, e)}
                free.append((i, s, m))
    scores = {x: 1.0 for x in seeds}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, _ in links}:
            mine = {m for q, m in links if q == p}
            for k in range(4):
                own = [scores[m, k] for m in mine if (m, k) in scores]
                if len(own) >= pii.SUPPORT and sum(own) / (len(mine) + pii.DOUBT) >= pii.LEAST:
                    sure[p, k] = sum(own) / (len(mine) + pii.DOUBT)
        fresh = {}
        for p, m in links:
            for k in range(4):
                if (p, k) in sure and (m, k) not in seeds:
                    fresh[m, k] = fresh.get((m, k), 1.0) * (1 - min(sure[p, k], 0.999))
        scores = {x: 1.0 for x in seeds} | {x: 1 - v for x, v in fresh.items() if 1 - v >= pii.SURE}
    out = {i: set(base) for i, base in base_of.items()}
    for i, s, m in free:
        out[i] |= {(k, s, s + len(m)) for k, kind in enumerate(pii.KINDS) if (m, k) in scores and (m, k) not in seeds and re.search(pii.SHAPE[kind], m, re.A)}
    return {i: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(x)) for i, x in out.items()}


def test_pii_equals_plain_loops(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(("red", "blue", "green", "old")) for _ in range(n))
    phone = lambda: f"+1 (555) 555-{r.randrange(1000, 9999)}"
    texts = [f"{say(r.randrange(3))} please call me {phone()} or write soon {say(2)}" for _ in range(60)] + [f"then dial {phone()} {say(1)}" for _ in range(10)]
    texts += [f"please call me 555 {r.randrange(100, 999)} {r.randrange(1000, 9999)} any time now {say(1)}" for _ in range(12)]  # groups of digits
    texts += [f"then dial 444-{r.randrange(100, 999)}-{r.randrange(1000, 9999)} any time now" for _ in range(3)]  # found through what was found before
    texts += [f"my mail is ann{i}@site{i}.org thank you all" for i in range(10)] + ["my mail is bob(at)site.org thank you all", "my mail is " + "x" * 300 + "[at]host thank you all", "order no 12345 of a1b2c3d4 " + say(3), "", None]
    got = {x["doc_id"]: x["spans"] for x in pii.report(spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({c: F.lit(1) for c in ("base", "more", "k", "m", "p", "q", "t", "at", "row", "email", "spans")})).collect()}
    expected = plain_added(texts)
    assert got == expected
    assert all("phone" in got[i] for i in range(85)) and "email:11:26" in got[95] and got[96].startswith("email:11:")


def test_pii_in_a_long_text_of_many_matches(spark):
    import time

    text = " ".join(f"a{i}@b{i % 50}.org 10.0.{i % 256}.{i % 200} x" for i in range(8000))
    began = time.time()
    got = pii.report(spark.createDataFrame([(1, text)], DOCS)).first()
    assert (got["n_email"], got["n_ip"]) == (8000, 8000) and got["base_sha256"] == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()
    assert time.time() - began < 90


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "If a train runs 120 km in 3 hours how far does the same train run in 7 hours today"), (2, "short one"), (3, None), (4, ""), (5, "What is 12 times 7?")], "item_id long, text string")
    item = items.first()["text"]
    docs = frame(spark, [
        (1, "noise before. " + item + " and after"), (2, item.replace("120", "90").replace("3 hours", "2 hours")), (3, words(1, 50)), (4, None), (5, ""),
        (6, item.replace("a train", "a slow old boat").replace("the same train", "no other")), (None, item), (7, item), (7, item), (7, "another text"), (8, "a Short One"), (9, "so what is 12 times 7 then"), (10, "what is 13 times 7"),
        (11, " ".join(str(i) for i in range(3000))), (12, item.replace("120", "1 000")), (13, ("word " * 30000) + item)])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1), (8, 2), (9, 5), (12, 1), (13, 1)}
    assert got[1, 1]["verbatim"] and got[8, 2]["verbatim"] and not got[2, 1]["verbatim"]
    twice = spark.createDataFrame([(1, "from 5 km to 5 km the old road goes up and down again")], "item_id long, text string")
    same = spark.createDataFrame([(1, "from 8 km to 8 km the old road goes up and down again"), (2, "from 8 km to 9 km the old road goes up and down again")], DOCS)
    assert [r["doc_id"] for r in decontaminate.leaks(same, twice).collect()] == [1]
    assert decontaminate.leaks(empty(spark), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs.select("doc_id", "text"), items.where("item_id = 1")).collect()} == {3, 4, 5, 6, None, 7, 8, 9, 10, 11}


def test_decontamination_of_rows_that_share_an_id(spark):
    item = "every morning the old farmer feeds 12 hens with corn and asks how long it will last"
    items = spark.createDataFrame([(1, item), (1, "the red boat sails to 7 far islands in a day and comes back at night")], "item_id long, text string")
    docs = [(5, item), (5, "nothing of that kind"), (6, item[:40]), (None, item), (None, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), items).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([docs[1], docs[2], docs[3], docs[4]], DOCS).collect())


def test_decontamination_when_names_and_numbers_grow(spark):
    # a one-word name by a two-word name in the middle: the windows after it lie one token further
    item = "every morning a farmer called Mary feeds 12 hens with 3 kg of corn and asks how many days will 45 kg of corn last for all of them"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("Mary", "Anna Maria Berg").replace("12", "40")), (2, item.replace("a farmer called Mary", "a farmer called Mary from the hills").replace("3 kg", "9 kg")), (3, item.replace("feeds", "keeps").replace("asks how", "wants to know how"))]
    got = {r["doc_id"] for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), items).collect()}
    assert {1, 2} <= got


def plain_tokens(text):
    t = re.sub(r"(?<![^\W\d_])[A-ZÀ-Þ][a-zß-ÿ]+(?![^\W\d_])", r" #a\g<0>~ ", text or "")
    if re.search("[0-9]", t):
        t = re.sub("[0-9][0-9_]*", r" #n\g<0>~ ", re.sub("(?<=[0-9])[.,](?=[0-9])", "_", t))
        t = re.sub(r"#n([0-9_]+)~ +(" + "|".join(decontaminate.UNITS) + r")(?![^\W\d_])", r"#q\1_\2~", t)
    t = re.sub(r"~[^\w#~]*#[anq]", "_", t).lower()
    return [x for x in re.split(r"[^\w#]+", t) if x]


def plain_leaks(docs, items):
    width, out = decontaminate.WIDTH, set()
    kind = lambda x: x[:2] if x[0] == "#" else x
    for i, item in items:
        ti = plain_tokens(item)
        typed = len(ti) >= width
        cut = plain_tokens if typed else lambda x: re.findall(r"[^\W_]+", x.lower())
        show, ti = kind if typed else str, cut(item)
        w = min(width, len(ti))
        for d, doc in docs:
            td = cut(doc)
            hits = {(q, a - q) for q in range(len(ti) - w + 1) for a in range(len(td) - w + 1) if w and list(map(show, ti[q:q + w])) == list(map(show, td[a:a + w]))}
            groups = {}
            for q, shift in hits:
                for key in (("s", shift), ("a", shift // 16), ("b", (shift + 8) // 16)):
                    groups.setdefault(key, {}).setdefault(q, []).append(shift)
            for own in groups.values():
                if len(own) < decontaminate.COVER * (len(ti) - w + 1):
                    continue
                pairs = {(ti[q + j] if typed else "", td[q + j + min(own[q])]) for q in own for j in range(w)}
                slots = {p for p in pairs if p[0][:1] == "#"}
                literals = {q + j for q in own for j in range(w) if ti[q + j][0] != "#"}
                if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}) and (len(literals) >= decontaminate.LITERALS or all(a == b for a, b in slots)):
                    out.add((d, i))
    return out


def test_decontamination_equals_plain_loops(spark):
    r = random.Random(11)
    def text(n):
        pick = lambda: r.choice(("the", "man", "buys", "red", "apples", "in", "and", "sells", str(r.randrange(5)), "Tom", "Ann Lee", "3 kg", "with", "on", "a", "day"))
        return " ".join(pick() for _ in range(n))
    items = [(i, text(r.choice((1, 2, 5, 9, 14, 25)))) for i in range(25)]
    docs = []
    for d in range(60):
        own = r.choice(items)[1]
        if r.random() < 0.5:
            own = own.replace("Tom", "Joe Ray").replace("1", "77")
        if r.random() < 0.3:
            own = own.replace("buys", "buys some")
        docs.append((d, text(r.randrange(12)) + " " + own + " " + text(r.randrange(12))))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = plain_leaks(docs, items)
    assert got == expected and len(got) > 30


def test_quality(spark):
    good = [(i, words(i, 80, 60), "en") for i in range(60)]
    junk = [(100 + i, words(i, 80, 60).upper().replace(" ", "!! "), "en") for i in range(10)]
    rest = [(200, None, "en"), (201, "", None), (202, words(500, 80, 60), None), (None, words(501, 80, 60), "en"), (203, words(502, 4000, 60), "en")]
    docs = spark.createDataFrame(good + junk + rest, "doc_id long, text string, lang string").withColumn("row", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(good + junk + rest)
    assert sum(got[i]["kept"] for i in range(60)) >= 58 and not any(got[100 + i]["kept"] for i in range(10))
    assert not got[200]["kept"] and not got[201]["kept"] and got[202]["kept"] and got[203]["kept"] and got[None]["kept"]
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert sum(r["kept"] for r in quality.classify(docs, labels.limit(0)).collect()) == len(got) - 2


def test_quality_rejects_marked_documents(spark):
    # fluent documents that are labelled bad or toxic, and one whose label contradicts itself
    docs = spark.createDataFrame([(i, words(i, 80, 60), "en") for i in range(44)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(41)] + [(40, 0, 0), (41, 0, 0), (42, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.classify(docs, labels).collect() if not r["kept"]} == {40, 41, 42}


def test_quality_equals_a_plain_model(spark):
    """Perplexities of the joins against the formulas written out."""
    texts = [(i, words(i, 30, 12)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").withColumns({"row": F.col("doc_id"), "key": F.col("doc_id")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    old = quality.HEAD
    try:
        got = {}
        for quality.HEAD in (old, 5):
            got[quality.HEAD] = {r["doc_id"]: r["log_ppl"] for r in quality.perplexities(docs, labels).collect()}
    finally:
        quality.HEAD = old
    from collections import Counter

    split = {i: ["<>", *t.split(), "<>"] for i, t in texts}
    c = Counter(b for i in range(8) for b in zip(split[i], split[i][1:]))
    def cuts(counts):
        n = [sum(v == k for v in counts) for k in range(5)]
        if not (n[1] and n[2]):
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k, 0.05), k - 0.05) for k in (1, 2, 3)]
    d, cont = cuts(list(c.values())), Counter(v for _, v in c)
    e = cuts(list(cont.values()))
    cut = lambda d, n: d[min(n, 3) - 1]
    total = sum(cont.values())
    p1 = lambda v: (cont[v] - cut(e, cont[v]) if v in cont else 0) / total + sum(cut(e, k) for k in cont.values()) / total / quality.WIDTH
    cu, gu = Counter(), Counter()
    for (u, v), n in c.items():
        cu[u] += n
        gu[u] += cut(d, n)
    for i, t in split.items():
        s = sum(np.log((c[u, v] - cut(d, c[u, v]) if (u, v) in c else 0) / cu[u] + gu[u] / cu[u] * p1(v)) for u, v in zip(t, t[1:]))
        for h in got:
            assert got[h][i] == pytest.approx(-s / (len(t) - 1))


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)) * rng.uniform(0.5, 2, (400, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[20][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (2005, []), (2006, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, "id % 20 = 0", 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ok = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit += len({ids[i] for i in order} & {v for v, _ in got[q].values()})
        n += 20
        assert sorted(got[q]) == list(range(1, 21))
        scores = [got[q][k][1] for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
    assert set(got) == set(ids[ids % 20 == 0]) and hit / n >= 0.9
    assert neighbours.nearest(df.limit(0), "id % 20 = 0", 20).count() == 0
    few = neighbours.nearest(df.where("vec_id < 5"), "id = 0", 20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_neighbours_of_many_vectors_in_many_blocks(spark, monkeypatch, kind, tmp_path):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20000, 24))
    if kind == "clusters":  # a third of the rows in one tight group, lengths that differ
        x = rng.standard_normal((400, 24))[rng.integers(0, 400, 20000)] + 0.25 * x
        x[::3] = x[1] + 0.01 * rng.standard_normal((len(x[::3]), 24))
        x *= rng.uniform(0.8, 1.2, (20000, 1))
    x = x.astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(range(20000), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    asked, old = [], neighbours.blocks_of
    def watched(leaves):
        found = old(leaves)
        asked.append(found[1].agg(F.max(F.col("block")), F.max("parts")).first())
        return found
    monkeypatch.setattr(neighbours, "blocks_of", watched)
    got = neighbours.nearest(spark.read.parquet(str(tmp_path)), "id % 200 = 0", 20).toPandas()
    assert asked[0][0] > 0 and (kind == "noise" or asked[0][1] > 1)
    x, q = x.astype(float), np.arange(0, 20000, 200)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :20]
    pairs = set(zip(got["query_id"], got["vec_id"]))
    assert len(got) == 2000 and sum((i, t) in pairs for i, row in zip(q, top) for t in row) >= 0.9 * top.size
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 * max(1, abs(r.score)) * 100 for r in got.itertuples())


def test_language(spark):
    text = {"en": "the cat and the dog went with them to the house that they had", "de": "der hund und die katze gingen mit ihnen in das haus das sie hatten", "fr": "le chat et le chien sont venus avec eux dans la maison que nous avons"}
    labelled = spark.createDataFrame([(i, t, l) for l, t in text.items() for i in range(5)] + [(9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string")
    page = lambda l, t: f'<html lang="{l}"><script>the the the</script><body><p>{t}</p></body></html>'
    rows = [(1, "http://a.example.de/x", page("de", text["de"])), (2, "https://a.example.de", page("en", text["de"] * 3)), (3, "http://b.example.fr:80/", page("fr", "")), (4, None, None), (5, "no address", text["en"]), (5, "no address", text["en"]), (None, "http://u@c.com", page("xx", text["en"]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("zz"))
    out = language.identify(pages, labelled).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 7 and [got[i]["lang"] for i in (1, 2, 3, 5, None)] == ["de", "de", "fr", "en", "en"]
    assert got[2]["declared"] == "en" and got[3]["host"] == "b.example.fr" and got[4]["host"] == "" and got[None]["declared"] == "other"
    assert language.identify(pages.limit(0), labelled).count() == 0
    assert {r["lang"] for r in language.identify(pages, labelled.limit(0)).collect()} == {None}


def plain_language(pages, docs):
    """The same fusion written out: one page after the other, in plain Python."""
    def grams(text):
        d = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
        mul = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
        return [sum(c * k for c, k in zip(d[i:i + 3], mul)) % 2 ** 32 >> 18 for i in range(len(d) - 2) if d[i + 1] > 32]
    langs = sorted({x for _, x in docs})
    logs = []
    for lang in langs:
        c = np.full(language.BINS, 0.5)
        for t, x in docs:
            if x == lang:
                np.add.at(c, grams(t), 1)
        logs.append(np.log(c / c.sum()))
    rows = []
    for i, url, html in pages:
        m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        code = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", html or "")
        code = code[1].lower() if code else "none"
        text = re.sub(r"&[A-Za-z0-9#]{1,10};", " ", re.sub(r"(?is)<(script|style|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or ""))
        g = grams(text)
        x = np.array([row[g].sum() for row in logs]) * language.TEMPER * min(len(g), language.MOST / language.TEMPER) / max(len(g), 1)
        x -= x.max()
        rows.append((i, host, host.rsplit(".", 1)[-1], code if code in langs or code == "none" else "other", x, np.exp(x) / np.exp(x).sum()))
    total = sum(r[5] for r in rows)
    prior = (total + 1) / (total.sum() + len(langs))
    def smoothed(own, above, weight):
        return (own + weight * above) / (own.sum() + weight)
    out = {}
    for i, host, suffix, code, x, share in rows:
        by_suffix = smoothed(sum(r[5] for r in rows if r[2] == suffix), prior, language.SUFFIX_WEIGHT)
        by_host = smoothed(np.maximum(sum(r[5] for r in rows if r[1] == host) - share, 0), by_suffix, language.HOST_WEIGHT)
        says = sum(r[5] for r in rows if r[3] == code) + np.where(np.array(langs) == code, language.HONEST, language.OTHERWISE)
        says = np.log(says / (total + language.HONEST + language.OTHERWISE * (len(langs) + 1)))
        score = x + says + np.log(by_host)
        p = np.exp(score - score.max())
        out[i] = (langs[int(score.argmax())], float(p.max() / p.sum()))
    return out


def test_language_equals_a_plain_fusion(spark):
    # 70 languages, hosts with few and many pages, one very long page
    r = random.Random(2)
    names = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]
    vocab = {x: ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(12)] for x in names}
    say = lambda x, n: " ".join(r.choice(vocab[x]) for _ in range(n))
    docs = [(say(x, 40), x) for x in names for _ in range(2)]
    pages = [(i, f"http://h{r.randrange(8)}.{r.choice(('aa', 'bb'))}/{i}", f'<html lang="{r.choice(names + ["zz"])}"><b>{say(r.choice(names), r.choice((0, 3, 30)))}</b> &amp; x') for i in range(120)]
    pages += [(120, None, None), (121, "http://h1.aa/", "<p>" + say("ak", 40000)), (122, "http://h1.aa/", "<p>")]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    expected = plain_language(pages, docs)
    assert len(got) == len(pages) and len({x["lang"] for x in got}) > 20
    for x in got:
        lang, p = expected[x["page_id"]]
        assert x["probability"] == pytest.approx(p, rel=2e-3, abs=1e-6) and (x["lang"] == lang or p < 0.6)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    held = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"), F.col("lang").alias("true"))
    out = language.identify(held, docs.where("doc_id % 5 <> 0")).join(held.select("page_id", "true"), "page_id").agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0]
    assert out > 0.97


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    from oracle import connection, difference

    assert difference(queries()[name](spark, SF), oracle_sql()[name], connection(SF)) == ""


def test_queries_run_on_whole_tables(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    q = queries()
    assert q["op2_language_id"](spark, SF).count() == n["pages"]
    assert q["op8_pii"](spark, SF).count() == n["documents"]
    assert 0 < q["op7_quality"](spark, SF).count() < n["documents"]
