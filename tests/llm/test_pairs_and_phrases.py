"""SimHash classes, spelling variants and phrases against brute force, and on nulls, empty texts, ties, repeats and clashing columns."""
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import pyarrow as pa
import pytest
import xxhash
from oracle import connection, difference
from pyspark.sql import functions as F

from cellgrove.llm import common, decontaminate, line_dedup, phrases, simhash, spelling, token_counts
from cellgrove.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """With extra columns whose names clash with results and inner columns."""
    df = spark.createDataFrame([(*r, "en")[:3] for r in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("print", "key", "word", "n", "form", "phrase", "f", "a", "score", "rank", "component_id", "run", "h")})


def text(seed, n, size=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.mark.parametrize("name", ["op12_spelling", "op13_phrases"])
def test_query_equals_twin(spark, name):
    assert difference(queries()[name](spark, SF), oracle_sql()[name], connection(SF)) == ""


# SimHash

def brute_print(t):
    w, cut = [], ""
    for c in (t or ""):
        if c in " \t\n\x0b\x0c\r":
            w, cut = w + [cut] * bool(cut), ""
        else:
            cut += c
    w = [x.translate(LOW) for x in w + [cut] * bool(cut)]
    shingles = [" ".join(w[i:i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), f"{p:016x}", str(least.get(find(i)))) for i, (r, p) in enumerate(zip(rows, prints)))


def near_texts():
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two\tTHREE"), (6, "one two three"), (7, "é ü x  y é \xa0z ü"), (None, "one"), (None, "alone here"), (9, text(9, 40000, 3000)), (9, "shares an id"), (10, text(9, 40000, 3000) + " tail")]
    for k in range(12):
        base = text(100 + k, 120 + 40 * k).split()
        for j in range(6):
            w = list(base)
            w[(17 * j) % len(w)] = f"x{j}" if j else w[0]
            rows.append((20 + 10 * k + j, " ".join(w)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_texts()
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert len({c for *_, c in got}) < len(rows) - 20  # there are groups


def test_shingles_are_hashed_as_the_engine_hashes_strings(spark):
    got = spark.sql("SELECT xxhash64('one two three four') AS h").first()["h"] & ((1 << 64) - 1)
    assert simhash.fingerprints_of(pa.array(["one two THREE four"]))[0] == got == brute_print("One two three four")


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_links_connect_what_is_near(spark, crowd):
    r = random.Random(5)
    prints = set()
    for _ in range(25):
        base = r.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(12)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    got = {frozenset((x["src"], x["dst"])) for x in simhash.links(rows, crowd=crowd).collect()}
    true = {frozenset((signed(a), signed(b))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4}
    assert got <= true and (crowd < 10_000 or got == true)

    def parts(edges):
        root = {signed(p): signed(p) for p in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for e in edges:
            a, b = e
            root[find(a)] = find(b)
        return Counter(frozenset(k for k in root if find(k) == c) for c in {find(k) for k in root})

    assert parts(got) == parts(true)


def test_links_of_crowded_prints_are_code_that_compiles(spark):
    key, before = "spark.sql.codegen.fallback", spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set(key, "false")  # else Spark tries, at the cost of the driver's memory, and goes on without
    try:
        rows = spark.createDataFrame([(1 << i,) for i in range(8)], "print long")
        assert {x["src"] for x in simhash.links(rows, crowd=0).collect()} == {1 << i for i in range(1, 8)}
    finally:
        spark.conf.set(key, before)


def test_simhash_stores_few_tables_and_marks_none(spark):
    rows = [(i, text(i // 3, 60) + " x" * (i % 3)) for i in range(60)]
    with common.intermediates(spark) as path:
        assert simhash.classes(frame(spark, rows)).count() == 60
        found = list(Path(path.removeprefix("file:")).rglob("*"))
    # the driver forks for each table and for each mark
    assert found and not [p for p in found if "_SUCCESS" in p.name or p.name.startswith(("least-", "links-"))]


def test_simhash_of_nothing(spark):
    assert simhash.classes(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).select(F.col("id").alias("print")), budget=3)


# spelling

def brute_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = sorted((a, b), key=len)
        return len(t) - len(s) == 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))

    return {(a, b) for a, b in combinations(sorted(words), 2) if near(a, b)}


@pytest.mark.parametrize("long", [3, 5, 64])
def test_near_pairs_equal_brute_force(spark, long):
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))) for _ in range(400)} | {"a" * n for n in (63, 64, 65, 66)} | {"a" * 30 + "b" + "a" * 34, "x" * 500, "x" * 499 + "y", "x" * 250 + "y" + "x" * 250}
    got = [(x["a"], x["b"]) for x in spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), long).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(words)


def brute_groups(rows):
    count = Counter()
    for d, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "ÿ":
                run += c.translate(LOW)
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                at = h % len(run)
                count[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
            run = ""
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [] for w in n}
    for a, b in brute_near(n):
        near[a].append(b), near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def test_spelling_groups_equal_brute_force(spark):
    r = random.Random(11)
    base = ["".join(r.choice("aeioubcdé") for _ in range(r.randrange(5, 12))) for _ in range(30)] + ["mississippi", "ELÈVE", "naïveté"]
    rows = [(1, None), (2, ""), (3, "12 ... Δ"), (None, "Spelling spelling spelling speling"), (4, "abcde abcde abcde abcdx abcdx abcdx"), (8, "quorum " * 20 + "quorun " * 9 + "quoran " * 4), (5, "ab" * 3000 + " end"), (6, "ab" * 3000), (7, "ab" * 3000 + "a " + ("ab" * 3000 + "a ") * 7)]
    for d in range(300):
        w = [base[min(int(r.expovariate(0.15)), len(base) - 1)] for _ in range(40)]
        for i in range(40):
            if r.random() < 0.15:
                at = r.randrange(len(w[i]))
                w[i] = w[i][:at] + r.choice(["", "x", w[i][at] * 2]) + w[i][at + 1:]
        rows.append((d % 290 + 10, " ".join(w).title() if d % 3 else "×".join(w)))
    got = sorted(((x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.groups(frame(spark, rows)).collect()), key=str)
    assert got == brute_groups(rows)
    assert any(w[1] is not None and w[1] != w[2] for w in got)  # forms of forms
    assert spelling.groups(frame(spark, [])).count() == 0


# phrases

def brute_phrases(rows, max_n, least, first):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang, piece, pieces = "und" if lang is None else lang, "", []
        for c in (t or "") + ".":
            if c in ".,;:!?\n\x0b\x0c\r":
                pieces, piece = pieces + [piece], ""
            else:
                piece += c.translate(LOW)
        for p in pieces:
            w = [x for x in p.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    cand = {(l, p): a for (l, p), a in f.items() if len(p) > 1 and a >= least}
    rows = []
    for (l, p), a in cand.items():
        if any(k == l and len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (k, q), b in cand.items()):
            continue
        cuts = [(int(Fraction(1000000 * a * a, f[l, p[:k]] * f[l, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((l, -score, -a, " ".join(p).encode(), f[l, p[:k]], f[l, p[k:]], n[l]))
    out, seen = [], Counter()
    for l, score, a, p, left, right, total in sorted(rows):
        seen[l] += 1
        if seen[l] <= first:
            out.append((l, seen[l], p.decode(), -a, left, right, total, -score))
    return out


@pytest.mark.parametrize("max_n,least,first,bits", [(3, 3, 2000, 25), (4, 2, 15, 7), (2, 5, 2000, 20), (4, 4, 2000, 25)])
def test_phrases_equal_brute_force(spark, max_n, least, first, bits):
    r = random.Random(7)
    parts = ["new york city", "the  of", "big\tred dog", "New York", "a a a", "été là", "x", "und so weiter", "\xa0 q\xa0r"]
    rows = [(1, None, "en"), (2, "", None), (3, " ., ;\n", "en"), (4, "a " * 60, "xx"), (4, "a " * 60, "xx")]
    rows += [(d, "".join(r.choice(parts) + r.choice([" ", " ", " ", ".", ", ", "\n"]) for _ in range(30)), r.choice(["en", "de", None, "und"])) for d in range(60)]
    got = [tuple(x) for x in phrases.collocations(frame(spark, rows), max_n, least, 50, first, bits).orderBy("lang", "rank").collect()]
    assert got == brute_phrases(rows, max_n, least, first)
    assert phrases.collocations(frame(spark, []), max_n).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_long_texts_are_cut_between_phrases(spark, n):
    r = random.Random(n)
    long = "".join(r.choice(["alpha", "b", "c,", "dd.", "x" * 300, "é"]) + r.choice([" ", "  ", "\t", " \n"]) for _ in range(4000))
    docs = frame(spark, [(1, long), (2, "short text"), (3, long.replace(" ", ""))])
    whole, cut = ({tuple(x) for x in phrases.ngrams(docs, n, size).groupBy("lang", "phrase").agg(F.sum("c")).collect()} for size in (1 << 30, 200))
    assert whole == cut and len(whole) > 5


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_990
    got = spark.createDataFrame([(a, l, r), (3, 7, 11)], "a long, l long, r long").select(phrases._floor_ratio(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [x["s"] for x in got] == [1000000 * a * a // (l * r), 1000000 * 9 // 77]


# lines

def test_short_blocks_of_lines_are_found(spark):
    r = random.Random(2)
    line = lambda: " ".join(str(r.randrange(10 ** 6)) for _ in range(6))
    shares = {}
    for n in (3, 5, 12):
        rows = []
        for k in range(100):
            block = [line() for _ in range(n)]
            rows += [(2 * k, "\n".join([*(line() for _ in range(15)), *block, *(line() for _ in range(10))])), (2 * k + 1, "\n".join([*(line() for _ in range(9)), *block, *(line() for _ in range(14))]))]
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(x["n_removed"] == 0 for x in got if x["doc_id"] % 2 == 0)
        shares[n] = sum(x["n_removed"] for x in got) / (100 * n)
    assert shares[3] > 0.35 and shares[5] > 0.6 and shares[12] > 0.8


def test_lines_of_rows_that_share_an_id(spark):
    block = "\n".join(text(i, 6) for i in range(9))
    rows = [(1, block), (7, "first line\n" + block), (7, "\n".join(text(100 + i, 6) for i in range(12))), (8, block + "\n" + block), (None, block)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((str(r["doc_id"]), r["n_removed"], r["text"]) for r in got)
    assert [x for x in left if x[0] == "7"][0][1:] == (0, rows[2][1]) and [x for x in left if x[0] == "7"][1][1] >= 7
    assert ("1", 0, block) in left and ("None", 0, block) in left and [x[1] for x in left if x[0] == "8"][0] >= 16


def test_first_of_equal_lines_stays(spark):
    r = random.Random(4)
    lines = [f"line {i}" for i in range(6)]
    rows = [(d, "\n".join(r.choice(lines) for _ in range(40))) for d in range(30)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for t in got.values() for x in t.split("\n")} >= set(lines) and got[0].split("\n")[0] == rows[0][1].split("\n")[0]


# short benchmark items

def test_short_items_of_other_values(spark):
    items = spark.createDataFrame([(1, "What is 12 times 7?"), (2, "it sails 5 km then 5 km"), (3, "Of 9"), (4, "the"), (5, "plain words only here")], "item_id long, text string")
    docs = [(1, "Asked. What is 13 times 7? Who knows"), (2, "What is 13 times 13?"), (3, "so it sails 8 km then 8 km now"), (4, "so it sails 8 km then 9 km now"), (5, "Of 10 men"), (6, "it is the end"), (7, "so plain words only here it says"), (8, "What is twelve times 7?")]
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): False, (3, 2): False, (6, 4): True, (7, 5): True}
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert left.count() == len(docs)  # items of so few words remove nothing
    assert {r["doc_id"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items, 4).collect()} == {2, 4, 5, 6, 8}


# token counts

def test_texts_with_rare_blanks_are_cut_safely(spark):
    from tokenizers import Tokenizer

    from cellgrove.llm.queries import tokenizer

    path = tokenizer("byte_bpe_50k.json")
    model, r = Tokenizer.from_file(path), random.Random(1)
    some = [" ", "  ", "\xa0", "\u3000", "\x0b", "\x1c", "\x85", "\n", "\t", "a", "word", "é", "...", "12", "don't", "\u2003", "<|endoftext|>", "'s", "字"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(1, 30))) for _ in range(3000)] + [("word \xa0 " * 20000), "x\xa0" * 20000, "\x1c" * 50, " \xa0" * 50]
    count = token_counts.piece_counter(path)
    assert count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = spark.createDataFrame([(1, "many words here " * 3000 + "\xa0 end"), (2, "\xa0")], "doc_id long, text string")
    assert {x["doc_id"]: x["n_tokens"] for x in token_counts.token_counts(rows, path).collect()} == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in ((1, "many words here " * 3000 + "\xa0 end"), (2, "\xa0"))}
