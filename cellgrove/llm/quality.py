"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, over its whole vocabulary.

1. Trusted text is all documents labelled good and not toxic.  Their ids are
   broadcast only up to a checked number; beyond it a join is shuffled.
2. Every word of trusted text is a word of the model, by a hash of 64 bits.  A word
   that trusted text lacks has the share of its class (its letters and last sign) in
   what is held back for unseen words: as many words of that class as stand in one
   context only.
3. Bigrams of all trusted text are counted once, for the two halves of the texts
   apart, which gives three models: of all, and of each half.  The discounts come from
   counts of counts, each context's weight from its bigrams, each word's continuation
   probability from grouped counts.
4. Every document is scored whole.  The ``HEAD`` most frequent words and bigrams (a
   stated parameter) are scored in the task; the rest, the long tail that grows with
   the corpus, meets its values in joins sharded by word and bigram, in
   rounds that bound what is on disk.  A bit table of fixed size holds back words and
   bigrams that no model has; a full one lets more through, and results stay.  So no
   frequent bigram is a hot key, and nothing that grows is broadcast.
5. A document passes if its perplexity is at most the ``QUANTILE`` of trusted
   documents in its language (of all, where a language has none), each half of
   them scored by a model of the other, as a model's own text looks too easy.
6. A document labelled bad or toxic is rejected whatever its perplexity.

Defined cases: texts that are null, empty or without words are rejected, having
no evidence; a null language is a language of its own; rows with a null id are
scored, but never trusted; labels that contradict each other count as bad; of
rows that share an id each is scored alone; other columns are ignored; empty
labels trust nothing and so reject nothing that has words; an empty table gives
an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import BROADCAST_IDS, Words, forget, forget_others, plain, signed, slices, stored

HEAD = 65536
#: Rounds by key and by document: they bound what is on disk at once.  SLICES is a power of two.
SLICES, PARTS = 4, 2
#: Classes of unseen words; words that there may be: each has an equal share of a hair of what is held back.
CLASSES, WIDTH = 64, 1 << 32
#: The word before the first and after the last.
EDGE = 0x5EED0FED6E
QUANTILE = 0.99
#: The bit table has two to this power of bits (16 MB), whatever it is made from; parts of 65,536 bits are made in tasks.
BITS, PART = 27, 16
#: Models by what they are made from: all trusted text, the texts of half 0, of half 1.
MODELS = ("a", "0", "1")
#: Blanks of ``str.split`` that are not blanks of ``Words``.
BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def word_class(word: str) -> int:
    """0..63: case (2 bits), digits, other signs inside, kind of the last sign (2 bits)."""
    core = word.rstrip(".,;:!?\"')]}")
    last = word[len(core):len(core) + 1]
    case = 3 if len(core) > 1 and core.isupper() else 2 if core[:1].isupper() else 1 if core[:1].islower() else 0
    return case + 4 * any(c.isdigit() for c in core) + 8 * (not core.isalnum()) + 16 * (0 if not last else 1 if last in ".," else 2 if last in "!?" else 3)


#: What a byte is: an upper- or lower-case letter, a digit, a sign, no ASCII; a sign that ends words.
UPPER, LOWER, DIGIT, SIGN, OTHER, END = 1, 2, 4, 8, 16, 32
KINDS = np.array([OTHER if i > 127 else UPPER if chr(i).isupper() else LOWER if chr(i).islower() else DIGIT if chr(i).isdigit() else SIGN | END * (chr(i) in ".,;:!?\"')]}") for i in range(256)], np.uint8)
#: The kind of a last sign in a class.
LAST = np.array([1 if chr(i) in ".," else 2 if chr(i) in "!?" else 3 for i in range(256)])


class Classes:
    """``word_class`` of words of ASCII at once; those of others are remembered by their hashes."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def __call__(self, texts: pa.Array, words: Words, at: np.ndarray) -> np.ndarray:
        """The class of each word at ``at``."""
        if not len(at):
            return np.zeros(0, np.int64)
        if len(self.known) > 200_000:
            self.known.clear()
        begin = np.frombuffer(texts.buffers()[1], np.int32, 1, texts.offset * 4)[0]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:]
        start, size = words.start[at], words.end[at] - words.start[at]
        bound = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(bound, size)
        kind = KINDS[data[place + np.repeat(start, size)]]
        core = np.maximum.reduceat(np.where(kind & END, 0, place + 1), bound)
        has = np.bitwise_or.reduceat(np.where(place < np.repeat(core, size), kind, kind & OTHER), bound)
        first = np.where(core > 0, KINDS[data[start]], 0)
        case = np.where((core > 1) & (has & UPPER > 0) & (has & LOWER == 0), 3, np.where(first & UPPER, 2, np.where(first & LOWER, 1, 0)))
        last = np.where(core < size, LAST[data[np.minimum(start + core, len(data) - 1)]], 0)
        out = case + 4 * (has & DIGIT > 0) + 8 * ((has & SIGN > 0) | (core == 0)) + 16 * last
        for i in np.flatnonzero(has & OTHER):
            h = int(words.hash[at[i]])
            c = self.known.get(h)
            if c is None:
                c = self.known[h] = word_class(data[start[i]:start[i] + size[i]].tobytes().decode())
            out[i] = c
        return out


def blanked(texts: pa.Array) -> pa.Array:
    """Texts with a space for each rare blank."""
    return plain(pc.replace_substring_regex(texts, BLANKS, " ")) if pc.any(pc.match_substring_regex(texts, BLANKS)).as_py() else texts


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, second word) of all bigrams, with an edge before and after each text that has words."""
    n = words.count
    flat = np.full(int((n + 1).sum()) + 1, EDGE, np.uint64)
    flat[np.arange(len(words.hash)) + words.doc + 1] = words.hash
    doc, real = np.repeat(np.arange(len(n)), n + 1), np.repeat(n > 0, n + 1)
    return doc[real], flat[:-1][real], flat[1:][real]


def _hash_long(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of a long column (fixed constants)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda y, k: (y << np.uint64(k)) | (y >> np.uint64(64 - k))
    h = (seed + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The key of bigrams: ``xxhash64(u, v)`` of Spark."""
    return _hash_long(v, _hash_long(u, np.full(1, 42, np.uint64)))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with their half, null where they are not trusted; equal texts are in one half."""
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0").select("_good")
    good = stored(good, "trusted")
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good.hint("merge")
    docs = docs.join(side, F.col("doc_id") == F.col("_good"), "left")
    return docs.withColumn("half", F.when(F.col("_good").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))).drop("_good")


def bigrams(texts: DataFrame) -> DataFrame:
    """(u, v, c0, c1, cls, first, n1.., n2.., n3.., s..): how often each bigram stands in texts of each half, with what its context has in each model.

    cls: class of u; first: one row of each context; n1, n2, n3: bigrams of the
    context that stand once, twice, more often; s: the sum of their counts.
    """
    def count(batches):
        forget_others()
        classes, held, size = Classes(), [], 0
        for b in batches:
            t = blanked(plain(b.column(1)))
            half = b.column(0).to_numpy(zero_copy_only=False)
            for at, m in slices(t):
                part = t.slice(at, m)
                words = Words(part)
                doc, u, v = sequence(words)
                one, first = np.unique(words.hash, return_index=True)
                known = dict(zip(one.tolist(), classes(part, words, first).tolist()))
                known[EDGE] = -1
                key, first, where = np.unique(pair(u, v), return_index=True, return_inverse=True)
                c = [np.bincount(where, weights=half[at:at + m][doc] == h, minlength=len(key)).astype(np.int32) for h in (0, 1)]
                u = u[first]
                one, at_one = np.unique(u, return_inverse=True)
                held.append((key, u, v[first], *c, np.array([known[h] for h in one.tolist()], np.int32)[at_one]))
                size += len(key)
                if size > 1_000_000:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    def summed(held):
        key, u, v, c0, c1, cls = (np.concatenate(x) for x in zip(*held))
        key, first, where = np.unique(key, return_index=True, return_inverse=True)
        c0, c1 = (np.bincount(where, weights=c, minlength=len(key)).astype(np.int32) for c in (c0, c1))
        return pa.RecordBatch.from_arrays([pa.array(signed(u[first])), pa.array(signed(v[first])), pa.array(c0), pa.array(c1), pa.array(cls[first])], ["u", "v", "c0", "c1", "cls"])

    def merge(batches):
        """Of rows sorted by u; a context's rows may lie in many batches."""
        held, size = [], 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size > 200_000 and b.num_rows and held[0][0][0] != held[-1][0][-1]:
                rows = [np.concatenate(x) for x in zip(*held)]
                end = int(np.searchsorted(rows[0], rows[0][-1]))
                yield merged(*(x[:end] for x in rows))
                held = [[x[end:] for x in rows]]
                size = len(held[0][0])
        if size:
            yield merged(*(np.concatenate(x) for x in zip(*held)))

    def merged(*rows):
        order = np.lexsort((rows[1], rows[0]))
        u, v, c0, c1, cls = (x[order] for x in rows)
        at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        u, v, cls, c0, c1 = u[at], v[at], cls[at], np.add.reduceat(c0, at), np.add.reduceat(c1, at)
        first = np.concatenate([[True], u[1:] != u[:-1]])
        at = np.flatnonzero(first)
        rows = np.diff(np.append(at, len(u)))
        of_context = []
        for c in (c0 + c1, c0, c1):
            of_context += [np.repeat(np.add.reduceat(x.astype(np.int64), at), rows) for x in (c == 1, c == 2, c > 2, c)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, c0.astype(np.int32), c1.astype(np.int32), cls, first, *of_context)], ["u", "v", "c0", "c1", "cls", "first", *names])

    names = [f"{n}{j}" for j in MODELS for n in ("n1", "n2", "n3", "s")]
    counted = texts.select("half", "text").mapInArrow(count, "u long, v long, c0 int, c1 int, cls int")
    kinds = "u long, v long, c0 int, c1 int, cls int, first boolean, " + ", ".join(f"{n} long" for n in names)
    return stored(counted.repartition("u").sortWithinPartitions("u").mapInArrow(merge, kinds), "bigrams")


def discounts(n) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from the number of counts 1 to 4."""
    n = [0, *map(float, n)]
    if not (n[1] and n[2]):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def cut(c, d: list[float]):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def count_of(j: str):
    return F.col("c0") + F.col("c1") if j == "a" else F.col(f"c{j}")


def model(texts: DataFrame):
    """(what ``bigrams`` stored, bigrams, words, log share of each class): values of each model, null where it lacks the bigram or word.

    bigrams (key, v, c, x..): x is what a bigram has over its context's weight.
    words (w, cls, n, p.., s..): p is the continuation probability, s the logarithm of
    p and of the word's weight as a context, which is all that unseen bigrams have.
    """
    counts = bigrams(texts)
    n = counts.agg(*(F.count_if(count_of(j) == i).alias(f"{j}{i}") for j in MODELS for i in range(1, 5))).first()
    d = {j: discounts([n[f"{j}{i}"] for i in range(1, 5)]) for j in MODELS}
    contexts = counts.where("first").drop("v", "c0", "c1", "first").withColumnRenamed("u", "w")
    words = counts.groupBy(F.col("v").alias("w")).agg(*(F.count_if(count_of(j) > 0).alias(f"k{j}") for j in MODELS))
    words = stored(words.join(contexts, "w"), "words")
    k = lambda j: F.col(f"k{j}")
    n = words.agg(*(F.count_if(k(j) == i).alias(f"{j}{i}") for j in MODELS for i in range(1, 5)), *(x for j in MODELS for x in (F.sum(k(j)).alias(f"t{j}"), F.count_if(k(j) > 2).alias(f"m{j}"), F.count_if(k(j) > 0).alias(f"v{j}")))).first()
    once = words.where("cls >= 0").groupBy("cls").agg(*(F.count_if(k(j) == 1).alias(j) for j in MODELS)).collect()  # a row for each class
    p, s, shares = {}, {}, []
    for j in MODELS:
        e, total = discounts([n[f"{j}{i}"] for i in range(1, 5)]), float(n[f"t{j}"] or 1)
        held = ((e[0] * n[f"{j}1"] + e[1] * n[f"{j}2"] + e[2] * n[f"m{j}"]) or total) / total
        share = np.ones(CLASSES)
        for r in once:
            share[r["cls"]] += r[j]
        shares.append(np.log(share / share.sum() * held * max(1 - n[f"v{j}"] / WIDTH, 0.5)))
        p[j] = F.when(k(j) > 0, (k(j) - cut(k(j), e)) / total + held / WIDTH)
        s[j] = F.ln(F.col(f"p{j}")) + F.ln(left_over(j, d[j]) / F.col(f"s{j}"))
    words = words.withColumns({f"p{j}": p[j] for j in MODELS})
    words = words.select("w", "cls", F.col("sa").alias("n"), *(f"p{j}" for j in MODELS), *(s[j].alias(f"s{j}") for j in MODELS))
    x = [F.when(count_of(j) > 0, (count_of(j) - cut(count_of(j), d[j])) / left_over(j, d[j])).alias(f"x{j}") for j in MODELS]
    return counts, counts.select(F.xxhash64("u", "v").alias("key"), "v", count_of("a").alias("c"), *x), words, np.array(shares)


def left_over(j: str, d: list[float]):
    return sum((F.col(f"n{i + 1}{j}") * d[i] for i in (1, 2)), F.col(f"n1{j}") * d[0])


def gains(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(key, m..): what a seen bigram has over the values of its two words, in each model."""
    side = words.select(F.col("w").alias("v"), *(f"p{j}" for j in MODELS))
    return pairs.join(side.hint("shuffle_hash"), "v").select("key", *(F.log1p(F.col(f"x{j}") / F.col(f"p{j}")).alias(f"m{j}") for j in MODELS))


def most(df: DataFrame, n: str, key: str, least: int = 8) -> DataFrame:
    """The ``HEAD`` rows of the largest ``n``; the long tail is left out of the sort where enough rows are beyond it."""
    large = df.where(F.col(n) > least)
    return (large if large.count() >= HEAD else df).orderBy(F.desc(n), key).limit(HEAD)


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in the bit table."""
    return key >> np.uint64(64 - BITS), (key << np.uint64(BITS)) >> np.uint64(64 - BITS)


def marks(keys: DataFrame) -> np.ndarray:
    """The bit table of a column of keys, two bits each, as bytes."""
    def parts(batches):
        held = [p for b in batches for p in places(b.column(0).to_numpy().view(np.uint64))]
        at = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        part, first = np.unique(at >> np.uint64(PART), return_index=True)
        low = (at & np.uint64((1 << PART) - 1)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, first[1:])] if len(at) else [], pa.binary())], ["part", "bits"])

    def whole(batches):
        table = {}
        for b in batches:
            for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                table.setdefault(part, np.zeros(1 << PART, bool))[np.frombuffer(bits, np.uint16)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int32()), pa.array([np.packbits(x).tobytes() for x in table.values()], pa.binary())], ["part", "bits"])

    found = stored(keys.mapInArrow(parts, "part int, bits binary").repartition("part").mapInArrow(whole, "part int, bits binary"), "marks").toArrow()
    out = np.zeros((1 << (BITS - PART), 1 << (PART - 3)), np.uint8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"]):
        out[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def marked(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    for at in places(key):
        out &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return out


def _head(rows: pa.Table, key: str, names) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values in each model."""
    keys = rows[key].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([rows[n].to_numpy()[order] for n in names], float).reshape(len(names), -1)


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted ``keys``, and whether it does."""
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    return at, keys[at] == key if len(keys) else np.zeros(len(key), bool)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, key, doc_id, lang, n_words, log_ppl, held) of every row; held: of trusted rows, by the model of the other half."""
    docs = trusted(docs, labels)
    counts, pairs, words, share = model(docs.where("half IS NOT NULL"))
    table = marks(pairs.select("key").unionByName(words.select(F.col("w").alias("key"))))
    frequent = most(words, "n", "w")
    frequent = stored(frequent.unionByName(words.where(F.col("w") == EDGE)).dropDuplicates(["w"]).select("w", "cls", *(f"s{j}" for j in MODELS)), "frequent")
    head_word, value = _head(frequent.toArrow(), "w", ("cls", *(f"s{j}" for j in MODELS)))
    cls, value = value[0].astype(np.int64), value[1:]
    value = np.where(np.isnan(value), share[:, np.maximum(cls, 0)], value)  # the edge is in all models that have a word
    edge, has = _found(head_word, np.array([EDGE], np.uint64))
    edge = value[:, edge[0]] if has[0] else share[:, 0]
    top = stored(gains(most(pairs, "c", "key"), words), "head")
    head_key, more = _head(top.toArrow(), "key", [f"m{j}" for j in MODELS])
    more = np.nan_to_num(more)

    def score(batches):
        forget_others()
        classes = Classes()
        for b in batches:
            t = blanked(plain(b.column(5)))
            for at, m in slices(t):
                part = t.slice(at, m)
                words = Words(part)
                n, base = words.count, np.outer(edge, words.count > 0)
                doc, u, v = sequence(words)
                key = pair(u, v)
                tail = []
                for doc, key, heads, values in ((words.doc, words.hash, head_word, value), (doc, key, head_key, more)):
                    where, hit = _found(heads, key)
                    for j in range(3):
                        base[j] += np.bincount(doc[hit], weights=values[j][where[hit]], minlength=m)
                    if heads is head_word:
                        rare = np.flatnonzero(~hit)
                        c = classes(part, words, rare)
                        for j in range(3):
                            base[j] += np.bincount(doc[rare], weights=share[j][c], minlength=m)
                    doc, key = doc[~hit], key[~hit]
                    seen = marked(key, table)
                    tail.append((doc[seen], key[seen]))
                doc, key = (np.concatenate(x) for x in zip(*tail))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(key))).astype(np.int32)
                doc, key = doc[first], key[first]
                lists = []
                for k in range(SLICES):
                    own = (key & np.uint64(SLICES - 1)) == k
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=m))]).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed(key[own]), times[own])]
                yield pa.RecordBatch.from_arrays([b.column(i).slice(at, m) for i in range(5)] + [pa.array(n), *map(pa.array, base), *lists], names)

    names = ["row", "key", "doc_id", "lang", "half", "n_words", *(f"base{j}" for j in MODELS), *(f"{x}{k}" for k in range(SLICES) for x in ("keys", "times"))]
    kinds = "row long, key long, doc_id long, lang string, half int, n_words long, " + ", ".join([f"base{j} double" for j in MODELS] + [f"keys{k} array<long>, times{k} array<int>" for k in range(SLICES)])
    class_values = [F.element_at(F.array(*map(F.lit, share[i].tolist())), F.greatest("cls", F.lit(0)) + 1) for i in range(3)]
    of_word = words.where(F.col("w") != EDGE).select(F.col("w").alias("key"), *((F.col(f"s{j}") - class_values[i]).alias(f"m{j}") for i, j in enumerate(MODELS)))
    of_slice = lambda df, k: df.where(F.col("key").bitwiseAND(F.lit(SLICES - 1).cast("long")) == k)
    short = lambda df: df.select("key", *(F.col(f"m{j}").cast("float").alias(f"m{j}") for j in MODELS))  # noqa: E731  seven digits of a logarithm
    values = [stored(short(gains(of_slice(pairs, k), words).unionByName(of_slice(of_word, k))), "values") for k in range(SLICES)]
    for old in (counts, words):
        forget(old)
    docs, out = docs.select("row", "key", "doc_id", "lang", "half", "text"), None
    for part in range(PARTS):
        found = stored(docs.where(F.pmod("key", F.lit(PARTS)) == part).mapInArrow(score, kinds), "scored")
        rest = None
        for k in range(SLICES):
            tail = found.select("row", F.inline(F.arrays_zip(F.col(f"keys{k}").alias("key"), F.col(f"times{k}").alias("times"))))
            own = tail.join(values[k].hint("shuffle_hash"), "key").groupBy("row").agg(*(F.sum(F.col("times") * F.col(f"m{j}")).alias(f"m{j}") for j in MODELS))
            own = stored(own, "sums")
            rest = own if rest is None else rest.unionByName(own)
        rest = rest.groupBy("row").agg(*(F.sum(f"m{j}").alias(f"m{j}") for j in MODELS))
        rows = found.select("row", "key", "doc_id", "lang", "half", "n_words", *(f"base{j}" for j in MODELS)).join(rest, "row", "left")
        ppl = {j: F.when(F.col("n_words") > 0, -(F.col(f"base{j}") + F.coalesce(f"m{j}", F.lit(0.0))) / (F.col("n_words") + 1)) for j in MODELS}
        held = F.when(F.col("half") == 0, ppl["1"]).when(F.col("half") == 1, ppl["0"])
        rows = stored(rows.select("row", "key", "doc_id", "lang", "n_words", ppl["a"].alias("log_ppl"), held.alias("held")), "perplexities")
        forget(found)
        out = rows if out is None else out.unionByName(rows)
    for old in values:
        forget(old)
    return out


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, key, doc_id, lang, n_words, log_ppl) of every row, by the model of all trusted text."""
    return scored(docs, labels).drop("held")


def row_key():
    """A hash of id, language and text: rows that agree in these have one verdict."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def rejected(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(key): the ``row_key`` of the rows that do not pass, stored."""
    return stored(classify(df, labels, quantile).where("NOT kept").select("key").distinct(), "rejected")


def classify(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(row, key, doc_id, lang, n_words, log_ppl, limit, kept); row numbers the rows as read, key is ``row_key`` of each."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    found = scored(docs, labels)
    known = found.where("held IS NOT NULL")
    at = F.percentile("held", F.lit(quantile))
    limits = stored(known.groupBy("lang").agg(at.alias("of_lang")), "limits")
    overall = known.agg(at.alias("of_all"))
    marked = labels.where("doc_id IS NOT NULL AND (quality = 0 OR toxic = 1)").select(F.col("doc_id").cast("long").alias("_bad")).distinct()
    marked = stored(marked, "marked")
    small = lambda side: F.broadcast(side) if side.count() <= BROADCAST_IDS else side.hint("merge")
    out = found.drop("held").join(small(limits), "lang", "left").join(F.broadcast(overall))  # overall: one row
    out = out.join(small(marked), F.col("doc_id") == F.col("_bad"), "left")
    out = out.withColumn("limit", F.coalesce("of_lang", "of_all"))
    kept = F.col("log_ppl").isNotNull() & F.col("_bad").isNull() & (F.col("limit").isNull() | (F.col("log_ppl") <= F.col("limit")))
    return out.select("row", "key", "doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_words", "log_ppl", "limit", kept.alias("kept"))
