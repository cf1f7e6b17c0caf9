"""Personal data by bootstrapped contextual extraction, built-in SQL functions only.

1. Base patterns (email, ip, card, phone) seed the process; each kind is found
   leftmost and non-overlapping, failing matches (ip part over 255, wrong number
   of digits, Luhn) are dropped.  The patterns are written without nested
   repetition, so long runs cost linear time and no stack.
2. Further instances are words with an at sign, (at) or [at], words with four
   digits, and up to nine groups of digits that blanks, dots or brackets join, of
   any length.  The two words before and the two after a seed or an instance, up
   to the next one, are its lexical patterns.
3. The pattern-instance graph is scored for ``ROUNDS`` rounds.  A pattern's
   confidence for a kind is the summed score of its distinct instances of that
   kind over all its distinct instances plus ``DOUBT``; with fewer than ``SUPPORT``
   scored instances or a confidence under ``LEAST`` it says nothing.  An instance's
   score joins the confidences of its patterns as independent evidence; at ``SURE``
   it is discovered, and its other patterns count from the next round on.  Seeds
   stay at one.
4. Discovered instances of the right shape for a kind are added as spans, wherever
   they stand; base spans stay.

The work on one text grows in proportion to it.

Defined cases: null or empty texts hold nothing; rows with a null id are scanned
like others; repeated rows each give a row, but count once as an instance; other
columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import BROADCAST_IDS, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DOUBT, SURE = 3, 2.0, 0.8
#: Scored instances and confidence under which a pattern says nothing.
SUPPORT, LEAST = 3, 0.5

#: Each kind's pattern, equal in what it finds to the plain form above it.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A word with an at sign or four digits, or groups of digits.
INSTANCE = (
    r"(?<!\S)(?:[^\s@]*+@\S*+|[^\s(\[]*+(?:\(at\)|\[at\])\S++"
    r"|[+(]?[0-9]++(?:[().\x20/-]{1,3}[0-9]++){1,8}(?![^\s.,;:!?)\]])|(?:[^\s0-9]*+[0-9]){4}\S*+)"
)
MARK, OTHER = "\u0001", "\u0002"
#: Pieces whose lengths are summed one by one; sums of such groups are added up first.
GROUP = 64


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)
    def step(total, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.rlike(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))),
    "card": lambda m: F.length(digits(m)).between(16, 19) & luhn(F.when(F.length(digits(m)).between(16, 19), digits(m)).otherwise("0")),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
}
#: The shape that an instance found by context must have.
SHAPE = {
    "email": r"^\S+(@|\(at\)|\[at\])\S+$",
    "ip": r"^[0-9]{1,3}([.:_-][0-9]{1,3}){3}$",
    "card": r"^([0-9][.\x20-]?){12,19}$",
    "phone": r"^\+?\(?([0-9][().\x20/-]{0,3}){7,15}$",
}


def marked(text: str, pattern: str, needs: str) -> Column:
    """The text cut at the matches of a pattern: they are the pieces with odd numbers."""
    cut = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(F.rlike(F.col(text), F.lit(needs)), cut).otherwise(F.array(F.lit("")))


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once for a row however often a lambda inside asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def offsets(pieces: str) -> Column:
    """Where each piece starts, in code points: running sums in two levels, so the work stays in proportion."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, n: s + n)
    first = lambda a, n: total(F.slice(a, F.lit(1), n))
    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / GROUP).cast("int"))
    grouped = lambda lengths: F.transform(numbers, lambda g: F.slice(lengths, g * GROUP + 1, F.lit(GROUP)))
    inside = lambda groups, begins: F.flatten(F.transform(groups, lambda own, g: F.transform(own, lambda _, i: F.get(begins, g) + first(own, i))))
    return let(F.transform(pieces, lambda p: F.length(p)), lambda lengths: let(grouped(lengths), lambda groups: let(
        F.transform(groups, total), lambda sums: let(F.transform(sums, lambda _, g: first(sums, g)), lambda begins: inside(groups, begins)))))


def before(left: Column) -> Column:
    """The two words at the end of a piece, lower-cased, as a pattern; empty if there are fewer."""
    found = F.lower(F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++)\s*+\z", 1))
    return F.when(found == "", "").otherwise(F.concat(F.lit("< "), found))


def after(right: Column) -> Column:
    """The two words at the start of a piece, after what is joined to the match."""
    found = F.lower(F.regexp_extract(right, r"\A\S*+\s++(\S++\s++\S++)", 1))
    return F.when(found == "", "").otherwise(F.concat(F.lit("> "), found))


def matches(pieces: str) -> Column:
    """array<struct<start, stop, m, p, q>> of the odd pieces, p and q the patterns before and after."""
    odd = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    def one(all_, i):
        piece = lambda j: F.get(all_["pieces"], j)
        return F.struct(F.get(all_["at"], i).alias("start"), F.get(all_["at"], i + 1).alias("stop"), piece(i).alias("m"), before(piece(i - 1)).alias("p"), after(piece(i + 1)).alias("q"))
    return let(F.struct(F.col(pieces).alias("pieces"), offsets(pieces).alias("at")), lambda all_: F.transform(odd, lambda i: one(all_, i)))


def cover(pieces: str, kind: str) -> Column:
    """The text's length in bytes of one each: 1 where a valid match of the kind lies, else 0; null if there is none."""
    shown = F.transform(pieces, lambda p, i: F.repeat(F.when((i % 2 == 1) & VALID[kind](p), "1").otherwise("0"), F.length(p)))
    return F.when(F.size(pieces) > 1, F.array_join(shown, "").cast("binary"))


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, more): base spans and further instances of each row, stored."""
    t = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("row", "doc_id", *(marked("t", PATTERNS[k], NEEDS[k]).alias(k) for k in KINDS), marked("t", INSTANCE, r"@|[0-9]|[(\[]at").alias("more"))
    t = t.select("row", "doc_id", *(matches(k).alias(k) for k in (*KINDS, "more")), F.struct(*(cover(k, k).alias(k) for k in KINDS)).alias("covers"))
    def shown(kind, order):
        good = F.filter(kind, lambda x: VALID[kind](x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(order).alias("k"), x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), x["p"].alias("p"), x["q"].alias("q")))
    def free(x, covers):
        n = x["stop"] - x["start"]
        empty = F.repeat(F.lit("0"), n).cast("binary")
        clear = [F.coalesce(F.substring(covers[k], x["start"] + 1, n) == empty, F.lit(True)) for k in KINDS]
        return clear[0] & clear[1] & clear[2] & clear[3]
    tidy = lambda m: F.regexp_replace(m, r"[^\p{L}\p{N})]++\z", "")
    unseen = let(F.col("covers"), lambda covers: F.filter("more", lambda x: free(x, covers)))
    more = F.transform(unseen, lambda x: F.struct(x["start"].alias("start"), tidy(x["m"]).alias("m"), x["p"].alias("p"), x["q"].alias("q")))
    return stored(t.select("row", "doc_id", F.concat(*(shown(k, i) for i, k in enumerate(KINDS))).alias("base"), more.alias("more")), "extracted")


def bootstrap(found: DataFrame) -> DataFrame:
    """(m, k, score): instances beyond the seeds that patterns give away, for kind number k."""
    seeds = found.select(F.explode("base").alias("b")).select("b.p", "b.q", "b.m", "b.k")
    rest = found.select(F.explode("more").alias("b")).select("b.p", "b.q", "b.m")
    both = lambda t: t.select("m", F.explode(F.array("p", "q")).alias("p")).where("p <> ''")
    links = stored(both(seeds).unionByName(both(rest)).distinct(), "links")
    sizes = stored(links.groupBy("p").agg(F.count("*").alias("n")), "sizes")
    fixed = stored(seeds.select("m", "k").distinct().withColumn("score", F.lit(1.0)), "seeds")
    scores = fixed
    for _ in range(ROUNDS):
        patterns = links.join(scores, "m").groupBy("p", "k").agg(F.sum("score").alias("s"), F.count("*").alias("of")).where(F.col("of") >= SUPPORT)
        patterns = patterns.join(sizes, "p").select("p", "k", (F.col("s") / (F.col("n") + DOUBT)).alias("confidence"))
        patterns = stored(patterns.where(F.col("confidence") >= LEAST), "patterns")
        side = F.broadcast(patterns) if patterns.count() <= BROADCAST_IDS // 4 else patterns
        # instances over patterns: the product of doubts, from sums of logarithms
        fresh = links.join(side, "p").groupBy("m", "k").agg((1.0 - F.exp(F.sum(F.ln(1.0 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        fresh = fresh.join(fixed.select("m", "k"), ["m", "k"], "left_anti").where(F.col("score") >= SURE)
        scores = stored(fixed.unionByName(fresh.select("m", "k", "score")), "scores")
    return scores.join(fixed.select("m", "k"), ["m", "k"], "left_anti")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): arrays of struct<k, start, stop, m> by kind, then start."""
    found = extract(df, id_col, text_col)
    known = bootstrap(found)
    more = found.select("row", F.explode("more").alias("x")).select("row", "x.start", "x.m").join(known, "m")
    fits = F.lit(False)
    for i, kind in enumerate(KINDS):
        fits = fits | ((F.col("k") == i) & F.rlike(F.col("m"), F.lit(SHAPE[kind])))
    added = more.where(fits).groupBy("row").agg(F.collect_set(F.struct("k", "start", (F.col("start") + F.length("m")).alias("stop"), "m")).alias("added"))
    base = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["start"].alias("start"), b["stop"].alias("stop"), b["m"].alias("m")))
    out = found.join(added, "row", "left").select("doc_id", base.alias("base"), "added")
    return out.select("doc_id", "base", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans"))


def listed(name: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)."""
    s = spans(df, id_col, text_col)
    def of(i):
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = [of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return s.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
