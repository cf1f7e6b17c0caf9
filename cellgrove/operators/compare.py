"""Tables across samples: composition, summaries, deltas, residuals, imputation, tests."""
from __future__ import annotations

from functools import reduce
from math import exp, factorial, log, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellgrove.functions.draws import draw
from cellgrove.schema import ENDO, MESO


def composition(cells: DataFrame) -> DataFrame:
    """Cell counts and fractions of all cells."""
    e, m = F.count_if(F.col("cell_type") == ENDO), F.count_if(F.col("cell_type") == MESO)
    n = F.count("*")
    return cells.groupBy("organoid_id").agg(n.alias("total_cells"), e.alias("n_endo"), m.alias("n_meso"), (e / n).alias("pct_endo"), (m / n).alias("pct_meso"))


def radial(cells: DataFrame) -> DataFrame:
    """Mean and population deviation of the distance to the centroid of all cells, by lineage."""
    c = cells.groupBy("organoid_id").agg(*(F.avg(x).alias(f"c{x}") for x in "xyz"))
    d = cells.join(c, "organoid_id").withColumn("r", F.sqrt(sum(((F.col(x) - F.col(f"c{x}")) * (F.col(x) - F.col(f"c{x}")) for x in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))))
    out = []
    for name, t in (("endo", ENDO), ("meso", MESO)):
        r = F.when(F.col("cell_type") == t, F.col("r"))
        out += [F.avg(r).alias(f"radial_mean_{name}"), F.stddev_pop(r).alias(f"radial_std_{name}")]
    return d.groupBy("organoid_id").agg(*out)


def celltype_pct(cells: DataFrame) -> DataFrame:
    """Share of each cell type among typed cells, in per cent."""
    n = cells.where("cell_type IS NOT NULL").groupBy("organoid_id", "cell_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("organoid_id")))


def one_vs_all(cells: DataFrame, target: float = ENDO, other: float = 99.0) -> DataFrame:
    return cells.withColumn("cell_type", F.when(F.col("cell_type") == target, target).otherwise(other))


def depth_alpha(cells: DataFrame, low: float = 0.15, high: float = 1.0) -> DataFrame:
    """Height scaled to 0..1 in each organoid (1 if flat) and an opacity from it."""
    w = W.partitionBy("organoid_id")
    lo, hi = F.min("z").over(w), F.max("z").over(w)
    depth = F.when(hi > lo, (F.col("z") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(1.0)
    return cells.withColumn("depth", depth).withColumn("alpha", low + F.col("depth") * (high - low))


def centred_slice(cells: DataFrame, half: float, radius: float, least_lineage: int = 100, least_slice: int = 10) -> DataFrame:
    """Lineage cells in an open slab and cylinder around the medians; small samples give nothing."""
    c = cells.where(F.col("cell_type").isin(ENDO, MESO))
    m = c.groupBy("organoid_id").agg(*(F.median(x).alias(f"m{x}") for x in "xyz"), F.count("*").alias("n")).where(F.col("n") >= least_lineage)
    c = c.join(m, "organoid_id").withColumns({x: F.col(x) - F.col(f"m{x}") for x in "xyz"}).drop("mx", "my", "mz", "n")
    c = c.where((F.abs("z") < half) & (F.col("x") * F.col("x") + F.col("y") * F.col("y") < radius * radius))
    return c.withColumn("_n", F.count("*").over(W.partitionBy("organoid_id"))).where(F.col("_n") >= least_slice).drop("_n")


def long(df: DataFrame, ids, values, variable: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def summary(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean, sample deviation, count and standard error, as bars and bands show them."""
    v = F.col(value)
    n = F.count(v)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), n.alias("n"), (F.stddev_samp(v) / F.sqrt(F.greatest(n, F.lit(1)))).alias("sem"))


def interval95(summaries: DataFrame) -> DataFrame:
    """A summary with the bounds of its mean by the normal approximation (bars elsewhere draw them by resampling)."""
    half = 1.96 * F.col("sem")
    return summaries.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


#: Shares of Poisson draws of mean 1 that are at most 0, 1, 2, ... (fixed values of that distribution).
POISSON = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]


def bootstrap95(df: DataFrame, keys, row: str, value: str = "value", rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, mean, n, low, high): the mean and the middle 95 per cent of its values over resampled rows.

    A row counts as often as a Poisson draw says, which is read off a digest of
    (seed, round, ``row``); ``row`` tells the rows of a group apart.  All rounds are one
    aggregation, combined before the shuffle.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(row).alias("_row"), F.col(value).alias("_v"))
    chance = F.conv(F.substring(draw(seed, F.col("_round"), F.col("_row")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum(((chance >= p).cast("int") for p in POISSON[1:]), (chance >= POISSON[0]).cast("int"))
    drawn = v.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", times)
    each = drawn.groupBy(*keys, "_round").agg((F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    spread = each.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return v.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count("*").alias("n")).join(spread, list(keys))


def quartiles(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """(keys, q1, median, q3, low, high): a box, its line, and the last values within 1.5 box heights of it."""
    v = F.col(value)
    box = df.groupBy(*keys).agg(*(F.percentile(v, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(box, list(keys)).where((v >= F.col("q1") - reach) & (v <= F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3").agg(F.min(v).alias("low"), F.max(v).alias("high"))


def sweep_summary(counts: DataFrame, keys=("replicate", "eps"), value: str = "n_clusters") -> DataFrame:
    """(keys, mean, sd, n): mean and population deviation over the samples of a replicate at each parameter."""
    return counts.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"))


#: Conditions in the order of their axis (fixed values); others are not shown.
CONDITIONS = ("CTRL", "BMP4", "WNT5A", "BMP4+WNT5A", "BASAL")


def in_order(df: DataFrame, column: str = "condition") -> DataFrame:
    """Rows of the named conditions, with their ``place`` on the axis from 1."""
    return df.withColumn("place", F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col(column))).where("place > 0")


def at_doses(df: DataFrame, doses) -> DataFrame:
    return df.where(F.col("dox").isin(list(doses)))


def delta_long(deltas: DataFrame, ids) -> DataFrame:
    """(ids, metric, value, lineage, type): one row per delta; the lineage is the metric's last part, the type is how it was taken."""
    columns = [c for c in deltas.columns if c.startswith(("abs_", "rel_"))]
    kind = F.when(F.contains("metric", F.lit("abs")), "absolute").otherwise("relative")
    return long(deltas, ids, columns).withColumns({"lineage": F.element_at(F.split("metric", "_"), -1), "type": kind})


def pairwise_mean_diff(summaries: DataFrame, order: list[str], keys=("metric", "dox")) -> DataFrame:
    """Mean of the earlier experiment less that of the later, for pairs present at the same dose."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("experiment"))
    a = summaries.select(*keys, F.col("experiment").alias("experiment_a"), F.col("mean").alias("ma"), place.alias("pa"))
    b = summaries.select(*keys, F.col("experiment").alias("experiment_b"), F.col("mean").alias("mb"), place.alias("pb"))
    return a.join(b, list(keys)).where("pa > 0 AND pa < pb").select(*keys, "experiment_a", "experiment_b", (F.col("ma") - F.col("mb")).alias("mean_diff"))


def delta(rows: DataFrame, baseline: str, treatment: str, absolute, relative, key: str = "dox") -> DataFrame:
    """Treatment rows less the baseline's mean at the dose, as it is or in per cent of it (0 where that is not positive)."""
    both = [*absolute, *relative]
    base = rows.where(F.col("experiment") == baseline).groupBy(key).agg(*(F.avg(c).alias(f"_{c}") for c in both))
    t = rows.where(F.col("experiment") == treatment).join(base, key)
    out = [(F.col(c) - F.col(f"_{c}")).alias(f"abs_{c}") for c in absolute]
    out += [F.when(F.col(f"_{c}") > 0, (F.col(c) - F.col(f"_{c}")) / F.nullif(F.col(f"_{c}"), F.lit(0.0)) * 100).otherwise(0.0).alias(f"rel_{c}") for c in relative]
    return t.select("organoid_id", "experiment", "replicate", key, *out)


def normalize(f: DataFrame, total: str = "total_cells", fractions=("pct_endo", "pct_meso")) -> DataFrame:
    """Counts as a share of the largest in the run; fractions clipped to 0..1."""
    top = f.agg(F.max(total).alias("_top"))
    clip = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in fractions}
    return f.join(F.broadcast(top)).withColumns({total: F.col(total) / F.nullif(F.col("_top"), F.lit(0)), **clip}).drop("_top")


def residualize(f: DataFrame, values) -> DataFrame:
    """Takes the replicate's mean out and puts the dose's back."""
    r, d = W.partitionBy("experiment", "dox", "replicate"), W.partitionBy("experiment", "dox")
    known = F.col("experiment").isNotNull() & F.col("dox").isNotNull() & F.col("replicate").isNotNull()
    # a row without one of the keys is of no group, and has no value then
    return f.withColumns({c: F.when(known, F.col(c) - F.avg(c).over(r) + F.avg(c).over(d)) for c in values})


def impute(f: DataFrame, values) -> DataFrame:
    """Median of the dose in the experiment, then the median of the part-filled column."""
    w = W.partitionBy("experiment", "dox")
    f = f.withColumns({c: F.coalesce(F.col(c), F.median(c).over(w)) for c in values})
    rest = f.agg(*(F.median(c).alias(f"_{c}") for c in values))
    return f.join(F.broadcast(rest)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in values}).drop(*(f"_{c}" for c in values))


def group_separation(s: DataFrame, values) -> DataFrame:
    """Share of each column's sum of squares between groups, by experiment, dose and both."""
    rows = long(_keyed(s, "experiment", "dox"), ["experiment", "dox"], values, "pc", "v").where("v IS NOT NULL")
    total = rows.groupBy("pc").agg(F.avg("v").alias("m"), (F.var_samp("v") * (F.count("*") - 1)).alias("ss"), F.count("*").alias("n"), F.var_samp("v").alias("total_var"))
    out = []
    for name, keys in (("experiment", ["experiment"]), ("dox", ["dox"]), ("experiment_dox", ["experiment", "dox"])):
        g = rows.groupBy("pc", *keys).agg(F.avg("v").alias("gm"), F.count("*").alias("gn")).join(total, "pc")
        out.append(g.groupBy("pc").agg(F.sum(F.col("gn") * (F.col("gm") - F.col("m")) * (F.col("gm") - F.col("m"))).alias("b"), F.first("ss").alias("ss"), F.first("n").alias("n"), F.first("total_var").alias("total_var")).select(
            "pc", F.lit(name).alias("grouping"), "total_var", F.when(F.col("n") < 2, None).when(F.col("ss") > 0, F.col("b") / F.nullif(F.col("ss"), F.lit(0.0))).otherwise(0.0).alias("between")))
    return reduce(DataFrame.unionByName, out)


def dose_steps(s: DataFrame, values) -> DataFrame:
    """Distance of consecutive dose centroids of an experiment in the first two and all columns."""
    c = _keyed(s, "experiment", "dox").groupBy("experiment", "dox").agg(*(F.avg(v).alias(v) for v in values))
    w = W.partitionBy("experiment").orderBy("dox")
    c = c.withColumn("next", F.lead("dox").over(w)).withColumn("step", F.row_number().over(w)).withColumns({f"n_{v}": F.lead(v).over(w) for v in values}).where("next IS NOT NULL")
    far = lambda vs: F.sqrt(sum((F.pow(F.col(f"n_{v}") - F.col(v), F.lit(2)) for v in vs[1:]), F.pow(F.col(f"n_{vs[0]}") - F.col(vs[0]), F.lit(2))))
    return c.select("experiment", "step", F.concat_ws("->", F.col("dox").cast("string"), F.col("next").cast("string")).alias("transition"), far(values[:2]).alias("dist_2d"), far(values).alias("dist_all"))


def _keyed(df: DataFrame, *keys) -> DataFrame:
    """Rows with all keys: a missing key forms no group."""
    return df.na.drop(subset=list(keys))


def step_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("transition").agg(F.avg("dist_2d").alias("mean_2d"), F.stddev_samp("dist_2d").alias("sd_2d"), F.avg("dist_all").alias("mean_all"), F.stddev_samp("dist_all").alias("sd_all"), F.countDistinct("experiment").alias("n_experiments"))


def kruskal(f: DataFrame, values) -> DataFrame:
    """(experiment, metric, k, h) of the tie-corrected rank test over doses with two samples or more; NULL if all are equal."""
    rows = long(_keyed(f, "experiment", "dox"), ["experiment", "dox"], values, "metric", "v").where("v IS NOT NULL")
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy("experiment", "metric", "dox"))).where("_n >= 2")
    w, same = W.partitionBy("experiment", "metric"), W.partitionBy("experiment", "metric", "v")
    rows = rows.withColumn("ties", F.count("*").over(same)).withColumn("r", F.rank().over(w.orderBy("v")) + (F.col("ties") - 1) / 2)
    g = rows.groupBy("experiment", "metric", "dox").agg(F.sum("r").alias("r"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    m = g.groupBy("experiment", "metric").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("k")).where("k >= 2")
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0))
    return m.select("experiment", "metric", "k", h.alias("h"))


def log_gamma_half(k):
    """Logarithm of the gamma function at ``k`` / 2, for whole ``k`` from 1: a product from 1 or from the root of pi."""
    first = F.when(k % 2 == 0, 0.0).otherwise(0.5 * log(pi))
    steps = F.sequence(F.lit(1), F.greatest(F.floor((k - 1) / 2), F.lit(1)).cast("int"))
    shift = F.when(k % 2 == 0, 0.0).otherwise(0.5)
    return first + F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.when(i <= F.floor((k - 1) / 2), F.ln(i - shift)).otherwise(0.0))


def chi2_tail(h, df):
    """Upper tail of the chi-squared distribution for whole degrees of freedom, by the incomplete gamma function.

    Below the mean by its series, above by its continued fraction (modified Lentz), as folds
    that are as long as the degrees of freedom ask for.  NULL for NULL; 1 for nothing.
    """
    a, x = df / 2.0, h / 2.0
    front = F.exp(a * F.ln(x) - x - log_gamma_half(df))
    turns = F.sequence(F.lit(1), (200 + F.ceil(df)).cast("int"))
    start = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
    series = F.aggregate(turns, start, lambda c, n: F.struct((c["t"] * x / (a + n)).alias("t"), (c["s"] + c["t"] * x / (a + n)).alias("s")), lambda c: c["s"])
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(c, n):
        an, b = -n * (n - a), x + 1 - a + 2 * n
        d, e = 1 / safe(an * c["d"] + b), safe(b + an / c["c"])
        return F.struct(d.alias("d"), e.alias("c"), (c["v"] * d * e).alias("v"))

    first = 1 / safe(x + 1 - a)
    fraction = F.aggregate(turns, F.struct(first.alias("d"), F.lit(1 / tiny).alias("c"), first.alias("v")), step, lambda c: c["v"])
    return F.when(h <= 0, 1.0).when(x < a + 1, F.greatest(1 - front * series, F.lit(0.0))).otherwise(front * fraction)


def stars(p):
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def signal_ratio(f: DataFrame, values) -> DataFrame:
    """One less the mean of the doses' variances over the whole variance; NULL where that is not positive."""
    rows = long(_keyed(f, "experiment", "dox"), ["experiment", "dox"], values, "metric", "v")
    noise = rows.groupBy("experiment", "metric", "dox").agg(F.var_samp("v").alias("s")).groupBy("experiment", "metric").agg(F.avg("s").alias("noise"))
    total = rows.groupBy("experiment", "metric").agg(F.var_samp("v").alias("total"))
    return noise.join(total, ["experiment", "metric"]).select("experiment", "metric", F.when(F.col("total") > 0, 1 - F.col("noise") / F.nullif(F.col("total"), F.lit(0.0))).alias("signal"))


def axis_limits(s: DataFrame, values, pad: float = 0.12) -> DataFrame:
    m = long(s, [], values, "axis", "v").groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return m.select("axis", (F.col("lo") - pad * span).alias("lo"), (F.col("hi") + pad * span).alias("hi"))


def minority_frequency(adjacency: DataFrame, keys=("dox",)) -> DataFrame:
    """Share of organoids in which each lineage is the minority, in per cent."""
    out = adjacency.groupBy(*keys).agg(*((100.0 * F.count_if(F.col("minority") == x) / F.count("*")).alias(x) for x in ("Endo", "Meso")))
    return long(out, keys, ["Endo", "Meso"], "lineage", "pct")


def named_like(df: DataFrame, column: str, parts) -> DataFrame:
    """Rows whose ``column`` holds one of ``parts`` anywhere: "0dox" is also found in "10dox" and "100dox"."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.col(column), F.lit(p)) for p in parts)))


def significance(f: DataFrame, values) -> DataFrame:
    """(experiment, metric, k, h, p, stars, signal, p_place, signal_place) of each feature.

    ``p_place`` orders an experiment's features by p-value, ``signal_place`` orders
    features by their mean signal ratio over experiments, the least first; ties by
    name, features without a figure last.
    """
    k = kruskal(f, values).withColumn("p", chi2_tail(F.col("h"), F.col("k") - 1))
    rows = k.join(signal_ratio(f, values), ["experiment", "metric"], "left")
    mean = rows.groupBy("metric").agg(F.avg("signal").alias("_m"))
    mean = mean.select("metric", F.row_number().over(W.orderBy(F.col("_m").asc_nulls_last(), "metric")).alias("signal_place"))  # one row for each feature
    place = F.row_number().over(W.partitionBy("experiment").orderBy(F.col("p").asc_nulls_last(), "metric"))
    rows = rows.withColumn("p_place", place).join(F.broadcast(mean), "metric")
    return rows.select("experiment", "metric", "k", "h", "p", stars(F.col("p")).alias("stars"), "signal", "p_place", "signal_place")


def axis_break(df: DataFrame, keys, value: str, limit: float, over: float = 1.2) -> DataFrame:
    """(top_mean, top, broken): an axis that ends at ``limit`` is broken where a group's mean passes ``over`` times that."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.max(value).alias("v"))
    return means.agg(F.max("m").alias("top_mean"), F.max("v").alias("top")).withColumn("broken", F.coalesce(F.col("top_mean") > limit * over, F.lit(False)).cast("int"))
