"""Predicting component scores: inputs, folds, ridge models and their evaluation.

The modelling table has one row per sample.  Models are fitted from sums of products
that Spark adds up, so no task holds the table, and every alpha of a grid is solved
from the same sums.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cellgrove.functions.draws import draw, ranked
from cellgrove.functions.scalar import bspline, fnv1a
from cellgrove.operators.rounds import stored


def parse_map(text: str) -> dict[str, float]:
    """``exp:value,...``; an entry without a colon is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        if ":" not in part:
            raise ValueError(f"no colon in {part!r}")
        name, value = part.split(":", 1)
        out[name.strip()] = float(value)
    return out


def size_ablation(f: DataFrame, mode: str = "keep", column: str = "cluster_size_endo") -> DataFrame:
    if mode == "drop":
        return f.drop(column)
    return f.withColumn(column, F.log1p(F.greatest(F.col(column), F.lit(0.0)))) if mode == "log1p" else f


def anchor(scores: DataFrame, pcs) -> DataFrame:
    """Scores less their mean at dose 0 of the experiment, where it has one."""
    origin = scores.where("abs(dox) <= 1e-8").groupBy("experiment").agg(*(F.avg(c).alias(f"_{c}") for c in pcs))
    return scores.join(origin, "experiment", "left").withColumns({c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in pcs}).drop(*(f"_{c}" for c in pcs))


def cn_lambda(f: DataFrame, lambdas: dict[str, float]) -> DataFrame:
    """``f`` with cn_lambda, the mean copy number of its experiment; NULL where none is given."""
    table = F.create_map(*(F.lit(x) for kv in lambdas.items() for x in kv)) if lambdas else None
    found = F.try_element_at(table, F.col("experiment")).cast("double") if lambdas else F.lit(None).cast("double")
    return f.withColumn("cn_lambda", found)


def cn_draws(f: DataFrame, lambdas: dict[str, float], draws: int = 100, seed: int = 42, name: str = "organoid_id") -> DataFrame:
    """Mean, deviation and percentiles of seeded Poisson draws by sample; the seed hashes the sample's relative name."""
    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("cn_mean", "cn_std", "cn_p10", "cn_p50", "cn_p90")])

    @F.pandas_udf(kind)
    def draw(names: pd.Series, lam: pd.Series) -> pd.DataFrame:
        rows = []
        for n, l in zip(names, lam):
            if l is None or np.isnan(l):
                rows.append((None,) * 5)
                continue
            x = np.random.default_rng((fnv1a(str(n)) + seed) % (1 << 32)).poisson(l, draws)
            rows.append((x.mean(), x.std(ddof=1), *np.percentile(x, [10, 50, 90])))
        return pd.DataFrame(rows, columns=["cn_mean", "cn_std", "cn_p10", "cn_p50", "cn_p90"], dtype=float)

    f = cn_lambda(f, lambdas)
    return f.withColumn("_d", draw(F.col(name).cast("string"), F.col("cn_lambda"))).select("*", "_d.*").drop("_d")


def one_hot(f: DataFrame, experiments: list[str]) -> DataFrame:
    return f.withColumns({f"experiment_id_{e}": F.when(F.col("experiment") == e, 1.0).otherwise(0.0) for e in sorted(experiments)})


def poly_selected(f: DataFrame, d: str = "dox_log", c: str = "cn") -> DataFrame:
    x, y = F.col(d), F.col(c)
    return f.withColumns({"d1": x, "d2": x * x, "d3": x * x * x, "c1": y, "dc": x * y, "d2c": x * x * y})


def group_folds(f: DataFrame, key, kind: str, row: str = "organoid_id") -> DataFrame:
    """(fold, split_type, row_id, role): each group is tested once; the folds are the few distinct groups."""
    g = f.select(F.col(row).alias("row_id"), key.alias("_g"))
    names = g.select(F.col("_g").alias("fold")).distinct()
    if names.count() < 2:
        return g.limit(0).select(F.lit("").alias("fold"), F.lit(kind).alias("split_type"), "row_id", F.lit("").alias("role"))
    listed = names.agg(F.collect_set("fold").alias("_folds"))
    return g.join(F.broadcast(listed)).select("row_id", "_g", F.explode("_folds").alias("fold")).select("fold", F.lit(kind).alias("split_type"), "row_id", F.when(F.col("_g") == F.col("fold"), "test").otherwise("train").alias("role"))


def lor_folds(f: DataFrame) -> DataFrame:
    return group_folds(f, F.concat_ws("::", "experiment", "replicate"), "LOR")


def loex_folds(f: DataFrame) -> DataFrame:
    return group_folds(f, F.col("experiment"), "LOEX")


def random_folds(f: DataFrame, n: int = 10, share: float = 0.2, seed: int = 42, row: str = "organoid_id") -> DataFrame:
    """Seeded random test sets of exactly the rounded share, drawn by ranking a digest of seed, fold and row."""
    size = f.count()
    if size < 5:
        raise ValueError("random folds need five rows")
    take = min(max(1, round(share * size)), size - 1)
    g = ranked(f.select(F.col(row).alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")), ["i"], draw(seed, F.col("i"), F.col("row_id")), "row_id")
    return g.select(F.concat(F.lit("random_"), F.col("i").cast("string")).alias("fold"), F.lit("RANDOM").alias("split_type"), "row_id", F.when(F.col("rank") <= take, "test").otherwise("train").alias("role"))


def holdout(f: DataFrame, train: list[str], test: list[str], row: str = "organoid_id", least_train: int = 6, least_test: int = 4) -> DataFrame:
    """One fold from lists of experiments, which must not overlap; no rows where either side has fewer than its least number."""
    if set(train) & set(test):
        raise ValueError("train and test experiments overlap")
    e = F.col("experiment")
    sides = f.where(e.isin(*train, *test)).select(F.lit("custom").alias("fold"), F.lit("CUSTOM").alias("split_type"), F.col(row).alias("row_id"), F.when(e.isin(test), "test").otherwise("train").alias("role"))
    enough = sides.agg(((F.count_if(F.col("role") == "train") >= least_train) & (F.count_if(F.col("role") == "test") >= least_test)).alias("enough"))
    return sides.join(F.broadcast(enough.where("enough")), how="left_semi")  # one row or none


def missing(f: DataFrame, asked: list[str]) -> DataFrame:
    """(experiment) of the experiments asked for that the table lacks."""
    names = f.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(asked)], "experiment string")
    return names.join(f.select("experiment"), "experiment", "left_anti")


def ridge(x: np.ndarray, y: np.ndarray, alpha: float, scale: bool = True):
    """Weights for centred (and scaled) inputs with a free intercept: a function of new inputs."""
    m, s = x.mean(axis=0), x.std(axis=0) if scale else np.ones(x.shape[1])
    s = np.where(s > 0, s, 1.0)
    z, c = (x - m) / s, y.mean(axis=0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - c))
    return lambda new: (new - m) / s @ w + c


def cubic_terms(x: np.ndarray) -> np.ndarray:
    """All monomials of degree one to three."""
    from itertools import combinations_with_replacement

    return np.column_stack([np.prod(x[:, list(c)], axis=1) for d in (1, 2, 3) for c in combinations_with_replacement(range(x.shape[1]), d)])


def spline_terms(x: np.ndarray, low: np.ndarray, high: np.ndarray, knots: int = 5) -> np.ndarray:
    """Cubic B-splines of the first two inputs (first column of each dropped) and the rest as they are."""
    parts = [bspline(x[:, i], low[i], high[i], knots)[:, 1:] for i in range(min(2, x.shape[1]))]
    return np.column_stack([*parts, x[:, 2:]])


MODELS = ("ridge_linear", "poly_ridge", "spline")
KNOTS = 5
#: A column whose variance is this share of its mean square is constant but for rounding.
FLAT = 1e-12


def terms(x: np.ndarray, model: str, span: np.ndarray | None = None) -> np.ndarray:
    """The columns that a model is linear in; ``span``: lows and highs of the first two inputs in training."""
    if model == "poly_ridge":
        return cubic_terms(x)
    if model == "poly_selected":
        d, c = x[:, 0], x[:, 1]
        return np.column_stack([d, d ** 2, d ** 3, c, d * c, d ** 2 * c, x[:, 2:]])
    return spline_terms(x, span[:2], span[2:], KNOTS) if model == "spline" else x


def fit_predict(train_x, train_y, test_x, model: str, alpha: float):
    """One model on arrays: what the sums below give for a whole table of folds."""
    span = np.concatenate([train_x.min(axis=0)[:2], train_x.max(axis=0)[:2]])
    return ridge(terms(train_x, model, span), train_y, alpha, scale=model != "spline")(terms(test_x, model, span))


def _sums(rows: DataFrame, inputs, targets, models) -> DataFrame:
    """(part, model, place, value): sums of the products of [1, terms, targets] by part and model.

    ``rows`` has part, span (NULL for models without knots), inputs and targets.  A
    task adds up its batches' products, and Spark adds those.
    """
    inputs, targets = list(inputs), list(targets)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for part, g in pdf.groupby("part", sort=False):
                span = g["span"].iloc[0]
                for model in models:
                    if (span is None) == (model == "spline"):
                        continue
                    x = terms(g[inputs].to_numpy(float), model, None if span is None else np.asarray(span, float))
                    d = np.column_stack([np.ones(len(x)), x, g[targets].to_numpy(float)])
                    value = (d.T @ d).ravel()
                    yield pa.RecordBatch.from_pydict({"part": [part] * len(value), "model": [model] * len(value), "place": np.arange(len(value), dtype=np.int32), "value": value})

    out = rows.select("part", "span", *inputs, *targets).mapInArrow(run, "part string, model string, place int, value double")
    return out.groupBy("part", "model", "place").agg(F.sum("value").alias("value"))


def solve(value: np.ndarray, n_targets: int, alpha: float, scale: bool) -> np.ndarray | None:
    """[intercept, weights] for each target from the sums of products of [1, terms, targets]; None for fewer than two rows."""
    size = int(round(len(value) ** 0.5))
    g, p = value.reshape(size, size), size - 1 - n_targets
    n = g[0, 0]
    if n < 1.5:
        return None
    m, c = g[0, 1:1 + p] / n, g[0, 1 + p:] / n
    xx = g[1:1 + p, 1:1 + p] - n * np.outer(m, m)
    xy = g[1:1 + p, 1 + p:] - n * np.outer(m, c)
    square = g[1:1 + p, 1:1 + p].diagonal()
    flat = xx.diagonal() <= FLAT * np.maximum(square, 1e-300)
    s = np.where(flat | (not scale), 1.0, np.sqrt(np.maximum(xx.diagonal(), 1e-300) / n))
    xx, xy = xx / np.outer(s, s), xy / s[:, None]
    xx[flat, :], xx[:, flat], xy[flat, :] = 0.0, 0.0, 0.0
    w = np.linalg.solve(xx + alpha * np.eye(p), xy) / s[:, None]
    return np.vstack([c - m @ w, w])


def fitted(table: DataFrame, folds: DataFrame, inputs, targets, models=MODELS, alphas=(1.0,), chosen: DataFrame | None = None, whole: bool = True, row: str = "organoid_id") -> DataFrame:
    """(fold, model, alpha, span, weights): a model of each fold's training rows for every alpha, or for the one that ``chosen`` (fold, model, alpha) names.

    Products are summed over the whole table and over each fold's test rows once, and a
    fold's training sums are their difference.  With ``whole`` False (folds that leave
    rows out, as CUSTOM ones always do) training rows are summed themselves.  Knots
    follow the range of the training rows, so there is one whole sum for each range.
    """
    inputs, targets, models = list(inputs), list(targets), list(models)
    # folds of all kinds are few, rows are not: what is made for each fold is small
    t = table.select(F.col(row).alias("row_id"), *inputs, *targets).na.drop()
    f = folds.select("fold", "split_type", "row_id", "role").join(t, "row_id")
    ends = [g(c) for g in (F.min, F.max) for c in inputs[:2]]
    spans = f.where("role = 'train'").groupBy("fold", "split_type").agg(F.array(*ends).alias("span"))
    spans = spans.withColumn("whole", F.lit(whole) & (F.col("split_type") != "CUSTOM"))
    spans = stored(spans, "spans")
    kinds = (["spline"] if "spline" in models else []) + (["plain"] if set(models) - {"spline"} else [])
    spanned = spans.select("fold", "whole", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col("span").alias("_span"))
    spanned = spanned.select("fold", "whole", "kind", F.when(F.col("kind") == "spline", F.col("_span")).alias("span"))
    all_of = F.concat(F.lit("all:"), F.coalesce(F.concat_ws(",", F.transform("span", lambda x: x.cast("string"))), F.lit("")))
    own = f.join(F.broadcast(spanned), "fold").where((F.col("role") == "test") == F.col("whole"))
    own_part = F.concat_ws(":", F.lit("own"), "kind", "fold")
    rows = own.select(own_part.alias("part"), "span", *inputs, *targets)
    every = spanned.where("whole").select(all_of.alias("part"), "span").distinct()
    rows = rows.unionByName(t.crossJoin(F.broadcast(every)).select("part", "span", *inputs, *targets))  # one row for each range
    sums = stored(_sums(rows, inputs, targets, models), "sums")
    jobs = spanned.join(F.broadcast(_models(table.sparkSession, models)), "kind")
    total = jobs.where("whole").withColumn("part", all_of).join(sums, ["part", "model"]).select("fold", "model", "span", "place", "value")
    test = jobs.where("whole").withColumn("part", own_part).join(sums, ["part", "model"]).select("fold", "model", "span", "place", (-F.col("value")).alias("value"))
    train = jobs.where("NOT whole").withColumn("part", own_part).join(sums, ["part", "model"]).select("fold", "model", "span", "place", "value")
    parts = total.unionByName(test).unionByName(train).groupBy("fold", "model", "place").agg(F.sum("value").alias("value"), F.first("span", True).alias("span"))
    made = parts.groupBy("fold", "model").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sums"), F.first("span", True).alias("span"))
    asked = chosen.select("fold", "model", "alpha") if chosen is not None else made.select("fold", "model", F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha"))
    n = len(targets)

    def run(batches):
        for pdf in batches:
            found = [solve(np.asarray(v, float), n, a, m != "spline") for v, a, m in zip(pdf["sums"], pdf["alpha"], pdf["model"])]
            pdf["weights"] = [None if w is None else w.ravel().tolist() for w in found]
            yield pdf[["fold", "model", "alpha", "span", "weights"]]

    return made.join(asked, ["fold", "model"]).mapInPandas(run, "fold string, model string, alpha double, span array<double>, weights array<double>").where("weights IS NOT NULL")


def _models(spark, models) -> DataFrame:
    return spark.createDataFrame([("spline" if m == "spline" else "plain", m) for m in models], "kind string, model string")


def predictions(table: DataFrame, folds: DataFrame, inputs, targets, models=MODELS, alpha: float = 1.0, hide=(), row: str = "organoid_id", alphas=None, chosen: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """(fold, split_type, model, alpha, row_id, true_*, pred_*) of test rows; ``hide`` names inputs that test rows see as zero in LOEX and CUSTOM folds."""
    inputs, targets, n = list(inputs), list(targets), len(targets)
    table = stored(table.select(row, *inputs, *targets), "rows")  # both are read several times
    folds = stored(folds.select("fold", "split_type", "row_id", "role"), "folds")
    made = fitted(table, folds, inputs, targets, models, alphas or (alpha,), chosen, whole, row)
    t = table.select(F.col(row).alias("row_id"), *inputs, *targets).na.drop()
    zero = F.col("split_type").isin("LOEX", "CUSTOM")
    t = folds.where("role = 'test'").select("fold", "split_type", "row_id").join(t, "row_id")
    t = t.withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in hide})
    kind = table.schema[row].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for (_, model, _), g in pdf.groupby(["fold", "model", "alpha"], sort=False):
                w, span = np.asarray(g["weights"].iloc[0], float).reshape(-1, n), g["span"].iloc[0]
                x = terms(g[inputs].to_numpy(float), model, None if span is None else np.asarray(span, float))
                y = x @ w[1:] + w[0]
                out = g[["fold", "split_type", "model", "alpha", "row_id", *targets]].rename(columns={c: f"true_{c}" for c in targets})
                yield out.assign(**{f"pred_{c}": y[:, i] for i, c in enumerate(targets)})

    shape = f"fold string, split_type string, model string, alpha double, row_id {kind}, " + ", ".join(f"{s}_{c} double" for s in ("true", "pred") for c in targets)
    return t.join(made, "fold").mapInPandas(run, shape)


def tune(table: DataFrame, folds: DataFrame, inputs, targets, model: str, grid, rounds: int = 3, share: float = 0.2, seed: int = 42, row: str = "organoid_id") -> DataFrame:
    """(fold, model, alpha, inner_mean, inner_sd, selected): errors of each alpha over random splits of a fold's training rows.

    The error of a split is the mean over targets of the root mean square; the first of
    equals by the grid's order is selected.  Folds of fewer than five training rows have
    no splits, and their first alpha is selected without errors.
    """
    grid = [float(a) for a in grid]
    train = folds.where("role = 'train'").select("fold", "row_id")
    size = train.groupBy("fold").agg(F.count("*").alias("n"))
    turns = train.join(size.where("n >= 5"), "fold").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    turns = ranked(turns, ["fold", "i"], draw(seed, F.col("fold"), F.col("i"), F.col("row_id")), "row_id")
    take = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * share), F.col("n") - 1))
    inner = turns.select(F.concat_ws("#", "fold", F.col("i").cast("string")).alias("fold"), F.lit("INNER").alias("split_type"), "row_id", F.when(F.col("rank") <= take, "test").otherwise("train").alias("role"))
    p = predictions(table, stored(inner, "inner"), inputs, targets, [model], alphas=grid, whole=False, row=row)
    squares = [F.sqrt(F.avg((F.col(f"true_{c}") - F.col(f"pred_{c}")) * (F.col(f"true_{c}") - F.col(f"pred_{c}")))) for c in targets]
    each = p.groupBy("fold", "alpha").agg((sum(squares[1:], squares[0]) / len(squares)).alias("e"))
    each = each.groupBy(F.regexp_replace("fold", "#[0-9]+$", "").alias("fold"), "alpha").agg(F.avg("e").alias("inner_mean"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("inner_sd"))
    every = size.select("fold", F.posexplode(F.array(*map(F.lit, grid))).alias("place", "alpha"))
    best = F.row_number().over(W.partitionBy("fold").orderBy(F.col("inner_mean").asc_nulls_last(), "place")) == 1
    return every.join(each, ["fold", "alpha"], "left").select("fold", F.lit(model).alias("model"), "alpha", "inner_mean", "inner_sd", best.alias("selected"))


def tuned_predictions(table: DataFrame, folds: DataFrame, inputs, targets, model: str, grid, hide=(), **splits) -> DataFrame:
    """``predictions`` of one model with the alpha that ``tune`` selects in each fold."""
    found = stored(tune(table, folds, inputs, targets, model, grid, **splits), "tuned")
    return predictions(table, folds, inputs, targets, [model], hide=hide, chosen=found.where("selected"))


def metrics(p: DataFrame, targets, keys=("fold", "model")) -> DataFrame:
    """(keys, pc, n, r2, rmse, mae); r2 is NULL below two rows or for constant truth."""
    rows = p.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("pc"), F.col(f"true_{c}").alias("t"), F.col(f"pred_{c}").alias("y")) for c in targets))))
    e = F.col("t") - F.col("y")
    m = rows.groupBy(*keys, "pc").agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.var_pop("t").alias("v"), F.avg(F.abs(e)).alias("mae"))
    return m.select(*keys, "pc", "n", F.when((F.col("n") >= 2) & (F.col("v") > 0), 1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0))).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae")


def fold_means(m: DataFrame, keys=("model", "pc")) -> DataFrame:
    """(keys, n_folds, r2, rmse, mae): means over folds; a fold without r2 counts in the others only."""
    return m.groupBy(*keys).agg(F.count("*").alias("n_folds"), *(F.avg(c).alias(c) for c in ("r2", "rmse", "mae")))


#: The columns by which copy numbers enter a model, for each encoding.
ENCODINGS = {"lambda": ["cn_lambda"], "sample_mean": ["cn_mean"], "summary": ["cn_mean", "cn_std", "cn_p10", "cn_p50", "cn_p90"]}


def encodings(asked=()) -> list[str]:
    """The encodings asked for, each once; none or ``all`` means every one."""
    for e in asked:
        if e != "all" and e not in ENCODINGS:
            raise ValueError(f"unknown encoding {e}")
    return list(ENCODINGS) if not asked or "all" in asked else list(dict.fromkeys(asked))


def encoded(f: DataFrame, encoding: str) -> tuple[DataFrame, list[str]]:
    """``f`` of ``cn_draws`` without the columns of the other encodings, and the names of this one's."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    mine = ENCODINGS[encoding]
    return f.drop(*{c for columns in ENCODINGS.values() for c in columns} - set(mine)), mine


def encoded_predictions(table: DataFrame, folds: DataFrame, targets, asked=(), models=MODELS, alpha: float = 1.0, dose: str = "dox_log", hot=(), row: str = "organoid_id") -> DataFrame:
    """``predictions`` with an ``encoding`` column: the dose, the encoding's columns of ``cn_draws`` and the experiments as inputs; experiments are hidden from test rows of LOEX and CUSTOM folds."""
    out = []
    for e in encodings(asked):
        f, columns = encoded(table, e)
        out.append(predictions(f, folds, [dose, *columns, *hot], targets, models, alpha, hot, row).withColumn("encoding", F.lit(e)))
    return reduce(DataFrame.unionByName, out)


def holdout_report(p: DataFrame, targets, keys=("model",)) -> DataFrame:
    """(keys, pc, r2, rmse, mae, angle) of each component of predictions with experiment and dox, and a row ``TRAJECTORY``: path error as rmse, endpoint error as mae, mean angle of steps."""
    m = metrics(p, targets, keys).select(*keys, "pc", "r2", "rmse", "mae", F.lit(None).cast("double").alias("angle"))
    t = trajectory(p, targets, keys).groupBy(*keys).agg(F.avg("path_error").alias("rmse"), F.avg("endpoint_error").alias("mae"), F.avg("angle").alias("angle"))
    return m.unionByName(t.select(*keys, F.lit("TRAJECTORY").alias("pc"), F.lit(None).cast("double").alias("r2"), "rmse", "mae", "angle"))


def feature_errors(observed: DataFrame, rebuilt: DataFrame, features, keys=("organoid_id",)) -> DataFrame:
    """(keys, feature, observed, rebuilt, abs_error, sq_error); features that were not observed give no row.

    The observed table joins on the keys, so a rebuilt row without one gives none.
    """
    a = observed.unpivot(list(keys), list(features), "feature", "observed").where("observed IS NOT NULL")
    b = rebuilt.unpivot(list(keys), list(features), "feature", "rebuilt").where("rebuilt IS NOT NULL")
    e = F.col("rebuilt") - F.col("observed")
    return b.join(a, [*keys, "feature"]).withColumns({"abs_error": F.abs(e), "sq_error": e * e})


def feature_error_summary(errors: DataFrame) -> DataFrame:
    """(feature, mae, rmse, n)."""
    return errors.groupBy("feature").agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.count("*").alias("n"))


def trajectory(p: DataFrame, targets, keys=("model",)) -> DataFrame:
    """(keys, experiment, n_doses, path_error, endpoint_error, angle): distances of true and predicted dose centroids and the mean angle of their steps."""
    both = [f"{s}_{c}" for s in ("true", "pred") for c in targets]
    c = p.groupBy(*keys, "experiment", "dox").agg(*(F.avg(x).alias(x) for x in both))
    total = lambda xs: sum(xs[1:], xs[0])
    c = c.withColumn("d", F.sqrt(total([F.pow(F.col(f"true_{x}") - F.col(f"pred_{x}"), F.lit(2)) for x in targets])))
    w = W.partitionBy(*keys, "experiment").orderBy("dox")
    step = {x: F.lead(x).over(w) - F.col(x) for x in both}
    c = c.withColumns({f"s_{x}": e for x, e in step.items()})
    norm = lambda s: F.sqrt(total([F.col(f"s_{s}_{x}") * F.col(f"s_{s}_{x}") for x in targets]))
    dot = total([F.col(f"s_true_{x}") * F.col(f"s_pred_{x}") for x in targets])
    ok = (norm("true") > 1e-12) & (norm("pred") > 1e-12)
    angle = F.when(ok, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(norm("true") * norm("pred"), F.lit(0.0)))))))
    c = c.withColumn("angle", angle)
    out = c.groupBy(*keys, "experiment").agg(F.count("*").alias("n_doses"), F.avg("d").alias("path_error"), F.max_by("d", "dox").alias("endpoint_error"), F.avg("angle").alias("angle"))
    return out.where("n_doses >= 2")


def error_summary(rows: DataFrame, keys, true: str = "true", pred: str = "pred") -> DataFrame:
    e = F.col(true) - F.col(pred)
    return rows.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))
