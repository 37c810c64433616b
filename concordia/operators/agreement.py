"""Agreement of predicted with true values: one aggregate of sufficient statistics per group, metrics as expressions of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import cumulative, few_groups, with_median

Z = 1.96


def bundle(y: Column, p: Column) -> list[Column]:
    """Error, concordance, intraclass correlation, limits of agreement and calibration line, as aggregates.

    They share one pass of partial sums; the pair counts if both are present. agreement() adds the median error.
    """
    ok = y.isNotNull() & p.isNotNull()
    y, p = F.when(ok, y), F.when(ok, p)
    e = p - y
    n = F.count(y)
    sse, sst = F.sum(e * e), F.var_pop(y) * n
    ms_sub = 2 * F.var_samp((y + p) / 2)
    ms_err = F.var_samp(e) / 2
    ms_rat = n * F.avg(e) * F.avg(e) / 2
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
        (2 * F.covar_samp(y, p) / F.nullif(F.var_samp(y) + F.var_samp(p) + F.avg(e) * F.avg(e), F.lit(0.0))).alias("ccc"),
        ((ms_sub - ms_err) / F.nullif(ms_sub + ms_err + 2 * (ms_rat - ms_err) / n, F.lit(0.0))).alias("icc"),
        F.avg(e).alias("ba_bias"),
        F.stddev_samp(e).alias("ba_sd"),
        (F.avg(e) - Z * F.stddev_samp(e)).alias("ba_low"),
        (F.avg(e) + Z * F.stddev_samp(e)).alias("ba_high"),
        F.regr_slope(y, p).alias("slope"),
        F.regr_intercept(y, p).alias("intercept"),
    ]


def intervals(y: Column, low: Column, high: Column) -> list[Column]:
    """Coverage and width of prediction intervals, as aggregates; rows without interval don't count."""
    inside = F.when(low.isNotNull() & high.isNotNull() & y.isNotNull(), F.when(y.between(low, high), 1.0).otherwise(0.0))
    return [F.avg(inside).alias("pi_coverage"), (1 - F.avg(inside)).alias("pi_miscoverage"), F.avg(high - low).alias("pi_mean_width")]


def interval_metrics(frame: DataFrame, y: str, low: str, high: str, alpha: float, *by: str) -> DataFrame:
    """(by, pi_alpha, pi_coverage, pi_miscoverage, pi_mean_width, pi_median_width); null, but for alpha, where no row has an interval."""
    a, b = F.col(low), F.col(high)
    return with_median(frame, b - a, "pi_median_width", *by, extra=(F.lit(alpha).alias("pi_alpha"), *intervals(F.col(y), a, b)))


def agreement(frame: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """bundle() and median_ae, the median absolute error, by group."""
    out = with_median(frame, F.abs(F.col(p) - F.col(y)), "median_ae", *by, extra=tuple(bundle(F.col(y), F.col(p))))
    return out.select(*by, "n", "rmse", "mae", "median_ae", *[c for c in out.columns if c not in {*by, "n", "rmse", "mae", "median_ae"}])


def stratified(frame: DataFrame, y: str, p: str, strata: list[str], least: int = 3) -> DataFrame:
    """agreement() by each stratifier in one pass over unpivoted strata; null strata and groups under `least` rows go."""
    long = frame.select(y, p, F.explode(F.array(*[F.struct(F.lit(s).alias("stratifier"), F.col(s).cast("string").alias("subgroup")) for s in strata])).alias("s"))
    long = long.select(y, p, "s.stratifier", "s.subgroup").filter("subgroup IS NOT NULL")
    return agreement(long, y, p, "stratifier", "subgroup").filter(F.col("n") >= least)


def latest(frame: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The last row of each key by time, an aggregate over its rows; rows without time lose; ties go to the larger tie column."""
    known = F.col(when).isNotNull()
    top = frame.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in frame.columns if c not in keys]), F.struct(known, when, F.col(tie).isNotNull(), tie)).alias("_row"))
    return top.select(*keys, "_row.*").select(*frame.columns)


def best(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The row of least error of each key: by rmse, then mae, then the highest concordance; nulls and NaN lose."""
    clean = frame.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("rmse", "mae", "ccc")})
    order = F.struct(*[x for c, sign in (("rmse", 1), ("mae", 1), ("ccc", -1)) for x in (F.col(c).isNull(), sign * F.col(c))])
    top = clean.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in clean.columns if c not in keys]), order).alias("_row"))
    return top.select(*keys, "_row.*").select(*frame.columns)


def ranks(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, ties, rank) of each distinct value, rank the average rank of its rows: ranks without sorting a group in one task."""
    each = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    return cumulative(each, value, ["ties"], *by, few=few_groups(frame, *by)).withColumn("rank", F.col("before_ties") + (F.col("ties") + 1) / 2).select(*by, value, "ties", "rank")


def auc(frame: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """(by, n, auc): area under the curve, tied scores counting half."""
    rows = frame.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    each = rows.groupBy(*by, score).agg(F.count("*").alias("ties"), F.sum(F.col(label).cast("long")).alias("pos"))
    each = cumulative(each, score, ["ties", "pos"], *by, few=few_groups(frame, *by)).withColumn("rank", F.col("before_ties") + (F.col("ties") + 1) / 2)
    n1, n0 = F.sum("pos").cast("double"), (F.sum("ties") - F.sum("pos")).cast("double")
    area = (F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    return each.groupBy(*by).agg(F.sum("ties").alias("n"), area.alias("auc"))


def auc_increment(frame: DataFrame, base: str, more: str, label: str, *by: str) -> DataFrame:
    """(by, auc_base, auc_more, increment): areas of two nested models' scores, over the rows that have both, and their difference."""
    rows = frame.filter(F.col(base).isNotNull() & F.col(more).isNotNull())
    both = rows.select(*by, label, F.explode(F.array(F.struct(F.lit("base").alias("m"), F.col(base).cast("double").alias("s")), F.struct(F.lit("more").alias("m"), F.col(more).cast("double").alias("s")))).alias("_x"))
    each = auc(both.select(*by, label, F.col("_x.m").alias("_model"), F.col("_x.s").alias("_score")), "_score", label, *by, "_model")
    pick = lambda m: F.max(F.when(F.col("_model") == m, F.col("auc")))
    return each.groupBy(*by).agg(pick("base").alias("auc_base"), pick("more").alias("auc_more"), (pick("more") - pick("base")).alias("increment"))


def model_comparison(frame: DataFrame, y: str, predictions: dict[str, str], *by: str) -> DataFrame:
    """(by, model, n, mae, rmse, r2) of each model's column of out-of-fold predictions, pooled over folds."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in predictions.items()])
    long = frame.select(*by, F.col(y).cast("double").alias("_y"), F.explode(models).alias("_m")).select(*by, "_y", "_m.model", "_m.p")
    return long.groupBy(*by, "model").agg(*bundle(F.col("_y"), F.col("p"))).select(*by, "model", "n", "mae", "rmse", "r2")


def thresholds(frame: DataFrame, score: str, label: str, at: float = 0.5) -> DataFrame:
    """Confusion counts at a threshold, with sensitivity, specificity, balanced accuracy and Brier score."""
    s, y = F.col(score), F.col(label)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = frame.filter(s.isNotNull() & y.isNotNull()).agg(count((s >= at) & (y == 1)).alias("tp"), count((s >= at) & (y == 0)).alias("fp"), count((s < at) & (y == 0)).alias("tn"), count((s < at) & (y == 1)).alias("fn"), F.avg((s - y) * (s - y)).alias("brier"))
    sens, spec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0))
    return out.withColumns({"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2})


def grouping_summary(frame: DataFrame, measures: list[str], specs: list[tuple[str, ...]]) -> DataFrame:
    """N, mean, median and sample deviation of each measure by each set of keys, all sets in one pass over the rows.

    Rows with a null in a set's own key are left out of it; the keys' values are joined into a label.
    """
    keys = sorted({k for s in specs for k in s})
    long = frame.unpivot(keys, measures, "measure", "value").filter("value IS NOT NULL")
    own = lambda s: [k for k in keys if k in s]
    whole = lambda s: F.array_compact(F.array(*[F.col(k).cast("string") for k in s]))
    sets = [F.when(F.size(whole(s)) == len(s), F.struct(F.lit(" x ".join(own(s))).alias("stratum"), F.concat_ws(" | ", *[F.col(k).cast("string") for k in own(s)]).alias("label"))) if s else F.struct(F.lit("").alias("stratum"), F.lit("").alias("label")) for s in specs]
    each = long.select("measure", "value", F.explode(F.array_compact(F.array(*sets))).alias("s")).select("measure", "s.stratum", "s.label", "value")
    out = with_median(each, F.col("value"), "median", "measure", "stratum", "label", extra=(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")))
    return out.select("measure", "stratum", "label", "n", "mean", "median", "sd")


def boundaries(frame: DataFrame, ranges: DataFrame, features: list[str]) -> DataFrame:
    """(feature, expected and observed range, violations): values outside the ranges (feature, lo, hi) seen in training."""
    long = frame.unpivot([], features, "feature", "value").join(F.broadcast(ranges), "feature")  # ranges: a row a feature
    out = F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), 1).otherwise(0)
    return long.groupBy("feature", "lo", "hi").agg(F.min("value").alias("seen_lo"), F.max("value").alias("seen_hi"), F.sum(out).alias("violations"))


def histogram(frame: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal widths between the extremes; the maximum falls in the last bin."""
    edge = frame.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    return frame.crossJoin(F.broadcast(edge)).filter(F.col(value).isNotNull()).groupBy(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def series(frame: DataFrame, y: str, p: str) -> DataFrame:
    """(series, x, y) of what the plots show: truth against prediction, residual against prediction, difference against mean."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    points = [("scatter", a, b), ("residual", b, a - b), ("bland_altman", (a + b) / 2, b - a)]
    rows = frame.filter(a.isNotNull() & b.isNotNull())
    return rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("series"), x.alias("x"), v.alias("y")) for n, x, v in points])))


def plot_limits(frame: DataFrame, y: str, p: str) -> DataFrame:
    """One row of what the plots draw besides points: the identity line's extent, the mean difference and its limits."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    rows, e = frame.filter(a.isNotNull() & b.isNotNull()), b - a
    sd = F.stddev_samp(e)
    return rows.agg(F.min(F.least(a, b)).alias("line_from"), F.max(F.greatest(a, b)).alias("line_to"), F.avg(e).alias("bias"), (F.avg(e) - Z * sd).alias("low"), (F.avg(e) + Z * sd).alias("high"))
