"""The registered queries: each operator on the given tables, and its SQL on the same tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import agreement as A
from ..operators import discussion as D
from ..operators import features as X
from ..operators import inference as I
from ..operators import keys as K
from ..operators import learning as L
from ..operators import models as M
from ..operators import quality as Q
from ..operators import resample as R
from ..operators.ranking import with_median
from .registry import query, rounded, table

METRICS = ["n", "rmse", "mae", "median_ae", "mse", "r2", "mape", "ccc", "icc", "ba_bias", "ba_sd", "ba_low", "ba_high", "slope", "intercept"]
PAIRED = """paired AS (SELECT o_custkey AS person, o_orderpriority AS priority, l_returnflag AS flag, l_quantity,
 CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid' WHEN l_quantity > 30 AND l_quantity <= 60 THEN 'high' END AS quantity_band,
 l_extendedprice AS y, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def paired(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return both.select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("priority"), F.col("l_returnflag").alias("flag"), "l_quantity", C.cut(F.col("l_quantity"), [0, 10, 30, 60], ["low", "mid", "high"]).alias("quantity_band"), F.col("l_extendedprice").alias("y"), p.alias("p"))


def bundle_sql(by: str, source: str = "paired", having: str = "") -> str:
    return f"""SELECT {by}, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(median(abs(p - y)), 4) AS median_ae,
 round(avg((p - y) * (p - y)), 1) AS mse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(p - y) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape,
 round(2 * covar_samp(y, p) / (var_samp(y) + var_samp(p) + avg(p - y) * avg(p - y)), 4) AS ccc,
 round((2 * var_samp((y + p) / 2) - var_samp(p - y) / 2) / (2 * var_samp((y + p) / 2) + var_samp(p - y) / 2 + 2 * (count(*) * avg(p - y) * avg(p - y) / 2 - var_samp(p - y) / 2) / count(*)), 4) AS icc,
 round(avg(p - y), 4) AS ba_bias, round(stddev_samp(p - y), 4) AS ba_sd, round(avg(p - y) - 1.96 * stddev_samp(p - y), 4) AS ba_low, round(avg(p - y) + 1.96 * stddev_samp(p - y), 4) AS ba_high,
 round(regr_slope(y, p), 4) AS slope, round(regr_intercept(y, p), 2) AS intercept FROM {source} GROUP BY {by} {having}"""


def bundled(frame: DataFrame) -> DataFrame:
    return rounded(frame.withColumn("mse", F.round("mse", 1)).withColumn("intercept", F.round("intercept", 2)))


@query(f"WITH {PAIRED} {bundle_sql('priority')}")
def agreement_by_stratum(spark, d):
    return bundled(A.agreement(paired(spark, d), "y", "p", "priority"))


_LONG = "long AS (SELECT 'priority' AS stratifier, priority AS subgroup, y, p FROM paired UNION ALL SELECT 'flag', flag, y, p FROM paired UNION ALL SELECT 'quantity_band', quantity_band, y, p FROM paired WHERE quantity_band IS NOT NULL)"


@query(f"WITH {PAIRED}, {_LONG} {bundle_sql('stratifier, subgroup', 'long', 'HAVING count(*) >= 3')}")
def agreement_stratified(spark, d):
    return bundled(A.stratified(paired(spark, d), "y", "p", ["priority", "flag", "quantity_band"]))


@query(f"WITH {PAIRED} SELECT flag, 0.1::DOUBLE AS pi_alpha, round(avg(CASE WHEN y BETWEEN p - 2000 AND p + 2000 THEN 1.0 ELSE 0.0 END), 4) AS pi_coverage, round(1 - avg(CASE WHEN y BETWEEN p - 2000 AND p + 2000 THEN 1.0 ELSE 0.0 END), 4) AS pi_miscoverage, 4000.0::DOUBLE AS pi_mean_width, 4000.0::DOUBLE AS pi_median_width FROM paired GROUP BY flag")
def interval_metrics(spark, d):
    rows = paired(spark, d).withColumns({"low": F.col("p") - 2000, "high": F.col("p") + 2000})
    return rounded(A.interval_metrics(rows, "y", "low", "high", 0.1, "flag"))


_MODELS = f"WITH {PAIRED}, m AS (SELECT flag AS model, quantity_band AS target, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, 2 * covar_samp(y, p) / (var_samp(y) + var_samp(p) + avg(p - y) * avg(p - y)) AS ccc FROM paired GROUP BY ALL)"


@query(f"{_MODELS} SELECT target, model, round(rmse, 4) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rmse, mae, ccc DESC) AS r FROM m) WHERE r = 1")
def best_model(spark, d):
    m = A.agreement(paired(spark, d), "y", "p", "flag", "quantity_band").withColumnsRenamed({"flag": "model", "quantity_band": "target"})
    return rounded(A.best(m, ["target"]).select("target", "model", "rmse"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return A.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS median, count(DISTINCT o_custkey) AS people, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, sum(CASE WHEN nullif(o_orderpriority, '1-URGENT') IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM orders GROUP BY 1")
def group_descriptives(spark, d):
    v = F.col("o_totalprice")
    each = (F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count_distinct("o_custkey").alias("people"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).isNull().cast("int")).alias("missing"))
    return rounded(with_median(table(spark, d, "orders"), v, "median", "o_orderstatus", extra=each))


_SETS = """WITH l AS (SELECT o_orderstatus, o_orderpriority, measure, value FROM (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey) UNPIVOT (value FOR measure IN (o_totalprice, c_acctbal)))
SELECT measure, CASE WHEN grouping(o_orderpriority) = 0 AND grouping(o_orderstatus) = 0 THEN 'o_orderpriority x o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS stratum,
 concat_ws(' | ', CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END, CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus END) AS label, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS sd
FROM l GROUP BY GROUPING SETS ((measure, o_orderstatus), (measure, o_orderpriority), (measure, o_orderstatus, o_orderpriority)) HAVING (grouping(o_orderpriority) = 1 OR o_orderpriority IS NOT NULL) AND (grouping(o_orderstatus) = 1 OR o_orderstatus IS NOT NULL)"""


@query(_SETS)
def grouping_set_summary(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"), "o_totalprice", "c_acctbal")
    return rounded(A.grouping_summary(rows, ["o_totalprice", "c_acctbal"], [("o_orderstatus",), ("o_orderpriority",), ("o_orderpriority", "o_orderstatus")]))


_SCORED = "scored AS (SELECT d.n_chars / 100.0::DOUBLE AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL)"


def scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") / 100.0).alias("s"), F.col("quality").alias("y"))


@query(f"WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM scored) SELECT count(*) AS n, round((sum(CASE WHEN y = 1 THEN r END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))), 4) AS auc FROM r")
def auc_with_ties(spark, d):
    return rounded(A.auc(scored(spark, d), "s", "y"))


@query(f"WITH {_SCORED}, c AS (SELECT least(1.0, s / 50) AS s, y FROM scored) SELECT sum(CASE WHEN s >= .5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN s >= .5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN s < .5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN s < .5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, round(avg((s - y) * (s - y)), 4) AS brier, round(tp::DOUBLE / (tp + fn), 4) AS sensitivity, round(tn::DOUBLE / (tn + fp), 4) AS specificity, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 4) AS balanced_accuracy FROM c")
def threshold_metrics(spark, d):
    return rounded(A.thresholds(scored(spark, d).withColumn("s", F.least(F.lit(1.0), F.col("s") / 50)), "s", "y"))


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def histogram(spark, d):
    return A.histogram(table(spark, d, "orders"), "o_totalprice", 30)


@query("WITH t AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem WHERE l_returnflag = 'A') UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice)) GROUP BY 1) SELECT feature, lo, hi, min(value) AS seen_lo, max(value) AS seen_hi, sum(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END)::BIGINT AS violations FROM (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice)) JOIN t USING (feature) GROUP BY ALL")
def boundary_report(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag")
    names = ["l_quantity", "l_extendedprice"]
    ranges = li.filter("l_returnflag = 'A'").unpivot([], names, "feature", "value").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return A.boundaries(li, ranges, names)


def two_groups(spark, d):
    g = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return table(spark, d, "orders").select("o_orderpriority", F.round("o_totalprice", -2).alias("v"), g.alias("g"), "o_custkey").filter("g IS NOT NULL")


_TWO = "two AS (SELECT o_orderpriority, round(o_totalprice, -2) AS v, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS g FROM orders WHERE o_orderstatus IN ('F', 'O'))"


@query(f"WITH {_TWO}, a AS (SELECT o_orderpriority, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, avg(v) FILTER (g = 1) AS m1, avg(v) FILTER (g = 0) AS m0, var_samp(v) FILTER (g = 1) AS v1, var_samp(v) FILTER (g = 0) AS v0 FROM two GROUP BY 1) SELECT o_orderpriority, n1, n0, round(m1, 4) AS mean1, round(m0, 4) AS mean0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 4) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM a")
def welch_test(spark, d):
    return rounded(I.welch(two_groups(spark, d), "v", "g", "o_orderpriority"))


@query(f"WITH {_TWO}, r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY v) + (count(*) OVER (PARTITION BY o_orderpriority, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY o_orderpriority, v)::DOUBLE AS t FROM two), a AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum(g)::DOUBLE AS n1, sum(r * g)::DOUBLE - sum(g)::DOUBLE * (sum(g) + 1) / 2 AS u, sum(t * t - 1) AS tied FROM r GROUP BY 1) SELECT o_orderpriority, round(u, 4) AS u, round((greatest(u, n1 * (n - n1) - u) - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - tied / (n * (n - 1)))), 4) AS z FROM a")
def mann_whitney_test(spark, d):
    return rounded(I.mann_whitney(two_groups(spark, d), "v", "g", "o_orderpriority"))


_P = "p AS (SELECT p_brand AS k, round((count(*) * 7919 % 1009) / 1009.0, 6)::DOUBLE AS p FROM part GROUP BY 1)"


def p_table(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.round((F.count("*") * 7919 % 1009) / F.lit(1009.0), 6).alias("p"))


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p) SELECT k, p, round(least(1.0, min(p * m / r) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS q FROM r")
def benjamini_hochberg(spark, d):
    out = I.benjamini_hochberg(p_table(spark, d), "p", "k")
    return out.select("k", "p", F.round("q", 4).alias("q"))


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p) SELECT k, p, round(least(1.0, max(p * (m - r + 1)) OVER (ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS holm FROM r")
def holm_correction(spark, d):
    out = I.holm(p_table(spark, d), "p", "k")
    return out.select("k", "p", F.round("holm", 4).alias("holm"))


@query()
def adjusted_effect_hc3(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_totalprice", F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("g"), (F.col("c_acctbal") / 1000).alias("bal"))
    return I.linear_effects(rows.withColumn("g_bal", F.col("g") * F.col("bal")), "o_totalprice", ["g", "bal", "g_bal"], joint=["g", "g_bal"])


_DRAW = "('0x' || substr(md5('42:' || person), 1, 8))::BIGINT"


@query(f"WITH {PAIRED}, g AS (SELECT person, row_number() OVER (ORDER BY {_DRAW}, person) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT person FROM paired)) SELECT CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT person) AS people, round(sum(y), 2) AS total FROM paired JOIN g USING (person) GROUP BY 1")
def grouped_split(spark, d):
    return R.split(paired(spark, d), "person").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"), F.round(F.sum("y"), 2).alias("total"))


@query(f"WITH {PAIRED}, g AS (SELECT person, count(*) AS n FROM paired GROUP BY 1), r AS (SELECT person, n, row_number() OVER (ORDER BY n DESC, {_DRAW}, person) - 1 AS pos FROM g) SELECT (CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END)::INT AS fold, count(*) AS people, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def grouped_folds(spark, d):
    return R.folds(paired(spark, d).select("person"), "person").groupBy("fold").agg(F.count_distinct("person").alias("people"), F.count("*").alias("n"))


@query("WITH g AS (SELECT o_custkey AS person, max(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END) AS c FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ('0x' || substr(md5('42:' || person), 1, 8))::BIGINT, person) - 1 AS pos FROM g) SELECT (pos % 5)::INT AS fold, count(DISTINCT person) AS people, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END)::BIGINT AS ones FROM r GROUP BY 1")
def class_folds(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("c"))
    each = R.class_folds(rows, "person", "c").groupBy("fold", "person").agg(F.max("c").alias("c"))
    return each.groupBy("fold").agg(F.count("*").alias("people"), F.sum("c").alias("ones"))


@query(f"WITH {PAIRED}, r AS (SELECT flag, abs(p - y) AS e, row_number() OVER (PARTITION BY flag ORDER BY abs(p - y)) AS r, count(*) OVER (PARTITION BY flag) AS n FROM paired) SELECT flag, n, round(e, 4) AS q FROM r WHERE r = ceil(least(1.0::DOUBLE, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1")
def conformal_width(spark, d):
    return rounded(R.conformal(paired(spark, d).withColumn("e", F.col("p") - F.col("y")), "e", 0.1, False, "flag"))


def mix_sql(name: str, source: str, column: str, keep: str) -> str:
    """Tables that put splitmix64's output function of a column of UBIGINT in its place."""
    times = lambda c: f"(({{}})::UHUGEINT * {c}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""{name}_a AS (SELECT {keep}, {times(0xBF58476D1CE4E5B9).format(f"xor({column}, {column} >> 30)")} AS {column} FROM {source}),
{name}_b AS (SELECT {keep}, {times(0x94D049BB133111EB).format(f"xor({column}, {column} >> 27)")} AS {column} FROM {name}_a), {name} AS (SELECT {keep}, xor({column}, {column} >> 31) AS {column} FROM {name}_b)"""


#: As draws fall: on the people in the order of their hash.
_DRAWN = f"""WITH {PAIRED}, s AS (SELECT person, count(*) AS n, sum(y) AS y, sum(p) AS p, sum(y * y) AS yy, sum(p * p) AS pp, sum(y * p) AS yp, sum(p - y) AS e, sum(abs(p - y)) AS ae, sum((p - y) * (p - y)) AS ee FROM paired GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY {_DRAW}, person) AS r, count(*) OVER () AS g FROM s),
z AS (SELECT b, (42 * 4294967296 + b)::UBIGINT AS h FROM range(%d) AS t(b)), {(mix_sql("z1", "z", "h", "b") + ", " + mix_sql("z2", "z1", "h", "b")).replace("%", "%%")},
v AS (SELECT b, g, ((h::UHUGEINT + 11400714819323198485::UHUGEINT * j::UHUGEINT) %% 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM z2, (SELECT g, unnest(range(1, g + 1)) AS j FROM (SELECT max(g) AS g FROM k))),
{mix_sql("v1", "v", "h", "b, g").replace("%", "%%")},
w AS (SELECT b AS replicate, (h %% g::UBIGINT)::BIGINT + 1 AS r, count(*) AS w FROM v1 GROUP BY 1, 2),
t AS (SELECT replicate, sum(n * w)::BIGINT AS n, sum(y * w) AS y, sum(p * w) AS p, sum(yy * w) AS yy, sum(pp * w) AS pp, sum(yp * w) AS yp, sum(e * w) AS e, sum(ae * w) AS ae, sum(ee * w) AS ee FROM k JOIN w USING (r) GROUP BY 1)
"""


@query(_DRAWN % 20 + """SELECT replicate, n, round(sqrt(ee / n), 3) AS rmse, round(ae / n, 3) AS mae, round(e / n, 3) AS bias, round(2 * (yp - y * p / n) / (n - 1) / ((yy - y * y / n) / (n - 1) + (pp - p * p / n) / (n - 1) + pow(e / n, 2)), 3) AS ccc FROM t""")
def cluster_bootstrap(spark, d):
    return rounded(R.bootstrap(paired(spark, d), "person", "y", "p", 20), 3)


@query(_DRAWN % 100 + """, m AS (SELECT sqrt(ee / n) AS rmse, ae / n AS mae, e / n AS bias, 2 * (yp - y * p / n) / (n - 1) / ((yy - y * y / n) / (n - 1) + (pp - p * p / n) / (n - 1) + pow(e / n, 2)) AS ccc FROM t)
SELECT metric, count(*) AS requested, count(value) AS valid, round(quantile_cont(value, 0.025), 3) AS low, round(quantile_cont(value, 0.5), 3) AS median, round(quantile_cont(value, 0.975), 3) AS high FROM m UNPIVOT (value FOR metric IN (rmse, mae, bias, ccc)) GROUP BY 1""")
def bootstrap_intervals(spark, d):
    return rounded(R.replicate_summary(R.bootstrap(paired(spark, d), "person", "y", "p", 100), ["rmse", "mae", "bias", "ccc"]), 3)


@query(f"WITH {PAIRED}, g AS (SELECT person, row_number() OVER (ORDER BY {_DRAW}, person) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT person FROM paired)), s AS (SELECT *, r <= ceil(n * 0.2::DOUBLE) AS test FROM paired JOIN g USING (person)), e AS (SELECT priority FROM s WHERE NOT test GROUP BY 1 HAVING count(*) >= 2000 AND count(DISTINCT person) >= 2) SELECT coalesce(e.priority, 'GLOBAL') AS route, count(*) AS n FROM s LEFT JOIN e USING (priority) WHERE test GROUP BY 1")
def stratum_routing(spark, d):
    s = R.split(paired(spark, d), "person")
    return R.routes(s.filter("split = 'train'"), s.filter("split = 'test'"), "priority", "person", 2000).groupBy("route").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT 'P' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '-1' ELSE '' END AS id FROM orders), dd AS (SELECT DISTINCT 'P' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '-1' ELSE '' END AS id FROM customer), one AS (SELECT split_part(id, '-', 1) AS b, min(id) AS o FROM dd GROUP BY 1 HAVING count(*) = 1) SELECT CASE WHEN dd.id IS NOT NULL THEN 'exact' WHEN one.o IS NOT NULL THEN 'completed' ELSE 'unresolved' END AS matched, count(*) AS n, count(DISTINCT coalesce(dd.id, one.o, c.id)) AS ids FROM c LEFT JOIN dd ON c.id = dd.id LEFT JOIN one ON split_part(c.id, '-', 1) = one.b GROUP BY 1")
def key_completion(spark, d):
    mark = lambda c, n: F.concat(F.lit("p"), F.col(c).cast("string"), F.when(F.col(c) % n == 0, "-1").otherwise(""))
    clinical = table(spark, d, "orders").select(mark("o_custkey", 3).alias("id"))
    digital = table(spark, d, "customer").select(mark("c_custkey", 2).alias("id"))
    return K.complete_keys(clinical, digital, "id").groupBy("matched").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("WITH a AS (SELECT * FROM orders WHERE o_orderkey % 89 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0), j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_totalprice IS DISTINCT FROM b.o_totalprice AS x, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS y FROM a FULL JOIN b USING (o_orderkey)) SELECT 'added' AS change, count(*) FILTER (ka IS NULL) AS n FROM j UNION ALL SELECT 'removed', count(*) FILTER (kb IS NULL) FROM j UNION ALL SELECT 'common', count(*) FILTER (ka = kb) FROM j UNION ALL SELECT 'changed_o_totalprice', count(*) FILTER (ka = kb AND x) FROM j UNION ALL SELECT 'changed_o_orderstatus', count(*) FILTER (ka = kb AND y) FROM j")
def version_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.filter("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return K.diff(o.filter("o_orderkey % 89 <> 0"), new, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("WITH u AS (SELECT * FROM (SELECT 'customer' AS source_sheet, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier)) SELECT source_sheet, count(*) AS n, count(segment) AS segments, round(sum(acctbal), 2) AS total FROM u GROUP BY 1")
def sheet_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return K.sheets({"customer": c, "supplier": s}).groupBy("source_sheet").agg(F.count("*").alias("n"), F.count("segment").alias("segments"), F.round(F.sum("acctbal"), 2).alias("total"))


@query("SELECT o_orderstatus AS \"group\", variable, count(*) AS rows_with_key, count(DISTINCT o_custkey) AS keys, count(value) FILTER (value IS NOT NULL) AS finite, 0::BIGINT AS empty, 0::BIGINT AS invalid, count(*) FILTER (value <= 0) AS not_positive FROM (SELECT o_orderstatus, o_custkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey) UNPIVOT (value FOR variable IN (o_totalprice, c_acctbal)) GROUP BY 1, 2")
def column_audit(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return Q.audit(rows, "o_custkey", "o_orderstatus", ["o_totalprice", "c_acctbal"])


@query("SELECT 'not_positive' AS rule, count(*) FILTER (c_acctbal <= 0) AS violations FROM customer UNION ALL SELECT 'segment_domain', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer UNION ALL SELECT 'no_key', count(*) FILTER (c_custkey IS NULL) FROM customer")
def expectations(spark, d):
    return Q.expect(table(spark, d, "customer"), {"not_positive": F.col("c_acctbal") <= 0, "segment_domain": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "no_key": F.col("c_custkey").isNull()})


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS s FROM orders)
SELECT count(*) AS rows, sum(('0x' || substr(s, 1, 15))::BIGINT)::VARCHAR AS total, bit_xor(('0x' || substr(s, 1, 15))::BIGINT) AS first, bit_xor(('0x' || substr(s, 16, 15))::BIGINT) AS second FROM h""")
def content_fingerprint(spark, d):
    return Q.fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("""WITH t AS (SELECT user_id, event_type = 'error' AS e, ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
c AS (SELECT user_id, count(*) FILTER (t = 1 AND NOT e)::DOUBLE AS d1, count(*) FILTER (t = 2 AND NOT e)::DOUBLE AS d2, count(*) FILTER (t = 3 AND NOT e)::DOUBLE AS d3, count(*) FILTER (t = 1 AND e)::DOUBLE AS e1, count(*) FILTER (t = 2 AND e)::DOUBLE AS e2, count(*) FILTER (t = 3 AND e)::DOUBLE AS e3 FROM t GROUP BY 1)
SELECT user_id, d1 + d2 + d3 AS sdmt_fatigue_correct_total_terciles, d3 - d1 AS sdmt_fatigue_correct_last_minus_first, round(d3 / nullif(d1, 0), 4) AS sdmt_fatigue_correct_last_over_first, (d3 - d1) / 2 AS sdmt_fatigue_correct_slope,
d2 - d1 AS sdmt_fatigue_correct_mid_drop, d3 - d2 AS sdmt_fatigue_correct_end_drop, e1 + e2 + e3 AS sdmt_fatigue_error_total_terciles, e3 - e1 AS sdmt_fatigue_error_last_minus_first, round(e3 / nullif(e1, 0), 4) AS sdmt_fatigue_error_last_over_first,
(e3 - e1) / 2 AS sdmt_fatigue_error_slope, round(d3 / nullif(d3 + e3, 0) - d1 / nullif(d1 + e1, 0), 4) AS sdmt_fatigue_accuracy_last_minus_first, round(d3 / nullif(d3 + e3, 0) / nullif(d1 / nullif(d1 + e1, 0), 0), 4) AS sdmt_fatigue_accuracy_last_over_first FROM c""")
def session_fatigue(spark, d):
    out = X.fatigue(X.terciles(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error"))
    return rounded(out.drop(*X.RIGHT, *X.WRONG))


_SPLIT_SQL = "s AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, nullif(l_quantity, 1)::DOUBLE AS q, l_extendedprice::DOUBLE AS x, l_returnflag AS flag FROM lineitem)"


def split_lines(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"), F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("q"), F.col("l_extendedprice").alias("x"), F.col("l_returnflag").alias("flag"))


@query(f"WITH {_SPLIT_SQL}, m AS (SELECT avg(q) AS m, stddev_pop(q) AS d FROM (SELECT coalesce(q, (SELECT avg(q) FROM s WHERE split = 'train')) AS q, split FROM s) WHERE split = 'train') SELECT split, flag, count(*) AS n, round(avg((coalesce(q, (SELECT avg(q) FROM s WHERE split = 'train')) - m) / d), 4) AS q, round(avg(ln(1 + x)), 4) AS x FROM s, m GROUP BY 1, 2")
def train_fitted_features(spark, d):
    out = X.log_transform(X.standardize(X.impute_mean(split_lines(spark, d), ["q"]), ["q"]), ["x"])
    return out.groupBy("split", "flag").agg(F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("q"), F.round(F.avg("x"), 4).alias("x"))


@query(f"WITH {_SPLIT_SQL} SELECT split, count(*) AS n, round(sum(coalesce(q, (SELECT median(q) FROM s WHERE split = 'train'))), 2) AS total FROM s GROUP BY 1")
def median_imputation(spark, d):
    return X.impute_median(split_lines(spark, d), ["q"]).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("total"))


@query(f"WITH {_SPLIT_SQL} SELECT flag, sum(CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE AS a, sum(CASE WHEN flag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS n, sum(CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS r FROM s GROUP BY 1")
def one_hot_levels(spark, d):
    out = X.one_hot(split_lines(spark, d), ["flag"])
    return out.groupBy("flag").agg(F.sum("flag_A").alias("a"), F.sum("flag_N").alias("n"), F.sum("flag_R").alias("r"))


@query("WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mx, stddev_pop(l_extendedprice) AS sx FROM lineitem) SELECT l_returnflag, round(avg(((l_quantity - mq) / sq + (l_extendedprice - mx) / sx) / 2), 4) AS proxy FROM lineitem, m GROUP BY 1")
def target_proxy(spark, d):
    return X.target_proxy(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).groupBy("l_returnflag").agg(F.round(F.avg("proxy"), 4).alias("proxy"))


@query("WITH r AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1), b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM r) SELECT o_orderstatus, count(*) AS n FROM orders, b WHERE o_totalprice BETWEEN lo AND hi GROUP BY 1")
def common_support(spark, d):
    return X.common_support(table(spark, d, "orders"), "o_totalprice", "o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN a BETWEEN 0 AND 39.999 THEN '<40' WHEN a > 39.999 AND a <= 54.999 THEN '40-54' WHEN a > 54.999 AND a <= 120 THEN '55+' END AS age_band, CASE WHEN a >= 0 AND a < 40 THEN '<40' WHEN a >= 40 AND a < 55 THEN '40-54' WHEN a >= 55 THEN '55+' END AS left_closed, count(*) AS n FROM (SELECT l_quantity + 20.5 AS a FROM lineitem) GROUP BY 1, 2")
def bands(spark, d):
    a = table(spark, d, "lineitem").select((F.col("l_quantity") + 20.5).alias("a"))
    return a.groupBy(C.age_band(F.col("a")).alias("age_band"), C.cut(F.col("a"), [0, 40, 55, float("inf")], ["<40", "40-54", "55+"], False).alias("left_closed")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, l_shipdate FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderdate FROM orders) o JOIN (SELECT DISTINCT o_custkey AS k, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) v ON o.o_custkey = v.k WHERE abs(date_diff('day', o_orderdate, l_shipdate)) <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)), l_shipdate) AS r FROM c) SELECT o_orderkey, l_shipdate AS visit FROM orders LEFT JOIN (SELECT o_orderkey, l_shipdate FROM r WHERE r = 1) USING (o_orderkey)")
def nearest_visit(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    visits = table(spark, d, "lineitem").join(o.select("o_custkey", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_shipdate").alias("visit")).distinct()
    return K.nearest(o, visits, "o_custkey", "o_orderdate", "visit", 30).select("o_orderkey", "visit")


@query("SELECT lang, count(*) AS n, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, round(sum(v), 2) AS total FROM (SELECT lang, try_cast(replace(CASE WHEN s LIKE '%,%' AND s LIKE '%.%' THEN replace(s, '.', '') ELSE s END, ',', '.') AS DOUBLE) AS v FROM (SELECT lang, CASE n_chars % 3 WHEN 0 THEN '1.' || n_chars || ',5' WHEN 1 THEN n_chars || ',25' ELSE 'N/A' END AS s FROM documents)) GROUP BY 1")
def european_numbers(spark, d):
    s = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("1."), F.col("n_chars").cast("string"), F.lit(",5"))).when(F.col("n_chars") % 3 == 1, F.concat(F.col("n_chars").cast("string"), F.lit(",25"))).otherwise("N/A")
    v = C.number(C.nulled(s))
    return table(spark, d, "documents").select("lang", v.alias("v")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("v").isNull().cast("int")).alias("missing"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def simple_least_squares(spark, d):
    m = I.gram(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])[()]
    b = I.least_squares(m)
    return spark.createDataFrame([(round(float(b[1]), 4), round(float(b[0]), 2))], "slope double, intercept double")


@query("WITH f AS (SELECT o_custkey % 5 AS fold, o_totalprice AS y FROM orders), s AS (SELECT fold, count(*) AS n, sum(y) AS t FROM f GROUP BY 1) SELECT s.fold::INT AS fold, round(((SELECT sum(t) FROM s) - t) / ((SELECT sum(n) FROM s) - n), 4) AS mean FROM s")
def fold_mean_predictor(spark, d):
    each = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    whole = each.agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    return each.crossJoin(F.broadcast(whole)).select("fold", F.round((F.col("all_t") - F.col("t")) / (F.col("all_n") - F.col("n")), 4).alias("mean"))


def balances(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select((F.col("o_custkey") % 5).cast("int").alias("fold"), (F.col("o_custkey") % 7 % 3).cast("int").alias("inner"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("g"), (F.col("c_acctbal") / 1000).alias("x"), F.col("o_totalprice").alias("y"))


@query("WITH r AS (SELECT (o_custkey % 5)::INT AS fold, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS g, c_acctbal / 1000 AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT DISTINCT fold AS f FROM r), m AS (SELECT f, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10) AS w FROM r JOIN k ON fold <> f WHERE g = 0 GROUP BY f) SELECT fold, g, count(*) AS n, round(avg(my + w * (x - mx) - y), 2) AS deviation FROM r JOIN m ON fold = f GROUP BY 1, 2")
def normative_deviation(spark, d):
    out = M.normative_deviation(balances(spark, d), ["x"], "y", "g", "fold")
    return out.groupBy("fold", "g").agg(F.count("*").alias("n"), F.round(F.avg("deviation"), 2).alias("deviation"))


def _ridge_sql(name: str, sums: str, source: str) -> str:
    """A table of ridge lines (w on x, v on g, c) from sums of products of the rows fitted, by the keys named."""
    return f"""{name}_s AS ({source}), {name}_c AS (SELECT *, sxx - sx * sx / n + a AS xx, sgg - sg * sg / n + a AS gg, sxg - sx * sg / n AS xg, sxy - sx * sy / n AS xy, sgy - sg * sy / n AS gy FROM {name}_s, (SELECT unnest([0.1, 1, 10, 100]::DOUBLE[]) AS a)),
{name} AS (SELECT {sums}, a, (xy * gg - gy * xg) / (xx * gg - xg * xg) AS w, (gy * xx - xy * xg) / (xx * gg - xg * xg) AS v, sy / n - (xy * gg - gy * xg) / (xx * gg - xg * xg) * sx / n - (gy * xx - xy * xg) / (xx * gg - xg * xg) * sg / n AS c FROM {name}_c)"""


_SUMS = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(g)::DOUBLE AS sg, sum(y) AS sy, sum(x * x) AS sxx, sum(x * g) AS sxg, sum(g * g)::DOUBLE AS sgg, sum(x * y) AS sxy, sum(g * y) AS sgy"


@query(f"""WITH r AS (SELECT (o_custkey % 5)::INT AS fold, (o_custkey % 7 % 3)::INT AS i, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS g, c_acctbal / 1000 AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT DISTINCT fold AS o FROM r), l AS (SELECT DISTINCT i AS j FROM r), {_ridge_sql("inner_", "o, j", f"SELECT o, j, {_SUMS} FROM k, l, r WHERE fold <> o AND i <> j GROUP BY o, j")},
e AS (SELECT o, a, avg(abs(w * x + v * g + c - y)) AS mae FROM inner_ JOIN r ON i = j AND fold <> o GROUP BY 1, 2), b AS (SELECT o, a FROM e QUALIFY row_number() OVER (PARTITION BY o ORDER BY mae, a) = 1),
{_ridge_sql("outer_", "o", f"SELECT o, {_SUMS} FROM k, r WHERE fold <> o GROUP BY o")}
SELECT fold, a AS alpha, count(*) AS n, round(avg(abs(w * x + v * g + c - y)), 2) AS mae FROM r JOIN b ON b.o = fold JOIN outer_ f USING (o, a) GROUP BY 1, 2""")
def nested_ridge(spark, d):
    out = M.nested_ridge(balances(spark, d), ["x", "g"], "y", "fold", "inner")
    return out.groupBy("fold", "alpha").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 2).alias("mae"))


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity / nullif(l_linenumber - 1, 0)), 3) AS ratio, round(sum(l_quantity - (l_linenumber - 1)), 3) AS difference,
round(sum(l_discount / nullif(l_tax, 0)), 3) AS pressure_per_lift, round(sum(l_discount * l_tax), 3) AS interaction, round(sum(l_tax / nullif(l_linenumber - 1, 0)), 3) AS lift_per_flight FROM lineitem GROUP BY 1""")
def kinematic_features(spark, d):
    lines = table(spark, d, "lineitem").withColumn("flight", F.col("l_linenumber") - 1)
    out = X.kinematic(lines, {"inside_circle_time": "l_quantity", "flight_time": "flight", "pressure_mean": "l_discount", "finger_lift_rate": "l_tax"})
    sums = {"ratio": "circle_to_flight_ratio", "difference": "circle_minus_flight", "pressure_per_lift": "pressure_per_lift", "interaction": "pressure_lift_interaction", "lift_per_flight": "lift_per_flight"}
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.round(F.sum(f"tmt_kinematic_{c}"), 3).alias(n) for n, c in sums.items()])


_RESULTS_SQL = """r AS (SELECT 'm' || o_custkey || CASE o_custkey % 3 WHEN 0 THEN '_sdmt_paper_score' WHEN 1 THEN '_tmt_paper_score_b' ELSE '_tmt' END AS model, o_orderkey AS timestamp, o_totalprice::DOUBLE AS rmse, (o_orderkey % 7)::DOUBLE AS mae,
o_orderkey % 11 / 10.0::DOUBLE - 0.1 AS r2, o_custkey % 10 / 10.0::DOUBLE AS ccc, CASE WHEN o_orderkey % 5 <> 0 THEN 0.75::DOUBLE END AS icc FROM orders),
l AS (SELECT *, CASE WHEN lower(model) LIKE '%sdmt%' THEN 'SDMT' WHEN lower(model) LIKE '%tmt%' THEN 'TMT' ELSE 'Unknown' END AS assessment,
CASE WHEN model LIKE '%sdmt_paper_score' THEN 'sdmt_paper_score' WHEN model LIKE '%tmt_paper_score_b' THEN 'tmt_paper_score_b' ELSE model END AS target,
CASE WHEN r2 < 0 OR ccc < 0.4 THEN 'Needs major improvement' WHEN ccc < 0.7 OR icc < 0.7 THEN 'Exploratory / moderate' ELSE 'Promising for discussion' END AS clinical_status FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY timestamp DESC) = 1)"""


def run_results(spark, d):
    o, suffix = table(spark, d, "orders"), F.when(F.col("o_custkey") % 3 == 0, "_sdmt_paper_score").when(F.col("o_custkey") % 3 == 1, "_tmt_paper_score_b").otherwise("_tmt")
    return o.select(F.concat(F.lit("m"), F.col("o_custkey").cast("string"), suffix).alias("model"), F.col("o_orderkey").alias("timestamp"), F.col("o_totalprice").cast("double").alias("rmse"), (F.col("o_orderkey") % 7).cast("double").alias("mae"), ((F.col("o_orderkey") % 11) / 10.0 - 0.1).alias("r2"), ((F.col("o_custkey") % 10) / 10.0).alias("ccc"), F.when(F.col("o_orderkey") % 5 != 0, 0.75).alias("icc"))


@query(f"WITH {_RESULTS_SQL} SELECT assessment, clinical_status, count(*) AS models, round(sum(rmse), 2) AS rmse FROM l GROUP BY 1, 2")
def discussion_metrics(spark, d):
    return D.global_metrics(run_results(spark, d)).groupBy("assessment", "clinical_status").agg(F.count("*").alias("models"), F.round(F.sum("rmse"), 2).alias("rmse"))


@query(f"WITH {_RESULTS_SQL} SELECT model, assessment, target, round(rmse, 2) AS rmse FROM l QUALIFY row_number() OVER (PARTITION BY assessment, target ORDER BY rmse, mae, ccc DESC) = 1")
def discussion_best(spark, d):
    return D.best_by_target(D.global_metrics(run_results(spark, d))).select("model", "assessment", "target", F.round("rmse", 2).alias("rmse"))


def fold_errors(frame, *by):
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 1).alias("mae"))


def eliminated_sql(n: int, source: str, keep: str) -> str:
    """Tables e0, e1, ... that solve n linear equations by elimination, from columns a<row>_<column> of source, a<row>_<n> the right side."""
    out, before = [], source
    for k in range(n):
        entry = lambda i, j, k=k: f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}"
        out.append(f"e{k} AS (SELECT {keep}, {', '.join(f'{entry(i, j)} AS a{i}_{j}' for i in range(n) for j in range(n + 1))} FROM {before})")
        before = f"e{k}"
    return ", ".join(out)


def spline_sql(j: int, knots: int = 5, degree: int = 3) -> str:
    """Basis function j of a uniform spline of x between lo and hi."""
    u = f"((least(greatest(x, lo), hi) - lo) / ((hi - lo) / {knots - 1}) + {degree - j})"
    powers = " + ".join(f"{(-1) ** i * math.comb(degree + 1, i)} * pow(greatest({u} - {i}, 0), {degree})" for i in range(degree + 1))
    return f"CASE WHEN {u} > 0 AND {u} < {degree + 1} THEN ({powers}) / {math.factorial(degree)} ELSE 0 END"


_TERMS = range(6)


@query(f"""WITH r AS (SELECT (o_custkey % 5)::INT AS fold, c_acctbal / 1000 AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT min(x) AS lo, max(x) AS hi FROM r WHERE fold <> 0),
t AS (SELECT fold, y, {', '.join(f"{spline_sql(j)} AS t{j}" for j in _TERMS)} FROM r, b),
m AS (SELECT avg(y) AS my, {', '.join(f"avg(t{i}) AS m{i}" for i in _TERMS)}, {', '.join(f"covar_pop(t{i}, {'y' if j == 6 else f't{j}'}) * count(*) + {int(i == j)} AS a{i}_{j}" for i in _TERMS for j in range(7))} FROM t WHERE fold <> 0),
{eliminated_sql(6, "m", "my, " + ", ".join(f"m{i}" for i in _TERMS))}
SELECT fold, count(*) AS n, round(avg(abs(my + {' + '.join(f"a{i}_6 * (t{i} - m{i})" for i in _TERMS)} - y)), 1) AS mae FROM t, e5 GROUP BY 1""")
def spline_additive_model(spark, d):
    rows = balances(spark, d)
    return fold_errors(L.spline_gam(rows.filter("fold <> 0"), ["x"], "y").transform(rows), "fold")


@query()
def stacked_models(spark, d):
    rows, small = balances(spark, d), {"rf": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 5}}
    return fold_errors(L.stack(rows.filter("fold <> 0"), ["x", "g"], "y", "inner", options=small).transform(rows), "fold")


@query()
def hyperparameter_search(spark, d):
    tried = L.search(balances(spark, d), "rf", ["x", "g"], "y", "inner", {"numTrees": [5, 10], "maxDepth": [2, 4]})[3]
    return tried.select(F.element_at("settings", "numTrees").alias("trees"), F.element_at("settings", "maxDepth").alias("depth"), F.round("rmse", 1).alias("rmse"))


def order_lines(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") - 1).alias("further"), F.avg("l_discount").alias("discount"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("price", F.col("o_totalprice").cast("double"))


@query()
def count_classes(spark, d):
    rows = order_lines(spark, d)
    out = L.count_classifier(rows.filter("o_custkey % 5 <> 0"), ["price", "discount"], "further", numTrees=10, maxDepth=6).transform(rows)
    return out.groupBy("further", "prediction").agg(F.count("*").alias("n"))


@query()
def feature_elimination(spark, d):
    lines, features = table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
    left = L.eliminate(lines, features, "l_extendedprice", most=2, least=2, step=0.5, trees=10, depth=5)
    return spark.createDataFrame([(k, f) for k, f in enumerate(left)], "place int, feature string")


def _plane(y: str) -> str:
    """A least squares plane of y on x and g, averaged by further lines, from the rows r."""
    c = lambda u, v: f"covar_pop({u}, {v})"
    det = f"({c('x', 'x')} * {c('g', 'g')} - {c('x', 'g')} * {c('x', 'g')})"
    return f"SELECT avg({y}) AS m, avg(x) AS mx, avg(g) AS mg, ({c('x', y)} * {c('g', 'g')} - {c('g', y)} * {c('x', 'g')}) / {det} AS w, ({c('g', y)} * {c('x', 'x')} - {c('x', y)} * {c('x', 'g')}) / {det} AS v FROM r"


@query(f"""WITH r AS (SELECT further, further::DOUBLE AS x, discount AS g, o_totalprice::DOUBLE AS price, o_custkey::DOUBLE AS custkey FROM orders JOIN (SELECT l_orderkey, count(*) - 1 AS further, avg(l_discount) AS discount FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
p AS ({_plane("price")}), k AS ({_plane("custkey")})
SELECT further, count(*) AS n, round(avg(p.m + p.w * (x - p.mx) + p.v * (g - p.mg)), 1) AS price, round(avg(k.m + k.w * (x - k.mx) + k.v * (g - k.mg)), 2) AS custkey FROM r, p, k GROUP BY 1""")
def several_outputs(spark, d):
    rows = order_lines(spark, d)
    out = L.predict_several(rows, L.several_outputs(rows, "linear", ["further", "discount"], ["price", "o_custkey"]))
    return out.groupBy("further").agg(F.count("*").alias("n"), F.round(F.avg("prediction_price"), 1).alias("price"), F.round(F.avg("prediction_o_custkey"), 2).alias("custkey"))
