"""Registered queries of models by stratum, of several outputs, of quantiles and of cross-fitted deviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import crossfit as V
from ..operators import discrimination as D
from ..operators import quantiles as U
from ..operators import resample as R
from ..operators import strata as S
from .catalogue import _DRAW, _SUMS, balances, mix_sql
from .clinical import buyers
from .registry import query, rounded, table


def ridge_lines(name: str, keys: str, source: str, alpha: str = "1.0") -> str:
    """A table of ridge lines (w on x, v on g, c) by keys from a table of sums of products."""
    return f"""{name}_c AS (SELECT *, sxx - sx * sx / n + {alpha} AS xx, sgg - sg * sg / n + {alpha} AS gg, sxg - sx * sg / n AS xg, sxy - sx * sy / n AS xy, sgy - sg * sy / n AS gy FROM ({source})),
{name} AS (SELECT {keys}, (xy * gg - gy * xg) / (xx * gg - xg * xg) AS w, (gy * xx - xy * xg) / (xx * gg - xg * xg) AS v, sy / n - (xy * gg - gy * xg) / (xx * gg - xg * xg) * sx / n - (gy * xx - xy * xg) / (xx * gg - xg * xg) * sg / n AS c FROM {name}_c)"""


_VISITS = f"""v AS (SELECT o_custkey AS person, nullif(o_orderpriority, '3-MEDIUM') AS k, l_quantity AS x, l_discount * 100 AS g, l_extendedprice / 1000 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT person, row_number() OVER (ORDER BY {_DRAW}, person) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS test FROM (SELECT DISTINCT person FROM v)), train AS (SELECT v.* FROM v JOIN p USING (person) WHERE NOT test), test AS (SELECT v.* FROM v JOIN p USING (person) WHERE test)"""


def visits(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.col("o_custkey").alias("person"), F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("g"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"))
    split = R.split(rows, "person")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


#: Of the four strata with a name, those with a larger share of the training rows than this have models of their own.
_LEAST = "(SELECT count(*) FROM train) * 0.2::DOUBLE"


@query(f"""WITH {_VISITS}, {ridge_lines("f", "k", f"SELECT k, {_SUMS} FROM train WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= {_LEAST} AND count(DISTINCT person) >= 2 UNION ALL SELECT 'GLOBAL', {_SUMS} FROM train")}
SELECT f.k AS route, count(*) AS n, round(avg(w * x + v * g + c), 4) AS prediction, round(avg(abs(w * x + v * g + c - y)), 4) AS mae, 0::BIGINT AS missing FROM test JOIN f ON f.k = coalesce((SELECT e.k FROM f e WHERE e.k = test.k), 'GLOBAL') GROUP BY 1""")
def stratum_models(spark, d):
    train, test = visits(spark, d)
    out = S.stratum_models(train, ["x", "g"], ["y"], "k", "person", least_rows=-(-train.count() // 5)).predict(test, strict=True)
    return out.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 4).alias("prediction"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 4).alias("mae"), F.count_if(F.col("prediction").isNull()).alias("missing"))


@query(f"""WITH {_VISITS}, own AS (SELECT k, person, row_number() OVER (PARTITION BY k ORDER BY {_DRAW}, person) <= ceil(count(*) OVER (PARTITION BY k) * 0.2::DOUBLE) AS held FROM (SELECT DISTINCT k, person FROM train WHERE k IS NOT NULL)),
whole AS (SELECT person, row_number() OVER (ORDER BY {_DRAW}, person) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS held FROM (SELECT DISTINCT person FROM train)),
part AS (SELECT train.k, held, x, g, y FROM train JOIN own ON train.k = own.k AND train.person = own.person UNION ALL SELECT 'GLOBAL', held, x, g, y FROM train JOIN whole USING (person)),
{ridge_lines("f", "k", f"SELECT k, {_SUMS} FROM part WHERE NOT held GROUP BY k")},
e AS (SELECT k, abs(w * x + v * g + c - y) AS e, row_number() OVER (PARTITION BY k ORDER BY abs(w * x + v * g + c - y)) AS r, count(*) OVER (PARTITION BY k) AS n FROM part JOIN f USING (k) WHERE held),
q AS (SELECT k, e AS q FROM e WHERE r = ceil(least(1.0::DOUBLE, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1)
SELECT f.k AS route, count(*) AS n, round(avg(CASE WHEN y BETWEEN w * x + v * g + c - q AND w * x + v * g + c + q THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(max(q), 4) AS width FROM test JOIN f ON f.k = coalesce(test.k, 'GLOBAL') JOIN q ON q.k = f.k GROUP BY 1""")
def stratum_intervals(spark, d):
    train, test = visits(spark, d)
    out = S.stratum_models(train, ["x", "g"], ["y"], "k", "person", miscoverage=0.1).predict(test)
    inside = F.avg(F.when(F.col("y").between(F.col("low"), F.col("high")), 1.0).otherwise(0.0))
    return out.groupBy("route").agg(F.count("*").alias("n"), F.round(inside, 4).alias("coverage"), F.round(F.max(F.col("high") - F.col("low")) / 2, 4).alias("width"))


def _newton(shares: list[float], steps: int = 2, halvings: int = 6) -> str:
    """Steps of quantile lines on one scaled feature z, from least squares: tables b0, b1, ... of (t, a, b)."""
    out = [f"b0 AS (SELECT unnest({shares}::DOUBLE[]) AS t, my AS a, czy AS b FROM m)"]
    for k in range(steps * halvings):
        h = f"(s / {2 ** (k // steps + 1)})"
        out.append(f"u{k} AS (SELECT t, z, s, 1 / (1 + exp(least(greatest((y - a - b * z) / {h}, -30), 30))) AS u FROM b{k}, fit, m)")
        out.append(f"g{k} AS (SELECT t, sum(t - u) AS g0, sum((t - u) * z) AS g1, sum(u * (1 - u)) / max{h} + 1e-6 * count(*) / max{h} AS h00, sum(u * (1 - u) * z) / max{h} AS h01, sum(u * (1 - u) * z * z) / max{h} + 1e-6 * count(*) / max{h} AS h11 FROM u{k} GROUP BY t)")
        out.append(f"b{k + 1} AS (SELECT t, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a, b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS b FROM b{k} JOIN g{k} USING (t))")
    return ",\n".join(out)


@query(f"""WITH {_VISITS}, own AS (SELECT person, row_number() OVER (ORDER BY {_DRAW}, person) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS held FROM (SELECT DISTINCT person FROM train)),
c AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx FROM train JOIN own USING (person) WHERE NOT held), part AS (SELECT held, (x - mx) / dx AS z, y FROM train JOIN own USING (person), c),
fit AS (SELECT z, y FROM part WHERE NOT held), m AS (SELECT avg(y) AS my, covar_pop(z, y) AS czy, sqrt(var_pop(y) - covar_pop(z, y) * covar_pop(z, y) / var_pop(z)) AS s FROM fit),
{_newton([0.05, 0.95])},
ends AS (SELECT max(CASE WHEN t < 0.5 THEN a END) AS la, max(CASE WHEN t < 0.5 THEN b END) AS lb, max(CASE WHEN t > 0.5 THEN a END) AS ha, max(CASE WHEN t > 0.5 THEN b END) AS hb FROM b12),
e AS (SELECT greatest(la + lb * z - y, y - ha - hb * z) AS e, row_number() OVER (ORDER BY greatest(la + lb * z - y, y - ha - hb * z)) AS r, count(*) OVER () AS n FROM part, ends WHERE held),
q AS (SELECT e AS q FROM e WHERE r = ceil(least(1.0::DOUBLE, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1)
SELECT k, count(*) AS n, round(avg(CASE WHEN y BETWEEN la + lb * z - q AND ha + hb * z + q THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(ha + hb * z - la - lb * z + 2 * q), 4) AS width FROM (SELECT k, y, (x - mx) / dx AS z FROM test, c), ends, q GROUP BY 1""")
def conformal_quantiles(spark, d):
    train, test = visits(spark, d)
    out = U.conformal_quantiles(train, "person", ["x"], "y").predict(test)
    inside = F.avg(F.when(F.col("y").between(F.col("low"), F.col("high")), 1.0).otherwise(0.0))
    return out.groupBy("k").agg(F.count("*").alias("n"), F.round(inside, 4).alias("coverage"), F.round(F.avg(F.col("high") - F.col("low")), 4).alias("width"))


@query("""WITH r AS (SELECT l_quantity AS x, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 1000 END AS price, CASE WHEN l_linenumber <> 5 THEN l_tax * 100 END AS tax, l_discount * 100 AS discount FROM lineitem),
a AS (SELECT * FROM r WHERE price IS NOT NULL AND discount IS NOT NULL), b AS (SELECT * FROM r WHERE tax IS NOT NULL)
SELECT 'money' AS target_group, 'price' AS label, count(*) AS n, round(regr_intercept(price, x), 6) AS intercept, round(regr_slope(price, x), 6) AS slope FROM a UNION ALL SELECT 'money', 'discount', count(*), round(regr_intercept(discount, x), 6), round(regr_slope(discount, x), 6) FROM a
UNION ALL SELECT 'tax', 'tax', count(*), round(regr_intercept(tax, x), 6), round(regr_slope(tax, x), 6) FROM b""")
def target_group_models(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_quantity").alias("x"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000).alias("price"), F.when(F.col("l_linenumber") != 5, F.col("l_tax") * 100).alias("tax"), (F.col("l_discount") * 100).alias("discount"))
    out = S.target_groups_models(rows, ["x"], {"money": ["price", "discount"], "tax": ["tax"]}, 0.0)
    each = out.select("target_group", "n", F.posexplode("coefficients").alias("k", "b"), "labels")
    return each.select("target_group", F.get("labels", "k").alias("label"), "n", F.round(F.get("b", F.lit(0)), 6).alias("intercept"), F.round(F.get("b", F.lit(1)), 6).alias("slope"))


_BALANCES = "r AS (SELECT o_orderkey AS id, (o_custkey % 5)::INT AS fold, (o_custkey % 7 % 3)::INT AS i, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS g, c_acctbal / 1000 AS x, o_totalprice / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey)"
_CROSSED = f"""{_BALANCES}, o AS (SELECT DISTINCT fold AS held FROM r), j AS (SELECT unnest([0, 1, 2, NULL]::INT[]) AS skip),
f AS (SELECT held, skip, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10) AS w FROM r, o, j WHERE g = 0 AND fold <> held AND i IS DISTINCT FROM skip GROUP BY 1, 2),
d AS (SELECT id, held, g, CASE WHEN fold = held THEN 'test' ELSE 'train' END AS role, my + w * (x - mx) - y AS deviation FROM r JOIN f ON skip IS NOT DISTINCT FROM CASE WHEN fold <> held THEN i END),
e AS (SELECT *, deviation / (SELECT stddev_pop(deviation) FROM d b WHERE b.held = d.held AND role = 'train' AND g = 0) AS scaled FROM d)"""


@query(f"WITH {_CROSSED} SELECT held, role, g, count(*) AS n, round(avg(deviation), 4) AS deviation, round(avg(scaled), 5) AS scaled, round(stddev_samp(scaled), 5) AS sd FROM e GROUP BY 1, 2, 3")
def cross_fitted_deviation(spark, d):
    out = V.cross_fitted_deviation(balances(spark, d).withColumn("y", F.col("y") / 1000), ["x"], "y", "g", "fold", "inner")
    return out.groupBy("held", "role", "g").agg(F.count("*").alias("n"), F.round(F.avg("deviation"), 4).alias("deviation"), F.round(F.avg("scaled"), 5).alias("scaled"), F.round(F.stddev_samp("scaled"), 5).alias("sd"))


def _logistic(steps: int = 8) -> str:
    """Newton steps of logistic lines on one scaled feature z, by held fold: tables l0, l1, ... of (held, a, b)."""
    out = ["l0 AS (SELECT held, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM o)"]
    for k in range(steps):
        out.append(f"p{k} AS (SELECT z.held, z, t, 1 / (1 + exp(-(a + b * z))) AS p, b FROM z JOIN l{k} USING (held) WHERE role = 'train')")
        out.append(f"s{k} AS (SELECT held, sum(t - p) AS g0, sum((t - p) * z) - max(b) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) + 1 AS h11 FROM p{k} GROUP BY 1)")
        out.append(f"l{k + 1} AS (SELECT held, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a, b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS b FROM l{k} JOIN s{k} USING (held))")
    return ",\n".join(out)


@query(f"""WITH {_CROSSED}, c AS (SELECT held, avg(scaled) AS m, stddev_pop(scaled) AS sd FROM e WHERE role = 'train' GROUP BY 1), z AS (SELECT held, role, g AS t, (scaled - m) / sd AS z FROM e JOIN c USING (held)), {_logistic()},
k AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, s FROM (SELECT t, round(1 / (1 + exp(-(a + b * z))), 9) AS s FROM z JOIN l8 USING (held) WHERE role = 'test'))
SELECT count(*) AS n, round((sum(CASE WHEN t = 1 THEN r END) - sum(t)::DOUBLE * (sum(t) + 1) / 2) / (sum(t)::DOUBLE * (count(*) - sum(t))), 6) AS auc, round(avg(s), 6) AS score, round(avg((s - t) * (s - t)), 6) AS brier FROM k""")
def deviation_classifier(spark, d):
    rows = V.cross_fitted_deviation(balances(spark, d).withColumn("y", F.col("y") / 1000), ["x"], "y", "g", "fold", "inner")
    held = V.fold_scores(rows, ["scaled"], "g").filter("role = 'test'").select("g", F.round("score", 9).alias("score"))
    area = A.auc(held, "score", "g")
    more = held.agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.avg(F.pow(F.col("score") - F.col("g"), F.lit(2))), 6).alias("brier"))
    return area.select("n", F.round("auc", 6).alias("auc")).crossJoin(F.broadcast(more))  # one row each


@query(f"""WITH q AS (SELECT o_custkey AS person, max(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) AS g FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_DRAW}, person) AS r, count(*) OVER (PARTITION BY g) AS n FROM q),
z AS (SELECT b, (42 * 4294967296 + b)::UBIGINT AS h FROM range(10) AS t(b)), {mix_sql("z1", "z", "h", "b")}, y AS (SELECT b, g, n, ((h::UHUGEINT + g::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM z1, (SELECT DISTINCT g, n FROM k)), {mix_sql("y1", "y", "h", "b, g, n")},
v AS (SELECT b, g, n, ((h::UHUGEINT + 11400714819323198485::UHUGEINT * j::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM y1)), {mix_sql("v1", "v", "h", "b, g, n")},
w AS (SELECT b, g, (h % n::UBIGINT)::BIGINT + 1 AS r, count(*) AS w FROM v1 GROUP BY 1, 2, 3), f AS (SELECT b, g, person, w, (row_number() OVER (PARTITION BY b, g ORDER BY ('0x' || substr(md5((42 + b) || ':' || person), 1, 8))::BIGINT, person) - 1) % 5 AS fold FROM w JOIN k USING (g, r))
SELECT b::INT AS replicate, g, fold::INT AS fold, count(*) AS people, sum(w)::BIGINT AS drawn, sum(w * person)::BIGINT AS mixed FROM f GROUP BY 1, 2, 3""")
def class_bootstrap_draws(spark, d):
    people = buyers(spark, d)
    out = D.replicate_folds(D.class_bootstrap(people, "person", "g", 10), "person", "g")
    return out.groupBy("replicate", "g", "fold").agg(F.count("*").alias("people"), F.sum("w").alias("drawn"), F.sum(F.col("w") * F.col("person")).alias("mixed"))


@query("""WITH r AS (SELECT o_custkey AS person, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS c FROM orders)
SELECT coalesce(c::VARCHAR, 'none') AS class, 5::BIGINT AS folds, count(*) AS n, count(DISTINCT person) AS people, 0::BIGINT AS straddling, true AS even FROM r GROUP BY 1""")
def mixed_class_folds(spark, d):
    """People whose orders are of several states: none in two folds, and each state's rows within 3 % of a fifth in every fold."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("c"))
    out = R.mixed_class_folds(rows, "person", "c")
    name = F.coalesce(F.col("c").cast("string"), F.lit("none")).alias("class")
    twice = out.groupBy("person").agg((F.count_distinct("fold") > 1).cast("long").alias("twice")).agg(F.sum("twice").alias("straddling"))
    people = out.groupBy(name).agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"), F.count_distinct("fold").alias("folds"))
    share = out.groupBy(name, "fold").agg(F.count("*").alias("m")).groupBy("class").agg((F.max("m") / F.sum("m") < 0.23).alias("high"), (F.min("m") / F.sum("m") > 0.17).alias("low"))
    return people.join(share, "class").crossJoin(F.broadcast(twice)).select("class", "folds", "n", "people", "straddling", (F.col("high") & F.col("low")).alias("even"))
