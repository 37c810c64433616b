"""Further registered queries: codes and bands, preparation of features, gates and reports, intervals, comparisons, visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import agreement as A
from ..operators import calibrator as T
from ..operators import comparison as G
from ..operators import discrimination as D
from ..operators import features as X
from ..operators import inference as I
from ..operators import keys as K
from ..operators import preparation as P
from ..operators import quality as Q
from ..operators import resample as R
from .catalogue import PAIRED, paired
from .registry import query, rounded, table

_EDUCATION = "CASE WHEN e IN ('1', 'PRIMARIA', 'PRIMARY') THEN 'Primary' WHEN e IN ('2', 'SECUNDARIA', 'SECONDARY', 'BACHILLERATO') THEN 'Secondary' WHEN e IN ('G', 'GRADO', 'UNIVERSITARIO', 'UNIVERSIDAD', 'M', 'MASTER', 'D', 'DOCTORADO', 'PHD') THEN 'University' END"
_SPELLINGS = ["1", "primaria", " Primary ", "2", "Secundaria", "secondary", "BACHILLERATO", "g", "grado", "Universitario", "universidad", "m", "master", "D", "doctorado", "PhD", "3", "", "U"]
_SEXES = ["f", "Female", " femenino", "MUJER", "woman", "m", "male", "masculino", "Hombre ", "man", "dona", "", "x"]


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({key} % {len(values)} + 1)::INT)"


@query(f"""WITH c AS (SELECT upper(trim({_pick_sql(_SPELLINGS, 'c_custkey')})) AS e, lower(trim({_pick_sql(_SEXES, 'c_custkey')})) AS s FROM customer)
SELECT {_EDUCATION} AS education_band, CASE WHEN s IN ('f', 'female', 'femenino', 'mujer', 'woman') THEN 1.0::DOUBLE WHEN s IN ('m', 'male', 'masculino', 'hombre', 'man') THEN 0.0::DOUBLE END AS sex_binary, count(*) AS n FROM c GROUP BY 1, 2""")
def coded_covariates(spark, d):
    rows = table(spark, d, "customer").select(C.education_band(_pick(_SPELLINGS, "c_custkey")).alias("education_band"), C.sex_binary(_pick(_SEXES, "c_custkey")).alias("sex_binary"))
    return rows.groupBy("education_band", "sex_binary").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate - to_days((o_custkey * 37 % 50000)::INT) - to_hours((o_orderkey % 24)::INT) AS b, o_orderdate + to_hours((o_orderkey % 20000 - 10000)::INT) AS m, o_totalprice FROM orders),
v AS (SELECT floor(epoch_us(a - b) / 8.64e10) / 365.25 AS age, epoch_us(a - m) / 8.64e10 AS gap, CASE WHEN o_totalprice / 5000 BETWEEN 0 AND 80 THEN o_totalprice / 5000 END AS years, o_totalprice / 40000 - 0.5 AS edss, o_totalprice / 7000 - 1 AS cog, o_totalprice / 4500 - 1 AS phys FROM o)
SELECT CASE WHEN age > -0.001 AND age <= 39.999 THEN '<40' WHEN age > 39.999 AND age <= 54.999 THEN '40-54' WHEN age > 54.999 AND age <= 120 THEN '55+' END AS age_band, CASE WHEN years <= 5 THEN 'Disease_short' WHEN years <= 15 THEN 'Disease_mid' WHEN years <= 80 THEN 'Disease_long' END AS disease_duration_band,
CASE WHEN edss <= -0.001 THEN NULL WHEN edss <= 2.5 THEN 'EDSS_mild' WHEN edss <= 4.5 THEN 'EDSS_moderate' WHEN edss <= 10 THEN 'EDSS_advanced' END AS edss_band, CASE WHEN cog <= -0.001 THEN NULL WHEN cog <= 17 THEN 'Cog_low' WHEN cog <= 30 THEN 'Cog_moderate' WHEN cog <= 60 THEN 'Cog_high' END AS cognitive_burden_band,
CASE WHEN phys <= -0.001 THEN NULL WHEN phys <= 29 THEN 'Phys_low' WHEN phys <= 50 THEN 'Phys_moderate' WHEN phys <= 100 THEN 'Phys_high' END AS physical_impact_band, count(*) AS n, round(sum(CASE WHEN age BETWEEN 0 AND 120 THEN age END), 2) AS ages, round(sum(years), 2) AS years, round(sum(CASE WHEN abs(gap) <= 365 THEN gap END), 2) AS gaps FROM v GROUP BY 1, 2, 3, 4, 5""")
def clinical_bands(spark, d):
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    hours = lambda n: F.make_interval(hours=n.cast("int"))
    born = day - F.make_interval(days=(F.col("o_custkey") * 37 % 50000).cast("int")) - hours(F.col("o_orderkey") % 24)
    rows = o.select(C.age_at(day, born).alias("age"), C.visit_gap(day, day + hours(F.col("o_orderkey") % 20000 - 10000)).alias("gap"), C.disease_years(F.col("o_totalprice") / 5000).alias("years"), *[(F.col("o_totalprice") / a - b).alias(n) for n, a, b in (("edss", 40000, 0.5), ("cog", 7000, 1), ("phys", 4500, 1))])
    bands = [C.age_band(F.col("age")).alias("age_band"), C.disease_band(F.col("years")).alias("disease_duration_band"), C.edss_band(F.col("edss")).alias("edss_band"), C.cognitive_burden_band(F.col("cog")).alias("cognitive_burden_band"), C.physical_impact_band(F.col("phys")).alias("physical_impact_band")]
    return rows.groupBy(*bands).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(n) for c, n in (("age", "ages"), ("years", "years"), ("gap", "gaps"))])


@query(r"SELECT lang, source, count(*) AS n, sum(length(t))::BIGINT AS characters, count(DISTINCT md5(t)) AS texts, bit_xor(('0x' || substr(md5(t), 1, 15))::BIGINT) AS mixed FROM (SELECT lang, source, trim(regexp_replace(strip_accents(lower(text)), '[_\s]+', ' ', 'g')) AS t FROM documents) GROUP BY 1, 2")
def lookup_texts(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", C.lookup_text(F.col("text")).alias("t"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("characters"), F.count_distinct(F.md5("t")).alias("texts"), F.bit_xor(F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("bigint")).alias("mixed"))


_HINTS = [("outcome", "Wídget", 0), ("outcome", "bolt", 1), ("group", "large_bolt", 0), ("age", "COLD", 0), ("none", "zzz", 0), ("sex", "zzz", 0), ("sex", "small   widget", 1)]
_HINTS_SQL = "h AS (SELECT col0 AS role, col1 AS hint, col2 AS prio FROM (VALUES " + ", ".join(f"('{r}', '{h}', {p})" for r, h, p in _HINTS) + "))"
_LOOKUP = r"trim(regexp_replace(strip_accents(lower({})), '[_\s]+', ' ', 'g'))"


@query(f"""WITH {_HINTS_SQL}, c AS (SELECT col, row_number() OVER (ORDER BY col DESC) AS pos FROM (SELECT DISTINCT p_name AS col FROM part)), m AS (SELECT role, prio, pos, col, {_LOOKUP.format('col')} = {_LOOKUP.format('hint')} AS same FROM c, h WHERE contains({_LOOKUP.format('col')}, {_LOOKUP.format('hint')}))
SELECT r.role, m.col AS "column" FROM (SELECT DISTINCT role FROM h) r LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY role ORDER BY same DESC, prio, pos) = 1) m ON r.role = m.role""")
def column_roles(spark, d):
    from pyspark.sql.window import Window

    names = table(spark, d, "part").select(F.col("p_name").alias("col")).distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.desc("col"))))  # names of columns: few
    return P.column_roles(names, spark.createDataFrame(_HINTS, "role string, hint string, prio int"), ["outcome"])


@query(f"""WITH {_HINTS_SQL}, c AS (SELECT DISTINCT {_LOOKUP.format('p_name')} AS c FROM part), f AS (SELECT DISTINCT role FROM h WHERE EXISTS (SELECT 1 FROM c WHERE contains(c.c, {_LOOKUP.format('hint')})))
SELECT coalesce(g, 'default') AS "group", string_agg(role, ',' ORDER BY pos) AS targets FROM (VALUES ('outcome', 'one', 2), ('group', 'one', 1), ('age', NULL, 3), ('none', 'two', 4)) t(role, g, pos) WHERE role IN (SELECT role FROM f) GROUP BY 1""")
def target_groups(spark, d):
    from pyspark.sql.window import Window

    names = table(spark, d, "part").select(F.col("p_name").alias("col")).distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.desc("col"))))
    found = P.column_roles(names, spark.createDataFrame(_HINTS, "role string, hint string, prio int"))
    targets = spark.createDataFrame([("outcome", "one", 2), ("group", "one", 1), ("age", None, 3), ("none", "two", 4)], "name string, group string, pos int")
    return P.target_groups(targets, found).select("group", F.array_join("targets", ",").alias("targets"))


@query("""WITH g AS (SELECT c_nationkey AS sheet, (c_custkey // 25 % 12)::INT AS r, (c_custkey % 3)::INT AS c, CASE WHEN c_custkey % 61 = 0 THEN ' Código ' WHEN c_custkey % 7 = 0 THEN 'age' ELSE c_mktsegment END AS v FROM customer)
SELECT s.sheet, coalesce(min(r), 2)::INT AS header FROM (SELECT DISTINCT sheet FROM g) s LEFT JOIN g ON g.sheet = s.sheet AND r < 5 AND trim(v) = 'Código' GROUP BY 1""")
def sheet_headers(spark, d):
    c = table(spark, d, "customer")
    value = F.when(F.col("c_custkey") % 61 == 0, " Código ").when(F.col("c_custkey") % 7 == 0, "age").otherwise(F.col("c_mktsegment"))
    grid = c.select(F.col("c_nationkey").alias("sheet"), F.floor(F.col("c_custkey") / 25 % 12).cast("int").alias("row_idx"), (F.col("c_custkey") % 3).cast("int").alias("col_idx"), value.alias("value"))
    return Q.headers(grid, "Código", 2)


_TARGETED = "t AS (SELECT o_orderstatus, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice - 50000 END AS a, try_cast(replace(CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE (o_custkey % 100)::VARCHAR || ',5' END, ',', '.') AS DOUBLE) AS b, CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders)"


def targeted(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise(F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(",5")))
    rows = table(spark, d, "orders").select("o_orderstatus", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") - 50000).alias("a"), text.alias("b"), F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return P.numeric_targets(rows, ["a", "b"])


@query(f"WITH {_TARGETED} SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (coalesce(a, b) IS NULL) AS dropped, round(100 * count(*) FILTER (coalesce(a, b) IS NULL) / count(*), 4) AS percent FROM t GROUP BY 1")
def exclusion_report(spark, d):
    return rounded(P.exclusion_report(targeted(spark, d), ["a", "b"], "o_orderstatus"))


@query(f"WITH {_TARGETED} SELECT 'a' AS target, count(*) FILTER (a <= 0) AS not_positive FROM t UNION ALL SELECT 'b', count(*) FILTER (b <= 0) FROM t")
def not_positive_targets(spark, d):
    return P.not_positive(P.with_targets(targeted(spark, d), ["a", "b"]), ["a", "b"])


@query(f"""WITH {_TARGETED}, s AS (SELECT 'a' AS target, count(*) FILTER (split = 'train' AND a IS NOT NULL) AS train, count(*) FILTER (split = 'test' AND a IS NOT NULL) AS test FROM t UNION ALL SELECT 'b', count(*) FILTER (split = 'train' AND b IS NOT NULL), count(*) FILTER (split = 'test' AND b IS NOT NULL) FROM t)
SELECT target, train, test, CASE WHEN train < 10 THEN 'too few train rows' WHEN test < 2200 THEN 'too few test rows' END AS skipped FROM s""")
def sample_gates(spark, d):
    return P.sample_gates(targeted(spark, d), ["a", "b"], 10, 2200)


_MOVES = {"l_quantity": "average_time_inside_circles", "l_tax": "average time between circles", "l_discount": "Presión mean", "l_extendedprice": "total time", "l_linenumber": "number errors"}


def movements(spark, d):
    rows = table(spark, d, "lineitem")
    split = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    level = F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    return rows.select(*[F.col(c).cast("double").alias(n) for c, n in _MOVES.items()], level.alias("clinical_group_A"), (F.col("l_partkey") % 70).cast("double").alias("age_at_test"), F.lit(3.0).alias("constant time"), F.when(F.col("l_orderkey") % 2 == 0, 1.0).alias("inside_circle"), F.lit(None).cast("double").alias("hover time"), F.col("l_suppkey").alias("other"), "l_linestatus", split.alias("split"), F.col("l_partkey").cast("double").alias("score"))


_MEASURED = [*_MOVES.values(), "constant time", "inside_circle", "hover time", "score"]


_SELECTED = {
    "average_time_inside_circles": "l_quantity", "average time between circles": "l_tax", "Presión mean": "l_discount", "tmt_kinematic_circle_minus_flight": "l_quantity - l_tax",
    "tmt_kinematic_circle_to_flight_ratio": "l_quantity / nullif(l_tax, 0)", "tmt_kinematic_errors_per_between_time": "l_linenumber / nullif(l_tax, 0)",
}
_TRAIN = "FROM lineitem WHERE l_orderkey % 5 <> 0"


@query(f"""SELECT 'configured' AS reason, 'number errors' AS feature, NULL::BIGINT AS n, NULL::DOUBLE AS mean UNION ALL SELECT 'global_time', 'total time', NULL, NULL
UNION ALL SELECT CASE WHEN count(*) FILTER (l_orderkey % 2 = 0) = 0 THEN 'all_nan_in_train' WHEN count(*) FILTER (l_orderkey % 2 <> 0) / count(*) > 0.35 THEN 'high_missing_rate_in_train' ELSE 'low_unique_values_in_train' END, 'inside_circle', NULL, NULL {_TRAIN}
UNION ALL SELECT 'all_nan_in_train', 'hover time', NULL, NULL UNION ALL {' UNION ALL '.join(f"SELECT 'selected', '{n}', count({c}), round(avg({c}), 4) FROM lineitem" for n, c in _SELECTED.items())}""")
def feature_selection_tmt(spark, d):
    """Which features of a movement test are fitted, with their values, and why the others aren't."""
    rows, kept, audit = P.prepare(movements(spark, d), "tmt", _MEASURED, ["score"], ("number errors",))
    each = rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count(f"`{c}`").alias("n"), F.round(F.avg(f"`{c}`"), 4).alias("mean")) for c in kept]).alias("all"))
    return audit.unionByName(each.select(F.explode("all").alias("s")).select(F.lit("selected").alias("reason"), "s.*"), allowMissingColumns=True)


@query("""WITH s AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, l_quantity::DOUBLE AS a, CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE END AS b, 3.0::DOUBLE AS c, CASE WHEN l_orderkey % 5 = 0 THEN l_tax END::DOUBLE AS e, (1e-9 * l_linenumber)::DOUBLE AS f FROM lineitem),
p AS (SELECT feature, count(value) AS k, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd FROM (SELECT a, b, c, e, f FROM s WHERE split = 'train') UNPIVOT INCLUDE NULLS (value FOR feature IN (a, b, c, e, f)) GROUP BY 1)
SELECT feature, CASE WHEN k = 0 THEN 'all_nan_in_train' WHEN 1 - k / (SELECT count(*) FROM s WHERE split = 'train') > 0.35 THEN 'high_missing_rate_in_train' WHEN lo = hi THEN 'low_unique_values_in_train' WHEN sd <= 1e-8 THEN 'low_variance_in_train' ELSE 'kept' END AS reason FROM p""")
def train_filters(spark, d):
    even = F.col("l_orderkey") % 2 == 0
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"), F.col("l_quantity").alias("a"), F.when(even, 1.0).alias("b"), F.lit(3.0).alias("c"), F.when(F.col("l_orderkey") % 5 == 0, F.col("l_tax")).alias("e"), (F.col("l_linenumber") * 1e-9).alias("f"))
    return P.train_filters(rows, ["a", "b", "c", "e", "f"])


@query("""WITH r AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, nullif(l_quantity, 7) AS t, l_tax - 0.02 AS e FROM lineitem)
SELECT split, count(*) AS n, count(t) AS known, round(sum(ln(1 + greatest(t, 0))), 3) AS flight_time, round(sum(e), 3) AS error_rate FROM r GROUP BY 1""")
def log_features(spark, d):
    split = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    rows = table(spark, d, "lineitem").select(split.alias("split"), F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("flight_time"), (F.col("l_tax") - 0.02).alias("error_rate"))
    out = X.log_transform(rows, X.log_candidates(["flight_time", "error_rate"]))
    return out.groupBy("split").agg(F.count("*").alias("n"), F.count("flight_time").alias("known"), F.round(F.sum("flight_time"), 3).alias("flight_time"), F.round(F.sum("error_rate"), 3).alias("error_rate"))


@query("""WITH r AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS v, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS c FROM orders),
m AS (SELECT (SELECT median(v) FROM r WHERE split = 'train') AS v, (SELECT c FROM r WHERE split = 'train' AND c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) AS c)
SELECT r.split, coalesce(r.c, m.c) AS c, count(*) AS n, round(sum(coalesce(r.v, m.v)), 2) AS total FROM r, m GROUP BY 1, 2""")
def mixed_imputation(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("v"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("c"))
    return P.impute_mixed(rows, ["v"], ["c"]).groupBy("split", "c").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS p FROM orders GROUP BY 1")
def fixed_levels(spark, d):
    out = P.fixed_levels(table(spark, d, "orders"), {"o_orderstatus": ["F", "O", "P"]})
    return out.groupBy("o_orderstatus").agg(F.sum("o_orderstatus_O").alias("o"), F.sum("o_orderstatus_P").alias("p"))


@query("""WITH a AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS g, -ln(o_totalprice) AS y, c_acctbal / 1000 AS age FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT g AS "group", count(*) AS n, round(avg(y), 6) AS outcome, round(avg(age), 4) AS age FROM a WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def analysis_frame(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderstatus", P.minus_log(F.col("o_totalprice")).alias("y"), (F.col("c_acctbal") / 1000).alias("bal"))
    out = P.analysis_frame(rows, "y", "o_orderstatus", {"age": "bal", "sex": "missing"}, {"F": 1, "O": 0})
    return out.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("outcome"), F.round(F.avg("age"), 4).alias("age"))


# effects by least squares, each term made orthogonal to all others first


def hc3_sql(source: str, y: str, terms: list[str], by: str = "") -> str:
    """SQL of (by, term, n, estimate, se) of each term, by orthogonal terms: windows by group, then sums."""
    over = f"OVER ({'PARTITION BY ' + by if by else ''})"
    head, parts = f"{by}, " if by else "", []

    def project(target: str, on: list[str]) -> str:
        return f"{target} - avg({target}) {over}" + "".join(f" - covar_pop({target}, {q}) {over} / var_pop({q}) {over} * {q}" for q in on)

    ctes, last = [], source
    for k, t in enumerate(terms):  # q0, q1, ... orthogonal, in order
        ctes.append(f"o{k} AS (SELECT *, {project(t, [f'q{j}' for j in range(k)])} AS q{k} FROM {last})")
        last = f"o{k}"
    basis = [f"q{k}" for k in range(len(terms))]
    leverage = f"1.0 / count(*) {over}" + "".join(f" + {q} * {q} / sum({q} * {q}) {over}" for q in basis)
    ctes.append(f"e AS (SELECT *, pow(({project(y, basis)}) / (1 - ({leverage})), 2) AS w FROM {last})")
    for k, t in enumerate(terms):
        own, here = [x for x in terms if x != t], "e"
        for j, x in enumerate(own):
            ctes.append(f"r{k}_{j} AS (SELECT *, {project(x, [f'p{k}_{i}' for i in range(j)])} AS p{k}_{j} FROM {here})")
            here = f"r{k}_{j}"
        ctes.append(f"r{k} AS (SELECT *, {project(t, [f'p{k}_{i}' for i in range(len(own))])} AS z FROM {here})")
        parts.append(f"SELECT {head}'{t}' AS term, count(*) AS n, round(sum(z * {y}) / sum(z * z), 3) AS estimate, round(sqrt(sum(z * z * w)) / sum(z * z), 3) AS se FROM r{k} {'GROUP BY ' + by if by else ''}")
    return f"{', '.join(ctes)} {' UNION ALL '.join(parts)}"


_BALANCED = "b AS (SELECT o_orderpriority, o_totalprice AS y, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS g, c_acctbal / 1000 AS bal, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END * c_acctbal / 1000 AS g_bal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"


def balanced(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(F.col("o_orderstatus").isin("F", "O"))
    rows = rows.select("o_orderpriority", F.col("o_totalprice").alias("y"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("g"), (F.col("c_acctbal") / 1000).alias("bal"))
    return rows.withColumn("g_bal", F.col("g") * F.col("bal"))


@query(f"WITH {_BALANCED}, {hc3_sql('b', 'y', ['g', 'bal', 'g_bal'])}")
def adjusted_effects(spark, d):
    out = I.linear_effects(balanced(spark, d), "y", ["g", "bal", "g_bal"]).filter("term <> 'intercept'")
    return rounded(out.select("term", "n", "estimate", "se"), 3)


@query(f"WITH {_BALANCED}, {hc3_sql('b', 'y', ['g', 'bal'], 'o_orderpriority')}")
def effects_by_group(spark, d):
    out = I.linear_effects(balanced(spark, d), "y", ["g", "bal"], by=("o_orderpriority",)).filter("term <> 'intercept'")
    return rounded(out.select("o_orderpriority", "term", "n", "estimate", "se"), 3)


@query(f"WITH {_BALANCED}, l AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(bal) AS lo, max(bal) AS hi FROM b GROUP BY g)), c AS (SELECT b.* FROM b, l WHERE bal BETWEEN lo AND hi), {hc3_sql('c', 'y', ['g', 'bal'])}")
def support_effects(spark, d):
    out = I.support_effects(balanced(spark, d), "y", ["g", "bal"], "bal", "g").filter("term <> 'intercept'")
    return rounded(out.select("term", "n", "estimate", "se"), 3)


_RATIO = hc3_sql("b", "ly", ["g", "bal"]).replace("round(sum(z * ly) / sum(z * z), 3)", "sum(z * ly) / sum(z * z)").replace("round(sqrt(sum(z * z * w)) / sum(z * z), 3)", "sqrt(sum(z * z * w)) / sum(z * z)")


@query(f"SELECT term, round(exp(-estimate), 5) AS ratio, round(exp(-estimate - 1.959963984540054 * se), 5) AS ratio_low, round(exp(-estimate + 1.959963984540054 * se), 5) AS ratio_high FROM (WITH {_BALANCED.replace('o_totalprice AS y', '-ln(o_totalprice) AS ly')}, {_RATIO})")
def time_ratios(spark, d):
    rows = balanced(spark, d).withColumn("y", P.minus_log(F.col("y")))
    out = P.as_ratios(I.linear_effects(rows, "y", ["g", "bal"], "normal").filter("term <> 'intercept'"))
    return rounded(out.select("term", "ratio", "ratio_low", "ratio_high"), 5)


_EXPECTED = [("SDMT", "digital_score", "price"), ("SDMT", "paper_score", "missing"), ("TMT", "paper_time_a", "quantity"), ("TMT", "paper_errors_a", "lines")]


@query("""WITH r AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS g, l_extendedprice AS price, l_quantity AS quantity, l_linenumber::DOUBLE AS lines, l_tax * 100 AS x FROM lineitem), l AS (SELECT g, x, measure, value FROM r UNPIVOT (value FOR measure IN (price, quantity, lines)) WHERE g IS NOT NULL),
o AS (SELECT *, x - avg(x) OVER w AS xc, g - avg(g) OVER w - covar_pop(g, x) OVER w / var_pop(x) OVER w * (x - avg(x) OVER w) AS z, regr_slope(value, x) OVER w AS bx, avg(value) OVER w AS m, count(*) OVER w AS c FROM l WINDOW w AS (PARTITION BY measure)),
f AS (SELECT *, sum(z * value) OVER w / sum(z * z) OVER w AS e, sum(xc * value) OVER w / sum(xc * xc) OVER w AS b1, sum(z * z) OVER w AS zz, sum(xc * xc) OVER w AS xx FROM o WINDOW w AS (PARTITION BY measure)),
s AS (SELECT measure, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, avg(value) FILTER (g = 1) AS mean1, avg(value) FILTER (g = 0) AS mean0, median(value) FILTER (g = 1) AS median1, median(value) FILTER (g = 0) AS median0, max(e) AS effect,
sqrt(sum(z * z * pow((value - m - b1 * xc - e * z) / (1 - 1.0 / c - xc * xc / xx - z * z / zz), 2))) / max(zz) AS se, count(*) AS adjusted_n FROM f GROUP BY 1)
SELECT v.test, v.measure, CASE WHEN v.col = 'missing' THEN 'column not found' ELSE 'ok' END AS status, n1, n0, round(mean1, 3) AS mean1, round(mean0, 3) AS mean0, round(median1, 3) AS median1, round(median0, 3) AS median0, round(effect, 3) AS effect, round(se, 3) AS se, adjusted_n
FROM (VALUES ('SDMT', 'digital_score', 'price'), ('SDMT', 'paper_score', 'missing'), ('TMT', 'paper_time_a', 'quantity'), ('TMT', 'paper_errors_a', 'lines')) v(test, measure, col) LEFT JOIN s ON s.measure = v.col""")
def group_comparison(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).alias("g"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("lines"), (F.col("l_tax") * 100).alias("x"))
    out = G.comparison_table(rows, "g", _EXPECTED, ["x"])
    return rounded(out.select("test", "measure", "status", "n1", "n0", "mean1", "mean0", "median1", "median0", "effect", "se", "adjusted_n"), 3)


@query("SELECT o_orderstatus AS \"group\", count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def group_counts(spark, d):
    return G.group_counts(table(spark, d, "orders"), "o_orderstatus")


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'MS' WHEN 'O' THEN 'Healthy' END AS "group", o_orderkey AS participant, lower(trim(o_orderpriority)) AS education, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS age, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey""")
def participant_summary(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return P.participants(rows, "o_orderkey", "o_orderstatus", {"F": "MS", "O": "Healthy"}, {"education": "o_orderpriority", "age": "c_acctbal"}, {"score": "o_totalprice"})


_SCORES = "s AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS y, round(o_totalprice / 1000) AS a, round(o_totalprice / 1000) + (o_custkey % 100) * CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS b FROM orders)"


@query(f"""WITH {_SCORES}, l AS (SELECT o_orderpriority, y, 'a' AS m, a::DOUBLE AS s FROM s UNION ALL SELECT o_orderpriority, y, 'b', b::DOUBLE FROM s), r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority, m ORDER BY s) + (count(*) OVER (PARTITION BY o_orderpriority, m, s) - 1) / 2.0 AS r FROM l),
u AS (SELECT o_orderpriority, m, (sum(r) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM r GROUP BY 1, 2)
SELECT o_orderpriority, round(max(auc) FILTER (m = 'a'), 4) AS auc_base, round(max(auc) FILTER (m = 'b'), 4) AS auc_more, round(max(auc) FILTER (m = 'b') - max(auc) FILTER (m = 'a'), 4) AS increment FROM u GROUP BY 1""")
def auc_increment(spark, d):
    y, a = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.round(F.col("o_totalprice") / 1000)
    rows = table(spark, d, "orders").select("o_orderpriority", y.alias("y"), a.alias("a"), (a + (F.col("o_custkey") % 100) * (1 + y)).alias("b"))
    return rounded(A.auc_increment(rows, "a", "b", "y", "o_orderpriority"))


@query(f"""WITH {PAIRED}, l AS (SELECT flag, 'mean' AS model, y, 38000.0::DOUBLE AS p FROM paired UNION ALL SELECT flag, 'price', y, p FROM paired)
SELECT flag, model, count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 3) AS r2 FROM l GROUP BY 1, 2""")
def model_comparison(spark, d):
    return rounded(A.model_comparison(paired(spark, d).withColumn("m", F.lit(38000.0)), "y", {"mean": "m", "price": "p"}, "flag"), 3)


@query(f"WITH {PAIRED}, s AS (SELECT 'scatter' AS series, y AS x, p AS v FROM paired UNION ALL SELECT 'residual', p, y - p FROM paired UNION ALL SELECT 'bland_altman', (y + p) / 2, p - y FROM paired) SELECT series, count(*) AS n, round(sum(x), 1) AS x, round(sum(v), 1) AS y FROM s GROUP BY 1")
def plot_series(spark, d):
    return A.series(paired(spark, d), "y", "p").groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("x"), 1).alias("x"), F.round(F.sum("y"), 1).alias("y"))


@query(f"WITH {PAIRED} SELECT round(min(least(y, p)), 3) AS line_from, round(max(greatest(y, p)), 3) AS line_to, round(avg(p - y), 3) AS bias, round(avg(p - y) - 1.96 * stddev_samp(p - y), 3) AS low, round(avg(p - y) + 1.96 * stddev_samp(p - y), 3) AS high FROM paired")
def plot_limits(spark, d):
    return rounded(A.plot_limits(paired(spark, d), "y", "p"), 3)


@query("SELECT o_orderpriority AS scenario, count(*) AS replicates, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END), 4) AS power, round(sqrt(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END)) / count(*)), 6) AS mc_se FROM orders GROUP BY 1")
def rejection_rates(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("scenario"), (F.col("o_totalprice") > 250000).alias("reject"))
    out = R.rejection_summary(rows, "reject", "scenario")
    return out.select("scenario", "replicates", F.round("power", 4).alias("power"), F.round("mc_se", 6).alias("mc_se"))


_PERSON_DRAW = "('0x' || substr(md5('{}:' || person), 1, 8))::BIGINT"


@query(f"""WITH RECURSIVE {PAIRED}, g AS (SELECT person, count(*) AS n FROM paired GROUP BY 1), o AS (SELECT person, n, row_number() OVER (ORDER BY n DESC, {_PERSON_DRAW.format(42)}, person) AS i FROM g),
f(i, loads, n, spot) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT, 0 UNION ALL SELECT o.i, list_transform(f.loads, lambda x, j: x + CASE WHEN j = list_position(f.loads, list_min(f.loads)) THEN o.n ELSE 0 END), o.n, list_position(f.loads, list_min(f.loads))::INT FROM f JOIN o ON o.i = f.i + 1)
SELECT (spot - 1)::INT AS fold, n AS rows, count(*) AS people FROM f WHERE i > 0 GROUP BY 1, 2""")
def lightest_folds(spark, d):
    """How many people of each size go to each fold, where each, the largest first, goes to the lightest."""
    each = R.balanced_folds(paired(spark, d).select("person"), "person").groupBy("person", "fold").agg(F.count("*").alias("rows"))
    return each.groupBy("fold", "rows").agg(F.count("*").alias("people"))


@query(f"""WITH c AS (SELECT DISTINCT o_custkey AS person FROM orders), s AS (SELECT unnest(range(42, 72)) AS seed), r AS (SELECT person, seed, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(seed || ':' || person), 1, 8))::BIGINT, person) AS r, count(*) OVER (PARTITION BY seed) AS n FROM c, s)
SELECT seed::INT AS seed, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS people, sum(person)::BIGINT AS keys FROM r GROUP BY 1, 2""")
def repeated_splits(spark, d):
    out = R.repeated_splits(table(spark, d, "orders").select(F.col("o_custkey").alias("person")), "person")
    return out.groupBy("seed", "split").agg(F.count("*").alias("people"), F.sum("person").alias("keys"))


_CAL = "m AS (SELECT flag, avg(y) AS prediction FROM k WHERE NOT held GROUP BY 1), e AS (SELECT k.flag, abs(prediction - y) AS e FROM k JOIN m USING (flag) WHERE held), r AS (SELECT flag, e, row_number() OVER (PARTITION BY flag ORDER BY e) AS r, count(*) OVER (PARTITION BY flag) AS n FROM e), q AS (SELECT flag, e AS q FROM r WHERE r = ceil(least(1.0, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1)"


@query(f"""WITH {PAIRED}, g AS (SELECT person, row_number() OVER (ORDER BY {_PERSON_DRAW.format(42)}, person) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT person FROM paired)), k AS (SELECT p.flag, p.y, g.r <= ceil(g.n * 0.2::DOUBLE) AS held FROM paired p JOIN g USING (person)), {_CAL}
SELECT p.flag, count(*) AS n, round(avg(CASE WHEN p.y BETWEEN prediction - q AND prediction + q THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(min(prediction - q), 3) AS low, round(max(prediction + q), 3) AS high FROM paired p JOIN m USING (flag) JOIN q USING (flag) GROUP BY 1""")
def split_conformal(spark, d):
    """Intervals around each flag's mean, fitted to people not held out, as wide as errors on those held out ask for."""

    def fit(rows):
        means = rows.groupBy("flag").agg(F.avg("y").alias("prediction"))
        means = spark.createDataFrame(means.collect(), means.schema)
        return lambda other: other.join(F.broadcast(means), "flag")  # a row a flag

    rows = paired(spark, d).select("person", "flag", "y")
    model, widths = R.split_conformal(rows, "person", fit, "y", 0.1, 0.2, 42, "flag")
    out = R.with_interval(model(rows), widths, "flag")
    inside = F.avg(F.when(F.col("y").between(F.col("low"), F.col("high")), 1.0).otherwise(0.0))
    return rounded(out.groupBy("flag").agg(F.count("*").alias("n"), F.round(inside, 4).alias("coverage"), F.round(F.min("low"), 3).alias("low"), F.round(F.max("high"), 3).alias("high")))


@query(f"WITH {PAIRED}, r AS (SELECT flag, abs(p - y) / l_quantity AS e FROM paired), o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY e) AS r, count(*) OVER (PARTITION BY flag) AS n FROM r) SELECT flag, n, round(e, 4) AS q FROM o WHERE r = ceil(least(1.0, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1")
def local_conformal(spark, d):
    rows = paired(spark, d).withColumn("e", F.col("p") - F.col("y"))
    return rounded(R.local_conformal(rows, "e", "l_quantity", 0.1, "flag"))


@query("""WITH o AS (SELECT *, o_custkey % 5 = 0 AS held FROM orders), a AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m, count(*) AS n FROM o WHERE NOT held GROUP BY 1, 2), b AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM o WHERE NOT held GROUP BY 1)
SELECT o.o_orderpriority, o.o_orderstatus, count(*) AS n, round(avg(CASE WHEN a.n >= 300 THEN a.m WHEN b.n >= 300 THEN b.m ELSE (SELECT avg(o_totalprice) FROM o WHERE NOT held) END), 3) AS prediction FROM o LEFT JOIN a USING (o_orderpriority, o_orderstatus) LEFT JOIN b USING (o_orderpriority) WHERE held GROUP BY 1, 2""")
def stratum_means(spark, d):
    o = table(spark, d, "orders")
    out = G.stratum_means(o.filter("o_custkey % 5 <> 0"), o.filter("o_custkey % 5 = 0"), "o_totalprice", ["o_orderpriority", "o_orderstatus"], 300)
    return out.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("prediction"))


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS \"left\", (SELECT count(DISTINCT user_id) FROM events) AS \"right\", (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) a JOIN (SELECT DISTINCT user_id FROM events) b ON o_custkey = user_id) AS common")
def key_overlap(spark, d):
    return K.overlap(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


_MARKED = "c AS (SELECT 'P' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '-1' ELSE '' END AS id FROM orders), dd AS (SELECT DISTINCT 'P' || (c_custkey // 2 * 2) || '-' || (c_custkey % 2 + c_custkey // 100 % 2) AS id FROM customer)"


def marked(spark, d):
    clinical = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, "-1").otherwise("")).alias("id"))
    k = F.col("c_custkey")
    digital = table(spark, d, "customer").select(F.concat(F.lit("p"), (F.floor(k / 2) * 2).cast("string"), F.lit("-"), (k % 2 + F.floor(k / 100) % 2).cast("string")).alias("id"))
    return clinical, digital


@query(f"WITH {_MARKED}, one AS (SELECT split_part(id, '-', 1) AS base FROM dd GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT id FROM c WHERE id NOT IN (SELECT id FROM dd) AND split_part(id, '-', 1) NOT IN (SELECT base FROM one)")
def unresolved_keys(spark, d):
    return K.unresolved(*marked(spark, d), "id")


@query(f"WITH {_MARKED} SELECT split_part(id, '-', 1) AS base, count(*) AS ids FROM dd GROUP BY 1 HAVING count(*) > 1")
def ambiguous_bases(spark, d):
    return K.ambiguous(marked(spark, d)[1], "id")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(sum(total), 2) AS clinical FROM orders JOIN (SELECT l_orderkey, l_extendedprice AS total FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1")
def merged_sources(spark, d):
    digital = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("total"))
    clinical = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("total"))
    return K.paired(digital, clinical, "id").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.round(F.sum("total_clinical"), 2).alias("clinical"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), s1 AS (SELECT k FROM a WHERE k % 7 <> 0), s2 AS (SELECT DISTINCT k FROM s1 JOIN orders ON o_custkey = k WHERE o_orderstatus <> 'P')
SELECT k, CASE WHEN k % 7 = 0 THEN 'no consent' ELSE 'no visit' END AS reason FROM a WHERE k NOT IN (SELECT k FROM s2)""")
def exclusion_log(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    kept = o.filter("k % 7 <> 0")
    return K.exclusions(o, "k", {"no consent": kept, "no visit": kept.filter("o_orderstatus <> 'P'")})


@query("""WITH v AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS t, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), p AS (SELECT a.k, a.t, b.t AS again, b.v - a.v AS change FROM v a JOIN v b ON a.k = b.k AND epoch_us(b.t - a.t) / 8.64e10 BETWEEN 14 AND 28)
SELECT k, t, again, round(change, 2) AS change FROM p QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY again) = 1""")
def retest_change(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_totalprice").alias("v"))
    return K.retest(v, "k", "t", "v").select("k", "t", "again", F.round("change", 2).alias("change"))


_FIT = "t AS (SELECT l_returnflag AS flag, l_quantity AS x, l_tax AS g, l_extendedprice AS y, l_orderkey % 5 <> 0 AS train FROM lineitem), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx, avg(g) AS mg, stddev_pop(g) AS dg, avg(y) AS my, count(*)::DOUBLE AS n, min(x) AS lx, max(x) AS hx FROM t WHERE train)"


@query(f"""WITH {_FIT}, s AS (SELECT max(n) AS n, sum((x - mx) / dx * (g - mg) / dg) AS c, sum((x - mx) / dx * (y - my)) AS a, sum((g - mg) / dg * (y - my)) AS b FROM t, m WHERE train)
SELECT flag, train, count(*) AS n, round(avg(p), 2) AS prediction, round(avg(abs(p - y)), 2) AS mae FROM (SELECT flag, train, y, my + (a * (n1 + 1) - b * c) / ((n1 + 1) * (n1 + 1) - c * c) * (x - mx) / dx + (b * (n1 + 1) - a * c) / ((n1 + 1) * (n1 + 1) - c * c) * (g - mg) / dg AS p FROM t, m, (SELECT n AS n1, a, b, c FROM s)) GROUP BY 1, 2""")
def calibrated_predictions(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 5 != 0).alias("train"))
    out = T.train(rows.filter("train"), "ridge", ["x", "g"], "y").predict(rows)
    return out.groupBy("flag", "train").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 2).alias("prediction"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 2).alias("mae"))


@query("WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_quantity BETWEEN 3 AND 47) SELECT 'x' AS feature, max(lo) AS lo, max(hi) AS hi, min(l_quantity) AS seen_lo, max(l_quantity) AS seen_hi, count(*) FILTER (l_quantity < lo OR l_quantity > hi) AS violations FROM lineitem, r")
def range_violations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_tax").alias("g"), F.col("l_extendedprice").alias("y"))
    return T.train(rows.filter("x BETWEEN 3 AND 47"), "linear", ["x", "g"], "y").outside(rows)


def buyers(spark, d):
    """A row a person: whether most of their orders are finished, mean price and balance."""
    each = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.avg("o_totalprice").alias("price"), F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("g"))
    return each.join(table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_acctbal").alias("y")), "person")


@query()
def refitted_bootstrap(spark, d):
    people = buyers(spark, d)
    each = D.discrimination(people, "person", "g", "y", ["price"], D.class_bootstrap(people, "person", "g", 10))
    return rounded(R.replicate_summary(each, ["auc_base", "auc_more", "auc_deviation", "increment"], 10), 3)


@query()
def split_stability(spark, d):
    people = buyers(spark, d)
    return rounded(D.discrimination(people, "person", "g", "y", ["price"], D.all_seeds(people, "person", "g", [42, 43, 44])), 3)
