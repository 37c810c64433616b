"""Closed forms and asserted values that SQL doesn't check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.functions import columns as C
from concordia.operators import agreement as A
from concordia.operators import inference as I
from concordia.operators import quality as Q


def test_agreement_of_five_pairs(spark):
    y, p = [10, 12, 14, 16, 18], [10.5, 11.5, 13.5, 16.5, 18.5]
    r = A.agreement(spark.createDataFrame(list(zip(map(float, y), p)), "y double, p double"), "y", "p").first()
    assert r.n == 5 and r.rmse == pytest.approx(0.5) and r.mae == pytest.approx(0.5)
    cov, vy, vp = np.cov(y, p)[0, 1], np.var(y, ddof=1), np.var(p, ddof=1)
    assert r.ccc == pytest.approx(2 * cov / (vy + vp + 0.1**2))
    m = np.array([y, p], float).T
    n, k = m.shape
    rows = k * ((m.mean(1) - m.mean()) ** 2).sum() / (n - 1)
    cols = n * ((m.mean(0) - m.mean()) ** 2).sum() / (k - 1)
    rest = ((m - m.mean(1, keepdims=True) - m.mean(0) + m.mean()) ** 2).sum() / ((n - 1) * (k - 1))
    assert r.icc == pytest.approx((rows - rest) / (rows + (k - 1) * rest + k * (cols - rest) / n))


def test_bands_and_codes(spark):
    rows = spark.createDataFrame([("1", 2.0), ("2", 8.5), ("G", 16.0), ("M", 0.0), ("D", 24.0)], "e string, d double")
    got = [(r[0], r[1]) for r in rows.select(C.education_band(F.col("e")), C.disease_band(F.col("d"))).collect()]
    assert got == [("Primary", "Disease_short"), ("Secondary", "Disease_mid"), ("University", "Disease_long"), ("University", "Disease_short"), ("University", "Disease_long")]


def test_sex_group_and_days(spark):
    r = spark.sql("SELECT 'hombre' s, 'EM' g, timestamp'2026-01-01' a, timestamp'2025-12-30' d").select(C.sex_binary(F.col("s")), C.clinical_group(F.col("g")), C.days_between(F.col("a"), F.col("d"))).first()
    assert tuple(r) == (0.0, "EM", 2.0)


def test_tails():
    assert I.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074047, rel=1e-9)
    assert I.f_tail(3.0, 2, 20) == pytest.approx((1 + 2 * 3.0 / 20) ** -10, rel=1e-9)
    assert I.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert I.t_quantile(0.05, 10) == pytest.approx(2.2281388519649385, rel=1e-8)


def test_hc3_equals_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1) + i % 2, float(i % 2), rng.gauss(0, 1)) for i in range(60)]
    got = {r.term: r for r in I.linear_effects(spark.createDataFrame(rows, "y double, g double, x double"), "y", ["g", "x"]).collect()}
    m = np.array(rows)
    x = np.column_stack([np.ones(60), m[:, 1:]])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ m[:, 0]
    e = (m[:, 0] - x @ b) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    se = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv))
    for t, name in enumerate(("intercept", "g", "x")):
        assert got[name].estimate == pytest.approx(b[t]) and got[name].se == pytest.approx(se[t])


def test_ridge():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    full = np.column_stack([np.ones(40), x, y])
    c, t = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(c.T @ c + 10 * np.eye(2), c.T @ t)
    assert I.least_squares(full.T @ full, 10.0)[1:] == pytest.approx(w)


def test_headers(spark):
    cells = spark.createDataFrame([("a", 0, "Código"), ("a", 1, "TMT papel: A B"), ("a", 2, None), ("a", 3, "Código")], "sheet string, col_idx int, value string")
    names = {r.col_idx: r.name for r in Q.column_names(cells).collect()}
    assert names == {0: "Código", 1: "TMT papel A", 2: "TMT papel B", 3: "Código__2"}


def test_promotion_and_numbers(spark):
    rows = spark.createDataFrame([("1.234,5", "01/02/2020", "x"), ("2,5", "15/03/2021", "y"), ("3", "16/03/2021", "nan"), ("N/A", "", "z")], "v string, fecha string, t string")
    out = Q.promote(rows)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["double", "timestamp", "string"]
    assert sorted(r.v for r in out.collect() if r.v is not None) == [2.5, 3.0, 1234.5]


def test_expectations_stop(spark):
    with pytest.raises(ValueError, match="negative: 1"):
        Q.expect(spark.createDataFrame([(-1.0,), (2.0,)], "v double"), {"negative": F.col("v") < 0}, stop=True)
