"""Conformalised quantiles: quantile lines by Newton steps that are aggregates, widened by an exact order statistic of their misses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import gram, least_squares
from .ranking import _same, selected, settled
from .resample import conformal_rank, split
from .strata import line, products

#: The smoothing starts at half the deviation of the residuals and is halved so often; Newton steps at each width.
HALVINGS, STEPS = 6, 2
#: Residuals in units of the smoothing are cut here, and a small ridge, in units of rows by smoothing, keeps steps bounded.
CUT, FLOOR = 30.0, 1e-6


@dataclass(frozen=True)
class QuantileLines:
    """For each share a line: the intercept, then a coefficient a feature, of features as they are."""

    features: list[str]
    coefficients: dict[float, list[float]]

    def of(self, share: float) -> Column:
        return line(F.array(*[F.lit(c) for c in self.coefficients[share]]), self.features)


def quantile_lines(frame: DataFrame, features: list[str], label: str, shares: list[float]) -> QuantileLines:
    """Lines below which those shares of the labels lie: linear quantile regression, all shares at once.

    The loss of a residual r is share * r + h * log(1 + exp(-r / h)), the usual one as h shrinks; each step of the driver
    takes one aggregate over the rows, of p by p sums a share. It starts at least squares, on features less their mean by
    their deviation. Rows with a null among features and label go; none left is an error.
    """
    value = [F.col(f"`{c}`").cast("double").alias(f"_v{k}") for k, c in enumerate([*features, label])]
    rows = frame.select(*value).dropna().persist()
    m = gram(rows, rows.columns)[()]
    n = m[0, 0]
    if not n:
        rows.unpersist()
        raise ValueError("no row has every feature and the label")
    mean, sd = m[0] / n, np.sqrt(np.maximum(np.diag(m) / n - (m[0] / n) ** 2, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    size = len(features) + 1
    to = np.diag(1 / np.append(1.0, sd[1:size]))  # takes (1, features) to (1, scaled features)
    to[1:, 0] = -mean[1:size] / sd[1:size]
    z = to @ m[:size, :size] @ to.T
    first = np.linalg.lstsq(z, to @ m[:size, size], rcond=None)[0]
    spread = float(np.sqrt(max(m[size, size] - first @ (to @ m[:size, size]), 0.0) / n)) or 1.0
    beta = {t: first for t in shares}
    x, y = [F.lit(1.0), *[F.col(f"_v{k}") for k in range(size - 1)]], F.col(f"_v{size - 1}")
    for k in range(HALVINGS * STEPS):
        h = spread / 2 ** (k // STEPS + 1)
        parts = []
        for t in shares:
            own = to.T @ beta[t]
            r = (y - sum((v * float(c) for v, c in zip(x[1:], own[1:], strict=True)), F.lit(float(own[0])))) / h
            u = 1 / (1 + F.exp(F.least(F.greatest(r, F.lit(-CUT)), F.lit(CUT))))
            parts += [F.array(*[F.sum((t - u) * v) for v in x]), F.array(*[F.sum(u * (1 - u) * v) for v in products(x[1:], [])])]
        got = rows.agg(*parts).first()
        for j, t in enumerate(shares):
            slope, bend = np.zeros((size, size)), np.triu_indices(size)
            slope[bend] = got[2 * j + 1]
            slope = to @ (slope + np.triu(slope, 1).T) @ to.T / h + np.eye(size) * FLOOR * n / h
            beta[t] = beta[t] + np.linalg.solve(slope, to @ np.array(got[2 * j]))
    rows.unpersist()
    return QuantileLines(list(features), {t: (to.T @ b).tolist() for t, b in beta.items()})


@dataclass(frozen=True)
class QuantileIntervals:
    """Two quantile lines and how far they are moved apart; miss is null where too few rows calibrate, and so are the bounds."""

    lines: QuantileLines
    miscoverage: float
    widths: DataFrame
    by: list[str]

    def predict(self, frame: DataFrame) -> DataFrame:
        """frame with `low` and `high`: the lower line less, the upper plus, the miss of the row's group."""
        low, high = self.lines.of(self.miscoverage / 2), self.lines.of(1 - self.miscoverage / 2)
        both = _same(frame, self.widths.select(*self.by, F.col("miss").alias("_miss")), self.by, "left")
        return both.withColumns({"low": low - F.col("_miss"), "high": high + F.col("_miss")}).drop("_miss")


def conformal_quantiles(frame: DataFrame, person: str, features: list[str], label: str, miscoverage: float = 0.1, share: float = 0.2, seed: int = 42, by: tuple[str, ...] = ()) -> QuantileIntervals:
    """Intervals that follow the spread of the label: quantile lines fitted to people not held out, and, by group, how far the
    labels of those held out lie outside them.

    A row's miss is max(low - y, y - high), negative inside; the order statistic of rank ceil((n + 1)(1 - miscoverage)),
    as conformal() takes it, is subtracted and added. Held out are ceil(share * people); rows without person or with a
    null among features and label go. The columns named are kept while lines are fitted and misses ranked, so frame is
    worked out once.
    """
    named = dict.fromkeys([person, *by, *features, label])
    known = frame.select(*[F.col(f"`{c}`") for c in named]).dropna(subset=[person, label, *features]).persist()
    marked = split(known, person, share, seed)
    lines = quantile_lines(marked.filter("split = 'train'"), features, label, [miscoverage / 2, 1 - miscoverage / 2])
    y = F.col(f"`{label}`").cast("double")
    miss = F.greatest(lines.of(miscoverage / 2) - y, y - lines.of(1 - miscoverage / 2))
    widths = settled(selected(marked.filter("split = 'test'"), miss, {"miss": (1 - miscoverage, conformal_rank(miscoverage))}, *by))
    known.unpersist()
    return QuantileIntervals(lines, miscoverage, widths.withColumnRenamed("_n", "n"), list(by))
