"""Univariate distributions fitted by maximum likelihood, with their probabilities and quantiles as columns.

The normal, truncated normal and uniform have closed forms. The others are tabulated
once on the driver, and looked up by interpolation in Arrow batches, together with the
normal distribution's side. A kernel density and Student's t are fitted over bins of sums.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import likelihood as L
from tessella.functions.numeric import clip, normal_cdf, normal_cdf_of, normal_ppf, normal_ppf_of, staged

FAMILIES = ("norm", "uniform", "truncnorm", "gamma", "beta", "t", "gaussian_kde")
#: Knots of one kind in a table.
KNOTS = 4097
#: Distance that truncation keeps from the extremes.
EDGE = 1e-9
#: Deviations that a kernel reaches: beyond, less than 1e-15 of it is left.
REACH = 8.0
_N = NormalDist()
LOGGER = logging.getLogger(__name__)


def _places(mean: float, sd: float, top: float) -> np.ndarray:
    """Places from 0 to ``top``: even in logarithms, and even around the mean."""
    even = np.clip(np.linspace(mean - 12 * sd, mean + 12 * sd, KNOTS), 0.0, top)
    return np.concatenate([[0.0, top], top * np.geomspace(1e-300, 1e-20, KNOTS // 2), top * np.geomspace(1e-20, 1e-6, KNOTS // 2), top * np.geomspace(1e-6, 1.0, KNOTS), even])


def _cells(edges: np.ndarray, a: float, log_density: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Logarithms of a density's masses between ``edges``, the first of which is 0, where the density is like u^(a - 1)."""
    nodes, weights = np.polynomial.legendre.leggauss(8)
    half, middle = np.diff(edges[1:]) / 2, (edges[1:-1] + edges[2:]) / 2
    inner = log_density(middle[:, None] + half[:, None] * nodes)
    most = inner.max(axis=1)
    # in the first cell the power is integrated, and the rest is taken at the power's mean
    first, at = edges[1], edges[1] * a / (a + 1)
    end = a * math.log(first) - math.log(a) + float(log_density(np.array(at))) - (a - 1) * math.log(at)
    return np.append(end, most + np.log(np.exp(inner - most[:, None]) @ weights) + np.log(half))


@dataclass
class Fitted:
    family: str
    parameters: dict[str, float]
    table: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @staticmethod
    def of(family: str, stats: dict, logs: dict | None = None, bins: np.ndarray | None = None) -> Fitted:
        """Fit by maximum likelihood; a family that doesn't suit the data falls back to the normal, with a line in the log."""
        mean, sd, low, high = (float(stats[k] or 0.0) for k in ("mean", "sd", "low", "high"))
        if sd <= 0 or high <= low:
            return Fitted("norm", {"loc": mean, "scale": 0.0})
        width = high - low
        try:
            if family == "uniform":
                return Fitted("uniform", {"loc": low, "scale": width})
            if family == "truncnorm":
                mu, sigma = L.truncated_normal(mean, sd, low - EDGE, high + EDGE)
                return Fitted("truncnorm", {"a": (low - EDGE - mu) / sigma, "b": (high + EDGE - mu) / sigma, "loc": mu, "scale": sigma})
            if family == "gamma":
                start, _ = L.padded(low, high, stats["n"])
                shape = L.gamma_shape(mean - start, logs["log"])
                return Fitted("gamma", {"a": shape, "loc": start, "scale": (mean - start) / shape})._tabulated(mean, sd, high)
            if family == "beta":
                start, wide = L.padded(low, high, stats["n"])
                a, b = L.beta_shapes((mean - start) / wide, (sd / wide) ** 2, logs["log"] - math.log(wide), logs["log_rest"] - math.log(wide))
                return Fitted("beta", {"a": a, "b": b, "loc": start, "scale": wide})._tabulated(mean, sd, start + wide)
            if family == "t":
                df, loc, scale = L.student_t(bins)
                loc += stats["quartiles"][1]  # bins are about the median
                return Fitted("t", {"df": df, "loc": loc, "scale": scale})._tabulated(mean, sd, loc + max(high - loc, loc - low))
        except (L.NoFit, np.linalg.LinAlgError, OverflowError, ZeroDivisionError) as e:
            LOGGER.info("the distribution %r can't be fitted (%s): the normal is taken", family, e)
        return Fitted("norm", {"loc": mean, "scale": sd})

    @staticmethod
    def of_kernels(bins: np.ndarray, middle: float, sd: float) -> Fitted:
        """The density with a normal kernel on every value, from counts, sums and sums of squares about ``middle`` in bins.

        The values of a bin are one kernel, wider by their own variance. Knots are a 32nd
        of a kernel apart wherever kernels reach; those that their neighbours tell go.
        """
        n, total, squares = bins.T
        x = total / n
        band = 1.06 * sd * n.sum() ** -0.2
        width = np.sqrt(band**2 + np.maximum(squares / n - x * x, 0.0))
        places = np.sort((x[:, None] + width[:, None] * np.linspace(-REACH, REACH, int(64 * REACH) + 1)).ravel())
        knots = places[np.unique(np.floor(places * (32 / band)), return_index=True)[1]]
        mass, whole = np.zeros(len(knots)), np.zeros(len(knots) + 1)
        first, last = np.searchsorted(knots, x - REACH * width), np.searchsorted(knots, x + REACH * width)
        np.add.at(whole, last, n)  # knots beyond a kernel's reach have all of it
        for k in range(len(x)):
            near = slice(first[k], last[k])
            mass[near] += n[k] * normal_cdf_of((knots[near] - x[k]) / width[k])
        mass = np.maximum.accumulate((mass + np.cumsum(whole[:-1])) / n.sum())
        for _ in range(12):
            odd = np.arange(1, len(knots) - 1, 2)
            share = (knots[odd] - knots[odd - 1]) / (knots[odd + 1] - knots[odd - 1])
            error = np.abs(mass[odd] - mass[odd - 1] - share * (mass[odd + 1] - mass[odd - 1]))
            told = odd[error < 1e-6 * np.minimum(mass[odd], 1 - mass[odd])]
            knots, mass = np.delete(knots, told), np.delete(mass, told)
        return Fitted("gaussian_kde", {"bandwidth": float(band), "values": int(n.sum())}, (knots + middle, mass))

    def _tabulated(self, mean: float, sd: float, high: float) -> Fitted:
        """The probability at knots, by quadrature from each end of the density, where it may be unbounded."""
        p = self.parameters
        loc, scale = p["loc"], p["scale"]
        if self.family == "t":
            z = np.sinh(np.linspace(0.0, math.asinh(max(1e3, (high - loc) / scale)), KNOTS))
            cells = _cells(z, 1.0, lambda u: -(p["df"] + 1) / 2 * np.log1p(u * u / p["df"]))
            above = np.append(np.cumsum(np.exp(cells - cells.max())[::-1])[::-1], 0.0)
            above /= 2 * above[0]
            knots, mass = loc + scale * np.concatenate([-z[:0:-1], z]), np.concatenate([above[:0:-1], 1 - above])
        elif self.family == "gamma":
            a = p["a"]
            knots = np.unique(loc + scale * _places(a, math.sqrt(a), max((high - loc) / scale, a + 12 * math.sqrt(a) + 30)))
            cells = _cells((knots - loc) / scale, a, lambda u: (a - 1) * np.log(u) - u)
            mass = np.append(0.0, np.cumsum(np.exp(cells - cells.max())))
            mass /= mass[-1]
        else:  # each half from its own end
            a, b, middle = p["a"], p["b"], (mean - loc) / scale
            left = np.unique(loc + scale * _places(middle, sd / scale, 0.5))
            right = np.unique(high - scale * _places(1 - middle, sd / scale, 0.5))[::-1]
            lower = _cells((left - loc) / scale, a, lambda u: (a - 1) * np.log(u) + (b - 1) * np.log1p(-u))
            upper = _cells((high - right) / scale, b, lambda u: (b - 1) * np.log(u) + (a - 1) * np.log1p(-u))
            peak = max(lower.max(), upper.max())
            below, above = (np.append(0.0, np.cumsum(np.exp(c - peak))) for c in (lower, upper))
            whole = below[-1] + above[-1]
            knots, mass = np.concatenate([left, right[-2::-1]]), np.concatenate([below / whole, 1 - above[-2::-1] / whole])
        if not np.isfinite(mass).all():  # no such density: the normal
            return Fitted("norm", {"loc": mean, "scale": sd})
        self.table = (knots, mass)
        return self

    def normalized(self, df: DataFrame, x: Column, epsilon: float) -> tuple[DataFrame, Column]:
        """The normal value with the probability that ``x`` has here, kept ``epsilon`` off 0 and 1."""
        if self.table is None:
            df, p = self.cdf(df, x)
            df, p = staged(df, clip(p, epsilon, 1 - epsilon))
            return df, normal_ppf(p)
        knots, mass = self.table

        @F.pandas_udf("double")
        def made(v: pd.Series) -> pd.Series:
            p = np.clip(np.interp(v.to_numpy(float), knots, mass), epsilon, 1 - epsilon)
            return pd.Series(np.where(v.isna(), np.nan, normal_ppf_of(p)))

        return df, F.nanvl(made(x), F.lit(None).cast("double"))

    def value(self, df: DataFrame, z: Column) -> tuple[DataFrame, Column]:
        """The inverse of :meth:`normalized`."""
        if self.table is None:
            df, z = staged(df, z)
            df, q = staged(df, normal_cdf(z))
            df, x = self.ppf(df, q)
            return staged(df, x)
        knots, mass = self.table
        mass, first = np.unique(mass, return_index=True)
        knots = knots[first]

        @F.pandas_udf("double")
        def made(v: pd.Series) -> pd.Series:
            return pd.Series(np.where(v.isna(), np.nan, np.interp(normal_cdf_of(v.to_numpy(float)), mass, knots)))

        return df, F.nanvl(made(z), F.lit(None).cast("double"))

    def cdf(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        """The probability up to ``x`` in closed form, over ``df`` with the columns that it needs."""
        p = self.parameters
        if self.family == "uniform":
            return df, clip((x - p["loc"]) / p["scale"], 0.0, 1.0)
        if not p["scale"]:
            return df, F.when(x.isNotNull(), F.lit(0.5))  # without spread every value is the middle one
        df, z = staged(df, (x - p["loc"]) / p["scale"])
        if self.family == "norm":
            return df, normal_cdf(z)
        below, all_ = _N.cdf(p["a"]), _N.cdf(p["b"]) - _N.cdf(p["a"])
        return df, clip((normal_cdf(z) - below) / all_, 0.0, 1.0)

    def ppf(self, df: DataFrame, q: Column) -> tuple[DataFrame, Column]:
        """The quantile at ``q`` in closed form, over ``df`` with the columns that it needs."""
        p = self.parameters
        if self.family == "uniform":
            return df, q * p["scale"] + p["loc"]
        if not p["scale"]:
            return df, F.when(q.isNotNull(), F.lit(p["loc"]))
        below, all_ = (0.0, 1.0) if self.family == "norm" else (_N.cdf(p["a"]), _N.cdf(p["b"]) - _N.cdf(p["a"]))
        df, share = staged(df, clip(q * all_ + below, 1e-300, 1 - 2.0**-53))
        x = normal_ppf(share) * p["scale"] + p["loc"]
        return df, x if self.family == "norm" else clip(x, p["a"] * p["scale"] + p["loc"], p["b"] * p["scale"] + p["loc"])
