"""Mixtures of normals: a Dirichlet process by variational inference over binned sums, and components drawn by their posteriors.

Weights are broken off a stick one by one, a component's mean and precision have a
normal-gamma posterior, and responsibilities come from the expectations of both. Each
round raises the evidence's lower bound, whose standstill ends the fit. The values of a
bin share their responsibilities; the bin's count, sum and sum of squares are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.likelihood import digamma
from tessella.functions.numeric import clip, round_half_even, staged

#: Bins that the sums are kept by; with them the driver's memory is bounded, whatever the rows.
BINS = 8192
#: Fixed values of the prior: the stick's concentration, and the weight of the mean and of the variance in values.
CONCENTRATION, PRIOR_WEIGHT = 1e-3, 1.0
#: Rounds at most, the bound's rise for each value that ends the fit, and what is added to variances.
ROUNDS, STILL, FLOOR = 1000, 1e-10, 1e-6
#: A value's place in a component is so many deviations wide, and is kept off the ends.
SPREAD, INSIDE = 4.0, 0.99


@dataclass
class Binning:
    """A column, less its median, whose values are summed in bins that are equal on a scale that tames far values."""

    value: Column
    scale: float
    low: float
    high: float

    def place(self, v: float) -> float:
        return math.asinh(v / self.scale)

    @property
    def width(self) -> float:
        return (self.place(self.high) - self.place(self.low)) / BINS or 1.0

    def bin(self) -> Column:
        """The bin's number; null for null."""
        place = F.asinh(self.value / F.lit(self.scale))
        return F.least(F.greatest(F.floor((place - F.lit(self.place(self.low))) / F.lit(self.width)), F.lit(0)), F.lit(BINS - 1)).cast("int")

    @staticmethod
    def of(value: Column, quartiles: list[float], sd: float, low: float, high: float) -> Binning:
        middle = float(quartiles[1])
        return Binning(value - F.lit(middle), float((quartiles[2] - quartiles[0]) / 2 or sd or 1.0), low - middle, high - middle)


def binned(df: DataFrame, wanted: dict[int, Binning]) -> dict[int, np.ndarray]:
    """Counts, sums and sums of squares by bin of several columns, from one scan; BINS rows for each are collected at most."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), b.bin().alias("b"), b.value.alias("v")) for i, b in wanted.items()])
    spread = df.select(F.explode(entries).alias("e")).select("e.*").where("v IS NOT NULL")
    sums = spread.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows: dict[int, list] = {i: [] for i in wanted}
    for r in sums.collect():
        rows[r.i].append((r.b, r.n, r.s, r.q))
    return {i: np.array(sorted(own), float)[:, 1:] if own else np.zeros((0, 3)) for i, own in rows.items()}


@dataclass
class Posterior:
    """The variational posterior of the components of a stick-breaking mixture of normals."""

    mean0: float
    variance0: float
    mass: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        """Posterior parameters from each component's mass, mean and sum of squared distances from it."""
        self.beta = PRIOR_WEIGHT + self.mass
        self.m = (PRIOR_WEIGHT * self.mean0 + self.mass * self.mean) / self.beta
        self.nu = PRIOR_WEIGHT + self.mass
        self.inverse = self.variance0 + self.spread + PRIOR_WEIGHT * self.mass / self.beta * (self.mean - self.mean0) ** 2
        self.variance = self.inverse / self.nu + FLOOR * min(1.0, self.variance0)
        self.log_precision = digamma(self.nu / 2) + math.log(2) - np.log(self.variance * self.nu)
        self.one, self.two = 1 + self.mass, CONCENTRATION + np.append(np.cumsum(self.mass[::-1])[::-1][1:], 0.0)
        both = digamma(self.one + self.two)
        self.log_break, self.log_rest = digamma(self.one) - both, digamma(self.two) - both
        self.log_weight = self.log_break + np.append(0.0, np.cumsum(self.log_rest)[:-1])

    @property
    def weights(self) -> np.ndarray:
        share = self.one / (self.one + self.two)
        out = share * np.append(1.0, np.cumprod(1 - share)[:-1])
        return out / out.sum()

    @property
    def biases(self) -> np.ndarray:
        """What a component's score has beside the value's squared distance from its mean."""
        return self.log_weight + 0.5 * (self.log_precision - 1 / self.beta)

    def scores(self, x: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return self.biases[None, :] - (inner[:, None] + (x[:, None] - self.m[None, :]) ** 2) / (2 * self.variance)[None, :]

    def distance(self) -> float:
        """How far the posterior is from the prior (Kullback and Leibler's), which the bound has against it."""
        lgamma = np.vectorize(math.lgamma)
        precision = 1 / self.variance
        scale = 1 / (self.variance * self.nu)

        def log_norm(scale, nu):
            return -(nu / 2) * np.log(2 * scale) - lgamma(nu / 2)

        prior = 0.5 * (math.log(PRIOR_WEIGHT) + self.log_precision - PRIOR_WEIGHT / self.beta - PRIOR_WEIGHT * precision * (self.m - self.mean0) ** 2)
        prior += (PRIOR_WEIGHT / 2 - 1) * self.log_precision - 0.5 * precision * self.variance0 + log_norm(np.array(1 / self.variance0), np.array(PRIOR_WEIGHT))
        own = 0.5 * (np.log(self.beta) + self.log_precision - 1) + (self.nu / 2 - 1) * self.log_precision - self.nu / 2 + log_norm(scale, self.nu)
        sticks = math.log(CONCENTRATION) + (CONCENTRATION - 1) * self.log_rest
        sticks -= (self.one - 1) * self.log_break + (self.two - 1) * self.log_rest - (lgamma(self.one) + lgamma(self.two) - lgamma(self.one + self.two))
        return float((own - prior).sum() - sticks.sum())


def posterior_of(bins: np.ndarray, most: int) -> tuple[Posterior, list[float]]:
    """The posterior at the bound's standstill, and the bound after each round."""
    n, s, q = bins.T
    x = s / n
    inner = np.maximum(q / n - x * x, 0.0)
    total = n.sum()
    mean = float((n * x).sum() / total)
    variance = float((n * (inner + (x - mean) ** 2)).sum() / max(total - 1, 1))
    k = min(most, len(bins))
    own = _spread_means(n, x, k)
    r = n[:, None] * (own[:, None] == np.arange(k)[None, :])
    bounds: list[float] = []
    for _ in range(ROUNDS):
        mass = r.sum(axis=0)
        if len(bounds) < 10:  # the stick's longest pieces come first
            order = np.argsort(-mass, kind="stable")
            r, mass = r[:, order], mass[order]
        full = np.maximum(mass, 1e-300)
        means = np.where(mass > 1e-10, (r * x[:, None]).sum(axis=0) / full, mean)
        spread = (r * (inner[:, None] + (x[:, None] - means[None, :]) ** 2)).sum(axis=0)
        found = Posterior(mean, variance, mass, means, spread)
        score = found.scores(x, inner)
        top = score.max(axis=1, keepdims=True)
        r = np.exp(score - top)
        whole = r.sum(axis=1)
        bounds.append(float((n * (top[:, 0] + np.log(whole) - 0.5 * math.log(2 * math.pi))).sum()) - found.distance())
        r *= (n / whole)[:, None]
        if len(bounds) > 11 and abs(bounds[-1] - bounds[-2]) < STILL * total:
            break
    return found, bounds


def _spread_means(n: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each bin's nearest of ``k`` means, which begin far from each other and settle."""
    mu = [float(x[np.argmax(n)])]
    while len(mu) < k:
        far = n * np.min([(x - m) ** 2 for m in mu], axis=0)
        mu.append(float(x[np.argmax(far)]))
    mu = np.sort(np.array(mu))
    for _ in range(30):
        own = np.argmin((x[:, None] - mu[None, :]) ** 2, axis=1)
        w = np.bincount(own, weights=n, minlength=k)
        mu = np.where(w > 0, np.bincount(own, weights=n * x, minlength=k) / np.maximum(w, 1e-12), mu)
    return np.argmin((x[:, None] - mu[None, :]) ** 2, axis=1)


def fit_mixture(bins: np.ndarray, most: int, threshold: float) -> Mixture | None:
    """The components of more than ``threshold`` weight."""
    if not len(bins):
        return None
    n, s, q = bins.T
    mean, variance = float(s.sum() / n.sum()), float(q.sum() / n.sum() - (s.sum() / n.sum()) ** 2)
    if len(bins) == 1 or variance <= 0:
        return Mixture([1.0], [mean], [max(math.sqrt(max(variance, 0.0)), 1e-6)])
    found, _ = posterior_of(bins, most)
    weights = found.weights
    kept = np.flatnonzero(weights > threshold)
    kept = kept if len(kept) else np.array([int(weights.argmax())])
    kept = kept[np.argsort(found.m[kept])]
    return Mixture(*([float(v) for v in a[kept]] for a in (weights, found.m, np.sqrt(found.variance), found.biases)), posterior=found)


@dataclass
class Mixture:
    weights: list[float]
    means: list[float]
    deviations: list[float]
    #: What a component's score has beside the squared distance; without a posterior, the weight over the deviation.
    biases: list[float] | None = None
    posterior: Posterior | None = field(default=None, repr=False)

    def shifted(self, by: float) -> Mixture:
        """The same components further on; the posterior stays as it was fitted."""
        return replace(self, means=[m + by for m in self.means])

    def scores(self, v: Column) -> list[Column]:
        biases = self.biases or [math.log(w / s) for w, s in zip(self.weights, self.deviations, strict=True)]
        return [F.lit(b) - ((v - F.lit(m)) / F.lit(s)) ** 2 / 2 for b, m, s in zip(biases, self.means, self.deviations, strict=True)]

    def drawn(self, df: DataFrame, v: Column, u: Column) -> tuple[DataFrame, Column, Column]:
        """The place in a component drawn by its posterior, and the component's number; ``v`` should be a named column."""
        scores = self.scores(v)
        df, top = staged(df, F.greatest(*scores) if len(scores) > 1 else scores[0])
        df, u = staged(df, u)
        # running sums of the components' shares, each from a named column before it
        before, sums = F.lit(0.0), []
        for s in scores:
            df, before = staged(df, before + F.exp(s - top))
            sums.append(before)
        component = None
        for k, s in enumerate(sums[:-1]):
            hit = u * F.lit(1.0 + 1e-6 * len(sums)) < s / sums[-1] + F.lit(1e-6 * (k + 1))
            component = F.when(hit, F.lit(k)) if component is None else component.when(hit, F.lit(k))
        df, component = staged(df, F.lit(0) if component is None else component.otherwise(F.lit(len(sums) - 1)))
        places = [(v - F.lit(m)) / F.lit(SPREAD * s) for m, s in zip(self.means, self.deviations, strict=True)]
        place = F.element_at(F.array(*places), component + 1) if len(places) > 1 else places[0]
        return df, clip(place, -INSIDE, INSIDE), F.when(v.isNotNull(), component.cast("long"))

    def value(self, normalized: Column, component: Column) -> Column:
        at = clip(round_half_even(component.cast("double")), 0.0, float(len(self.means) - 1)).cast("int") + 1
        mean = F.element_at(F.array(*map(F.lit, self.means)), at)
        deviation = F.element_at(F.array(*map(F.lit, self.deviations)), at)
        return clip(normalized.cast("double"), -1.0, 1.0) * F.lit(SPREAD) * deviation + mean
