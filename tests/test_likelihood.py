"""Fits by maximum likelihood and Dirichlet-process mixtures on data of known parameters."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tessella.functions import likelihood, mixtures
from tessella.operators.numeric import ClusterBasedNormalizer, GaussianNormalizer
from tessella.plans.table import HyperTransformer


def bins(values, k=2000):
    return np.array([(len(c), c.sum(), (c * c).sum()) for c in np.array_split(np.sort(values), min(k, len(values)))])


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, x double")


def test_gamma_functions():
    for x in (0.01, 0.3, 1.0, 2.5, 40.0):
        h = 1e-4 * x
        assert float(likelihood.digamma(x)) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-6)
        assert float(likelihood.trigamma(x)) == pytest.approx(float(likelihood.digamma(x + h) - likelihood.digamma(x - h)) / (2 * h), rel=1e-6)


@pytest.mark.parametrize(("a", "b"), [(0.05, 0.2), (0.5, 3.0), (2.0, 2.0), (40.0, 7.0)])
def test_shapes_are_found_again(a, b):
    rng = np.random.default_rng(1)
    u = np.clip(rng.beta(a, b, 40_000), 1e-300, 1 - 1e-16)
    assert likelihood.beta_shapes(u.mean(), u.var(), np.log(u).mean(), np.log1p(-u).mean()) == pytest.approx((a, b), rel=0.05)
    x = np.maximum(rng.gamma(a, 3.0, 40_000), 1e-300)
    assert likelihood.gamma_shape(x.mean(), np.log(x).mean()) == pytest.approx(a, rel=0.05)


def log_likelihood(y, mu, sigma, low, high):
    d = NormalDist(mu, sigma)
    return -np.mean((y - mu) ** 2) / (2 * sigma**2) - math.log(sigma) - math.log(d.cdf(high) - d.cdf(low))


@pytest.mark.parametrize("name", ["inner", "cut", "uniform", "falling", "rising", "two ends"])
def test_the_truncated_normal_is_the_likeliest_within_its_bounds(name):
    rng = np.random.default_rng(2)
    y = {"inner": rng.normal(5, 2, 5000), "cut": (lambda z: z[(z > -1) & (z < 2)])(rng.normal(0.3, 1, 9000)), "uniform": rng.uniform(0, 1, 5000), "falling": rng.exponential(1, 5000), "rising": 3 - rng.exponential(1, 5000), "two ends": rng.beta(0.3, 0.3, 5000)}[name]
    low, high = y.min() - 1e-9, y.max() + 1e-9
    mu, sigma = likelihood.truncated_normal(y.mean(), y.std(), low, high)
    width = high - low
    assert low - 1e-6 * width <= mu <= high + 1e-6 * width
    assert 0 < sigma <= likelihood.WIDEST * width * (1 + 1e-9)
    best = log_likelihood(y, mu, sigma, low, high)
    for m in np.linspace(low, high, 25):
        for s in width * np.geomspace(0.05, likelihood.WIDEST, 40):
            assert log_likelihood(y, float(m), float(s), low, high) <= best + 1e-7
    mean, deviation = likelihood.truncated_moments((low - mu) / sigma, (high - mu) / sigma, mu, sigma)
    if name in ("inner", "cut"):
        assert (mean, deviation) == pytest.approx((y.mean(), y.std()), abs=1e-9)


@pytest.mark.parametrize("df", [1.0, 3.0, 10.0])
def test_student_t(df):
    y = 2 + 0.5 * np.random.default_rng(3).standard_t(df, 60_000)
    assert likelihood.student_t(bins(y, 8000)) == pytest.approx((df, 2.0, 0.5), rel=0.08)


def test_a_family_that_does_not_fit_falls_back(spark):
    t = GaussianNormalizer(distribution="gamma", missing_value_generation=None)
    t.fit(frame(spark, [3.0] * 20), "x", "k")
    assert t.learned_distribution == {"distribution": "norm", "parameters": {"loc": 3.0, "scale": 0.0}}
    with pytest.raises(likelihood.NoFit):
        likelihood.gamma_shape(1.0, 0.5)
    t = GaussianNormalizer(distribution="t")
    t.fit(frame(spark, [1.0, 2.0, 9.0]).where("k < 0"), "x", "k")
    assert t.learned_distribution["distribution"] == "norm"


#: Means, deviations and counts of mixtures.
MIXTURES = [[(5.0, 1.0, 300), (-5.0, 1.0, 300)], [(5.0, 1.0, 100), (100.0, 1.0, 500)], [(5.0, 0.02, 300), (-4.0, 0.1, 1000), (-180.0, 3.0, 1500), (100.0, 10.0, 500)]]


@pytest.mark.parametrize("parts", MIXTURES)
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_mixtures_are_found_again(spark, parts, shift):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(m, s, n) for m, s, n in parts]) + shift
    t = ClusterBasedNormalizer(missing_value_generation=None)
    made = t.fit_transform(frame(spark, values), "x", "k")
    found = sorted(zip(t.mixture.means, t.mixture.deviations, t.mixture.weights, strict=True))
    if parts is not MIXTURES[2]:
        # the prior has the weight of one value, with the mean and the variance of all
        assert len(found) == len(parts)
        for (m, s, w), (mean, deviation, n) in zip(found, sorted(parts), strict=True):
            own = values[np.abs(values - mean - shift) < 5 * deviation]
            expected = (own.sum() + values.mean()) / (n + 1)
            assert m == pytest.approx(expected, rel=1e-9, abs=0.02)
            variance = (values.var(ddof=1) + own.var() * n + n / (n + 1) * (own.mean() - values.mean()) ** 2) / (n + 1)
            assert s == pytest.approx(math.sqrt(variance), rel=0.02)
            assert w == pytest.approx(n / len(values), abs=0.01)
    back = np.array([r.x for r in t.reverse_transform(made).orderBy("k").collect()])
    assert np.quantile(np.abs(back - values), 0.95) < 1e-6 * max(1.0, shift)


@pytest.mark.parametrize("parts", MIXTURES)
def test_the_bound_never_falls(parts):
    rng = np.random.default_rng(5)
    own = bins(np.concatenate([rng.normal(m, s, n) for m, s, n in parts]))
    found, bounds = mixtures.posterior_of(own, 10)
    after = np.array(bounds[10:])  # until then the components are put in order
    assert (np.diff(after) >= -1e-6 * np.abs(after[:-1])).all()
    assert found.weights.sum() == pytest.approx(1.0)
    assert abs(bounds[-1] - bounds[-2]) < 1e-9 * own[:, 0].sum() or len(bounds) == mixtures.ROUNDS


def test_one_value_and_no_values(spark):
    t = ClusterBasedNormalizer()
    made = t.fit_transform(frame(spark, [7.0] * 5), "x", "k")
    assert {r["x.component"] for r in made.collect()} == {0}
    assert {r.x for r in t.reverse_transform(made).collect()} == {7.0}
    empty = ClusterBasedNormalizer()
    empty.fit(spark.createDataFrame([(1, None)], "k long, x double"), "x", "k")
    assert empty.mixture.means == [0.0]


def test_bins_and_logarithms_of_many_columns_are_a_job_each(spark):
    """However many columns need them: statistics, logarithms and bins."""
    rng = np.random.default_rng(6)
    names = [f"c{k}" for k in range(6)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rng.gamma(2.0, 1.0, (200, 6)))], "k long, " + ", ".join(f"{n} double" for n in names))
    kinds = [GaussianNormalizer(distribution=d) for d in ("gamma", "beta", "t", "gaussian_kde", "gamma")] + [ClusterBasedNormalizer()]
    plan = HyperTransformer("k")
    plan.set_config({"sdtypes": {"k": "id", **dict.fromkeys(names, "numerical")}, "transformers": {"k": None, **dict(zip(names, kinds, strict=True))}})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        plan.fit(df)
        jobs = len(tracker.getJobIdsForGroup("fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6  # adaptive plans run a shuffle's map side as a job of its own
    assert [k.learned_distribution["distribution"] for k in kinds[:5]] == ["gamma", "beta", "t", "gaussian_kde", "gamma"]
