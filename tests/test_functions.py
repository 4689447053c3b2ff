import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, numeric
from tessella.functions.distributions import Fitted
from tessella.functions.likelihood import digamma
from tessella.functions.regexes import enumeration
from tessella.functions.rng import uniform
from tessella.functions.tables import running


def test_normal_distribution(spark):
    z = [-9.0, -6.5, -3.0, -0.7, -0.1, 0.0, 0.3, 0.66, 1.0, 2.5, 5.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    n = NormalDist()
    for r in df.select("z", numeric.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-12)
    p = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    for r in df.select("p", numeric.normal_ppf(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(n.inv_cdf(r.p), rel=1e-9, abs=1e-12)
    assert numeric.normal_ppf_of(np.array(p)) == pytest.approx([n.inv_cdf(x) for x in p], rel=1e-9, abs=1e-12)
    assert numeric.normal_cdf_of(np.array(z)) == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=1e-12)


def test_uniform_is_the_same_on_any_partitioning(spark):
    one = {r.id: r.u for r in spark.range(50).coalesce(1).select("id", uniform(F.col("id"), "s").alias("u")).collect()}
    many = {r.id: r.u for r in spark.range(50).repartition(7).select("id", uniform(F.col("id"), "s").alias("u")).collect()}
    assert one == many
    assert all(0 <= u < 1 for u in one.values())


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = {r.k: (r._number, r._before) for r in running(df, [F.col("k")], F.col("k")).collect()}
    assert rows == {k: (k, k * (k - 1) // 2) for k in range(1000)}


@pytest.mark.parametrize(
    ("pattern", "first", "size"),
    [("[A-Za-z]{5}", ["AAAAA", "AAAAB"], 52**5), (r"\d{1,3}", ["0", "1"], 1110), ("[x-y][a-b]{1,2}", ["xa", "xb", "xaa", "xab", "xba", "xbb", "ya"], 12), ("ID_[0-9]{2}", ["ID_00", "ID_01"], 100), ("(ab){2}", ["abab"], 1)],
)
def test_regex_enumeration(spark, pattern, first, size):
    e = enumeration(pattern)
    assert e.size == size
    assert [e.string(i) for i in range(len(first))] == first
    n = min(size, 200)
    made = [r.s for r in spark.range(n).orderBy("id").select("id", e.column(F.col("id")).alias("s")).orderBy("id").collect()]
    assert made == [e.string(i) for i in range(n)]


def test_unsupported_patterns():
    for pattern in ("ab|cd", "[^a]", "a*?", "(a)\\1"):
        with pytest.raises(ValueError):
            enumeration(pattern)


def test_strftime_patterns():
    assert dates.spark_pattern("%b %d, %Y") == "MMM dd, yyyy"
    assert dates.spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert dates.spark_pattern("%-d/%m/%Y", parsing=True) == "d/M/yyyy"


def _gamma_below(a, x):
    term = total = 1 / math.gamma(a + 1)
    for k in range(1, 400):
        term *= x / (a + k)
        total += term
    return x**a * math.exp(-x) * total


def _beta_below(a, b, x):
    if x > 0.5:
        return 1 - _beta_below(b, a, 1 - x)
    term, total = 1.0, 1 / a
    for k in range(1, 400):
        term *= (k - b) * x / k
        total += term / (a + k)
    return x**a * total * math.gamma(a + b) / math.gamma(a) / math.gamma(b)


@pytest.mark.parametrize("a", [0.05, 0.102, 0.5, 1.0, 5.0])
def test_gamma_table(a):
    fitted = Fitted.of("gamma", {"mean": a, "sd": math.sqrt(a), "low": 0.0, "high": 60.0, "n": 10**15}, {"log": float(digamma(a))})
    for x in (1e-6, 1e-3, 0.02, 0.3, 1.0, 4.0, 15.0):
        assert np.interp(x, *fitted.table) == pytest.approx(_gamma_below(a, x), rel=1e-4, abs=2e-7)


@pytest.mark.parametrize(("a", "b"), [(0.05, 0.05), (0.05, 5.0), (0.5, 0.5), (2.0, 0.3), (1.0, 3.0), (5.0, 2.0)])
def test_beta_table(a, b):
    mean = a / (a + b)
    both = float(digamma(a + b))
    fitted = Fitted.of("beta", {"mean": mean, "sd": math.sqrt(mean * (1 - mean) / (a + b + 1)), "low": 0.0, "high": 1.0, "n": 10**15}, {"log": float(digamma(a)) - both, "log_rest": float(digamma(b)) - both})
    for x in (1e-9, 1e-3, 0.02, 0.3, 0.5, 0.8, 0.999):
        assert np.interp(x, *fitted.table) == pytest.approx(_beta_below(a, b, x), rel=1e-4, abs=1e-9)
        assert 1 - np.interp(x, *fitted.table) == pytest.approx(_beta_below(b, a, 1 - x), rel=1e-4, abs=1e-9)


def test_t_table():
    # of five degrees of freedom in closed form, far from the middle too
    fitted = Fitted("t", {"df": 5.0, "loc": 2.0, "scale": 1.0})._tabulated(2.0, math.sqrt(5 / 3), 3e3)
    for z in (-40.0, -5.0, -1.0, 0.0, 0.5, 3.0, 20.0):
        s = z / math.sqrt(5)
        angle = math.atan(s)
        expected = 0.5 + (angle + math.sin(angle) * math.cos(angle) * (1 + 2 / 3 * math.cos(angle) ** 2)) / math.pi
        assert np.interp(2 + z, *fitted.table) == pytest.approx(expected, rel=1e-4)
