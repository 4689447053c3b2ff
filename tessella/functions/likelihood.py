"""Maximum likelihood fits of one variable from sums: of powers, of logarithms, or in bins.

The truncated normal, gamma and beta need means of a few functions of the values, which
one aggregation makes; the likelihood's gradient is the difference of these means and those
that the distribution expects, and Newton steps make it zero. Student's t has no such
means: it is fitted over bins of sums by weights that each step makes anew.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()
#: Widths of the data that a truncated normal's deviation may have.
WIDEST = 10.0
#: Degrees of freedom of Student's t: the search's ends.
LEAST_DF, MOST_DF = 0.2, 1e4


class NoFit(Exception):
    """The data have no maximum of a family's likelihood."""


def digamma(x):
    """The derivative of ln Gamma, of numbers or arrays above 0."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x):
    """The second derivative of ln Gamma."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out + 1 / (x * x), out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))


def padded(low: float, high: float, n: int) -> tuple[float, float]:
    """Where a density on an interval begins, and how wide it is: half a mean gap beyond the extremes, so that they have logarithms."""
    gap = (high - low) / (2 * n)
    return low - gap, high - low + 2 * gap


def gamma_shape(mean: float, mean_log: float) -> float:
    """The shape of a gamma distribution whose values have this mean and mean logarithm; the scale is the mean over it."""
    s = math.log(mean) - mean_log
    if not 0 < s < math.inf:
        raise NoFit("the values have no spread of logarithms")
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(100):
        # Newton on the logarithm of the shape, which stays above 0
        step = (math.log(a) - float(digamma(a)) - s) / (1 - a * float(trigamma(a)))
        a *= math.exp(-max(-2.0, min(2.0, step)))
        if abs(step) < 1e-14:
            break
    return a


def beta_shapes(mean: float, variance: float, mean_log: float, mean_log_rest: float) -> tuple[float, float]:
    """The shapes of a beta distribution whose values have these means of ln u and of ln(1 - u)."""
    if not (math.isfinite(mean_log) and math.isfinite(mean_log_rest)) or variance <= 0:
        raise NoFit("the values have no logarithms")
    both = max(mean * (1 - mean) / variance - 1, 0.05)
    p = np.array([mean * both, (1 - mean) * both])
    for _ in range(200):
        gradient = digamma(p) - digamma(p.sum()) - np.array([mean_log, mean_log_rest])
        hessian = np.diag(trigamma(p)) - trigamma(p.sum())
        step = np.linalg.solve(hessian * p[None, :], gradient)  # in logarithms of the shapes
        p = p * np.exp(-np.clip(step, -1.5, 1.5))
        if np.abs(step).max() < 1e-13:
            return float(p[0]), float(p[1])
    raise NoFit("the steps do not end")


def _truncated(t: np.ndarray, low: float, high: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a density like exp(t0 y + t1 y^2) between bounds (t1 below 0): its integral's logarithm, and the mean and covariance of y and y^2."""
    sigma = math.sqrt(-0.5 / t[1])
    mu = t[0] * sigma * sigma
    a, b = (low - mu) / sigma, (high - mu) / sigma
    z = _N.cdf(b) - _N.cdf(a) if a < 0 < b or a == b else abs(0.5 * (math.erfc(min(abs(a), abs(b)) / math.sqrt(2)) - math.erfc(max(abs(a), abs(b)) / math.sqrt(2))))
    if z <= 1e-290:
        raise NoFit("the bounds leave nothing of such a normal")
    fa, fb = _N.pdf(a) / z, _N.pdf(b) / z
    m = [1.0, fa - fb]  # moments of the standardized value
    for k in (2, 3, 4):
        m.append((k - 1) * m[k - 2] + a ** (k - 1) * fa - b ** (k - 1) * fb)
    y = [sum(math.comb(k, j) * mu ** (k - j) * sigma**j * m[j] for j in range(k + 1)) for k in range(5)]
    mean = np.array([y[1], y[2]])
    covariance = np.array([[y[2] - y[1] ** 2, y[3] - y[1] * y[2]], [y[3] - y[1] * y[2], y[4] - y[2] ** 2]])
    return math.log(z * sigma * math.sqrt(2 * math.pi)) + mu * mu / (2 * sigma * sigma), mean, covariance


def truncated_moments(a: float, b: float, loc: float, scale: float) -> tuple[float, float]:
    """Mean and deviation of a normal between ``a`` and ``b`` deviations from its location."""
    t = np.array([loc, -0.5]) / scale**2
    _, mean, _ = _truncated(np.array([t[0], t[1]]), loc + a * scale, loc + b * scale)
    return float(mean[0]), math.sqrt(float(mean[1] - mean[0] ** 2))


def truncated_normal(mean: float, sd: float, low: float, high: float) -> tuple[float, float]:
    """Location and scale of the likeliest normal between the bounds, which lies between them and is WIDEST widths wide at most.

    In the natural parameters the logarithm of the likelihood is concave and the bounds
    are lines: where the maximum is beyond one, the best point of the lines is taken.
    """
    low, high = (low - mean) / sd, (high - mean) / sd
    wanted = np.array([0.0, 1.0])  # the means of y and y^2, y being the standardized value
    most = -0.5 / (WIDEST * (high - low)) ** 2

    def height(t: np.ndarray) -> float:
        try:
            return float(t @ wanted) - _truncated(t, low, high)[0]
        except (NoFit, OverflowError):
            return -math.inf

    def climbed(t: np.ndarray, way: np.ndarray | None = None) -> np.ndarray:
        """Newton steps from ``t``, along ``way`` if it is given; t1 stays below its bound."""
        for _ in range(200):
            _, expected, covariance = _truncated(t, low, high)
            gradient = wanted - expected
            if way is None:
                step = np.linalg.solve(covariance, gradient)
            else:
                step = way * float(gradient @ way) / float(way @ covariance @ way)
            best, share = height(t), 1.0
            while share > 1e-12:
                new = t + share * step
                if new[1] < 0 and height(new) >= best - 1e-13 * abs(best):
                    break
                share /= 2
            else:
                return t
            t = new
            if np.abs(step).max() < 1e-13 * (1 + np.abs(t).max()):
                return t
        return t

    def inside(t: np.ndarray) -> bool:
        mu = -0.5 * t[0] / t[1]
        return t[1] <= most * (1 - 1e-12) and low <= mu <= high

    try:
        free = climbed(np.array([0.0, -0.5]))
    except (NoFit, np.linalg.LinAlgError, OverflowError):
        free = np.array([0.0, 0.0])
    if free[1] < 0 and inside(free):
        return float(mean - sd * 0.5 * free[0] / free[1]), float(sd * math.sqrt(-0.5 / free[1]))
    # on the lines mu = low, mu = high and t1 = most, within their ends
    candidates = []
    for mu in (low, high):
        way = np.array([-2 * mu, 1.0])
        t = climbed(-0.5 / max(1.0, mu * mu) * way, way)
        candidates.append(t if t[1] <= most else most * way)
    t = climbed(np.array([-2 * most * (low + high) / 2, most]), np.array([1.0, 0.0]))
    candidates.append(np.array([min(max(t[0], -2 * most * low), -2 * most * high), most]))
    best = max(candidates, key=height)
    return float(mean - sd * 0.5 * best[0] / best[1]), float(sd * math.sqrt(-0.5 / best[1]))


def student_t(bins: np.ndarray) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale from counts, sums and sums of squares in bins."""
    n, total, squares = bins.T
    x = total / n
    inner = np.maximum(squares / n - x * x, 0.0)
    loc = float(x[np.searchsorted(np.cumsum(n), n.sum() / 2)])
    spread = math.sqrt(float((n * (inner + (x - loc) ** 2)).sum() / n.sum()))
    if spread <= 0:
        raise NoFit("the values have no spread")

    def fitted(df: float, loc: float, scale: float) -> tuple[float, float, float]:
        """The best location and scale for so many degrees of freedom, and the mean log likelihood."""
        for _ in range(500):
            w = n * (df + 1) / (df + (inner + (x - loc) ** 2) / scale**2)
            new = float((w * x).sum() / w.sum())
            wide = math.sqrt(float((w * (inner + (x - new) ** 2)).sum() / w.sum()))  # the weights' sum in place of the count speeds it up
            moved = abs(new - loc) / spread + abs(wide - scale) / spread
            loc, scale = new, max(wide, 1e-12 * spread)
            if moved < 1e-12:
                break
        tail = float((n * np.log1p((inner + (x - loc) ** 2) / (df * scale**2))).sum() / n.sum())
        return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale) - (df + 1) / 2 * tail, loc, scale

    # golden sections of the logarithm of the degrees
    low, high, ratio = math.log(LEAST_DF), math.log(MOST_DF), (math.sqrt(5) - 1) / 2
    scale = spread / 2
    at = [high - ratio * (high - low), low + ratio * (high - low)]
    value = [fitted(math.exp(a), loc, scale) for a in at]
    while high - low > 1e-8:
        if value[0][0] >= value[1][0]:
            high, at[1], value[1] = at[1], at[0], value[0]
            at[0] = high - ratio * (high - low)
            value[0] = fitted(math.exp(at[0]), *value[1][1:])
        else:
            low, at[0], value[0] = at[0], at[1], value[1]
            at[1] = low + ratio * (high - low)
            value[1] = fitted(math.exp(at[1]), *value[0][1:])
    _, loc, scale = max(value)
    return math.exp((low + high) / 2), loc, scale
