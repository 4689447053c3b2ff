"""Numeric expressions that keep nulls: clipping, half-even rounding, logit, and the normal distribution."""

from __future__ import annotations

import math
from collections.abc import Sequence
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits that a double holds for certain.
MAX_DIGITS = 15


def as_double(x: Column, kind: T.DataType) -> Column:
    """A double in which NaN is null and there is no negative zero."""
    if isinstance(kind, T.StringType):
        x = x.try_cast("double")
    if isinstance(kind, T.BooleanType):
        x = x.cast("int")
    x = x.cast("double")
    return (F.nanvl(x, F.lit(None).cast("double")) if isinstance(kind, (T.DoubleType, T.FloatType, T.StringType)) else x) + F.lit(0.0)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Bounds a value; unlike greatest and least, keeps nulls."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def decimal_digits(x: Column) -> Column:
    """The digits after the point of a double's shortest text, which may have an exponent."""
    text = F.abs(x).cast("string")
    fraction = F.substring_index(F.substring_index(text, "E", 1), ".", -1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
    return F.greatest(F.when(fraction == "0", 0).otherwise(F.length(fraction)) - exponent, F.lit(0))


def digit_requests(x: Column) -> dict[str, Column]:
    """For one aggregation: the most decimal digits of a value, and the longest integer part."""
    size = F.abs(x)
    whole = F.when(size < 1e15, F.length(F.floor(size).cast("string"))).when(size.isNotNull(), F.lit(16))
    finite = size < F.lit(math.inf)
    return {"digits": F.max(F.when(finite, decimal_digits(x))), "whole": F.max(whole), "finite": F.bool_and(finite)}


def learned_digits(stats: dict) -> int | None:
    """The fewest digits that lose nothing, as far as doubles hold them; None: don't round."""
    if not stats["finite"]:
        return None
    return stats["digits"] if stats["digits"] <= max(0, MAX_DIGITS - (stats["whole"] or 0)) else None


def logit(x: Column, low: float, high: float) -> Column:
    """Log odds of a value between bounds, kept off the ends."""
    p = (x - low) / (high - low) * 0.95 + 0.025
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(v: Column, low: float, high: float) -> Column:
    """The inverse of :func:`logit`."""
    return (F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) - 0.025) / 0.95 * (high - low) + low


# Coefficients of Wichura's algorithm AS 241 (numerators, denominators; lowest power first).
_CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Coefficients of Cody's rational approximations of the error function (highest power first).
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _sql_polynomial(coefficients: Sequence[float], x: str) -> str:
    """Horner's scheme; coefficients from the highest power down."""
    out = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return out


def normal_ppf_sql(p: str) -> str:
    """SQL text (Spark's and ANSI) of the normal distribution's quantile at a column ``p`` in (0, 1)."""
    near = lambda pair, x: f"{_sql_polynomial(pair[0][::-1], x)} / {_sql_polynomial(pair[1][::-1], x)}"
    q = f"({p} - 0.5e0)"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1e0 - {p} END))"
    central = f"{q} * {near(_CENTRAL, f'(0.180625e0 - {q} * {q})')}"
    tails = f"CASE WHEN {r} <= 5e0 THEN {near(_MIDDLE, f'({r} - 1.6e0)')} ELSE {near(_TAIL, f'({r} - 5e0)')} END"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {central} WHEN {q} < 0 THEN -({tails}) ELSE {tails} END)"


def normal_cdf_sql(z: str) -> str:
    """SQL text of the normal distribution's probability up to a column ``z``."""
    x = f"({z} / {math.sqrt(2)!r}e0)"
    y = f"abs({x})"
    near = lambda pair, v: f"{_sql_polynomial(pair[0], v)} / {_sql_polynomial(pair[1], v)}"
    erf = f"{x} * {near(_ERF, f'({x} * {x})')}"
    low = f"exp(-{x} * {x}) * {near(_ERFC, y)}"
    w = f"(1e0 / ({x} * {x}))"
    tail = f"exp(-{x} * {x}) / {y} * ({1 / math.sqrt(math.pi)!r}e0 - {w} * {near(_ERFC_TAIL, w)})"
    erfc = f"CASE WHEN {y} <= 4e0 THEN {low} ELSE {tail} END"
    return f"(CASE WHEN {y} <= 0.46875e0 THEN 0.5e0 + 0.5e0 * {erf} WHEN {x} < 0 THEN 0.5e0 * ({erfc}) ELSE 1e0 - 0.5e0 * ({erfc}) END)"


def normal_ppf_of(p: np.ndarray) -> np.ndarray:
    """:func:`normal_ppf` of an array, for work in Arrow batches."""
    near = lambda pair, x: np.polyval(pair[0][::-1], x) / np.polyval(pair[1][::-1], x)
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    tails = np.where(r <= 5, near(_MIDDLE, r - 1.6), near(_TAIL, r - 5.0))
    return np.where(np.abs(q) <= 0.425, q * near(_CENTRAL, 0.180625 - q * q), np.sign(q) * tails)


def normal_cdf_of(z: np.ndarray) -> np.ndarray:
    """:func:`normal_cdf` of an array, for work in Arrow batches."""
    near = lambda pair, v: np.polyval(pair[0], v) / np.polyval(pair[1], v)
    x = z / math.sqrt(2)
    y, square = np.abs(x), x * x
    far = np.maximum(y, 4)
    w = 1 / (far * far)
    erfc = np.exp(-square) * np.where(y <= 4, near(_ERFC, np.minimum(y, 4)), (1 / math.sqrt(math.pi) - w * near(_ERFC_TAIL, w)) / far)
    return np.where(y <= 0.46875, 0.5 + 0.5 * x * near(_ERF, np.minimum(square, 1)), np.where(x < 0, 0.5 * erfc, 1 - 0.5 * erfc))


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def staged(df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
    """Compute ``x`` as a hidden column, so what uses it many times names it and doesn't repeat its expression."""
    name = f"_stage_{uuid4().hex[:12]}"
    return df.withColumn(name, x), F.col(name)


def normal_ppf(p: Column) -> Column:
    """The normal distribution's quantile at ``p`` in (0, 1); ``p`` should be a named column, as it is used many times."""
    near = lambda pair, x: _polynomial(pair[0][::-1], x) / _polynomial(pair[1][::-1], x)
    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    tails = F.when(r <= 5, near(_MIDDLE, r - F.lit(1.6))).otherwise(near(_TAIL, r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * near(_CENTRAL, F.lit(0.180625) - q * q)).when(q < 0, -tails).otherwise(tails)


def normal_cdf(z: Column) -> Column:
    """The normal distribution's probability up to ``z``; ``z`` should be a named column, as it is used many times."""
    x = z / F.lit(math.sqrt(2))
    y, square = F.abs(x), x * x
    near = lambda pair, v: _polynomial(pair[0], v) / _polynomial(pair[1], v)
    inner = F.lit(0.5) + F.lit(0.5) * x * near(_ERF, square)
    w = F.lit(1.0) / square
    erfc = F.when(y <= 4, F.exp(-square) * near(_ERFC, y)).otherwise(F.exp(-square) / y * (F.lit(1 / math.sqrt(math.pi)) - w * near(_ERFC_TAIL, w)))
    return F.when(y <= 0.46875, inner).when(x < 0, F.lit(0.5) * erfc).otherwise(F.lit(1.0) - F.lit(0.5) * erfc)
