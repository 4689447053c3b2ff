"""Numbers: formatting, scaling by logarithms, and normalising by a distribution or a mixture."""

from __future__ import annotations

import math
import warnings
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import OutOfBoundsError, TransformerInputError
from tessella.functions import numeric as N
from tessella.functions.distributions import FAMILIES, Fitted
from tessella.functions.likelihood import padded
from tessella.functions.mixtures import Binning, Mixture, fit_mixture
from tessella.operators.base import BaseTransformer
from tessella.operators.null import NullTransformer

#: Bounds of integers by their width.
INTEGER_BOUNDS = {f"{'U' * u}Int{b}": (0 if u else -(2 ** (b - 1)), 2 ** (b - 1 + u) - 1) for b in (8, 16, 32, 64) for u in (0, 1)}
#: Distance that probabilities keep from 0 and 1: the resolution of a 32-bit float.
EPSILON = 2.0**-23


def renamed_modelling(model_missing_values: bool | None, missing_value_generation: str | None) -> str | None:
    """The old parameter ``model_missing_values`` in terms of the new one."""
    if model_missing_values is None:
        return missing_value_generation
    warnings.warn("model_missing_values is deprecated: use missing_value_generation", FutureWarning, stacklevel=3)
    return "from_column" if model_missing_values else "random"


class FloatFormatter(BaseTransformer):
    """Numbers as doubles without nulls; back with the input's type, rounding and bounds."""

    INPUT_SDTYPE = "numerical"
    SUPPORTED_SDTYPES = ["numerical"]

    def __init__(self, missing_value_replacement: Any = "mean", model_missing_values: bool | None = None, learn_rounding_scheme: bool = False, enforce_min_max_values: bool = False, computer_representation: str = "Float", missing_value_generation: str | None = "random"):
        super().__init__()
        self.missing_value_replacement = missing_value_replacement
        self.missing_value_generation = renamed_modelling(model_missing_values, missing_value_generation)
        self.learn_rounding_scheme, self.enforce_min_max_values, self.computer_representation = learn_rounding_scheme, enforce_min_max_values, computer_representation
        self.null_transformer = NullTransformer(missing_value_replacement, self.missing_value_generation)
        self.digits: int | None = None
        self.low = self.high = None

    @property
    def wants_values(self) -> bool:
        return self.null_transformer.wants_values

    def number(self, x: dict[str, Column]) -> Column:
        return N.as_double(x[self.columns[0]], self.kinds[self.columns[0]])

    def requests(self, x, kinds):
        v = self.number(x)
        out = self.null_transformer.requests(v)
        if self.enforce_min_max_values:
            out |= {"low": F.min(v), "high": F.max(v)}
        if self.learn_rounding_scheme:
            out |= N.digit_requests(v)
        if self.computer_representation != "Float":
            low, high = INTEGER_BOUNDS[self.computer_representation]
            out |= {"rep_low": F.min(v), "rep_high": F.max(v), "rep_whole": F.bool_and(v == F.floor(v))}
        return out

    def bind(self, stats, values):
        self.null_transformer.bind(stats, values)
        self.name_properties()
        if self.enforce_min_max_values:
            self.low, self.high = stats["low"], stats["high"]
        if self.learn_rounding_scheme:
            self.digits = N.learned_digits(stats)
        self.check_representation(stats.get("rep_low"), stats.get("rep_high"), stats.get("rep_whole"))

    def name_properties(self) -> None:
        self.output_properties = {None: {"sdtype": "float", "next_transformer": None}}
        if self.null_transformer.models_missing_values():
            self.output_properties["is_null"] = {"sdtype": "float", "next_transformer": None}

    def check_representation(self, low, high, whole) -> None:
        if self.computer_representation == "Float" or low is None:
            return
        least, most = INTEGER_BOUNDS[self.computer_representation]
        for value, bad in ((low, low < least), (high, high > most)):
            if bad:
                raise ValueError(f"column '{self.columns[0]}' has {value}, which {self.computer_representation} ({least} to {most}) can't hold")
        if not whole:
            raise ValueError(f"column '{self.columns[0]}' has fractions, which {self.computer_representation} can't hold")

    def _set_fitted_parameters(self, column_name: str, null_transformer: NullTransformer, rounding_digits: int | None = None, min_max_values: tuple | None = None, dtype: T.DataType | None = None) -> None:
        """Fit without data."""
        self.columns, self.kinds = [column_name], {column_name: dtype or T.DoubleType()}
        self.null_transformer, self.digits, self.fitted = null_transformer, rounding_digits, True
        if self.enforce_min_max_values and not min_max_values:
            raise TransformerInputError("enforce_min_max_values needs min_max_values")
        if min_max_values:
            self.low, self.high = min_max_values
            self.enforce_min_max_values = True
        self.name_properties()
        self.name_outputs([])

    def filled(self, df, x, draws) -> tuple[Column, dict]:
        v, flag = self.null_transformer.forward(self.number(x), draws)
        return v, {} if flag is None else {"is_null": flag}

    def forward(self, df, x, draws):
        v, flags = self.filled(df, x, draws)
        return df, {None: v} | flags

    def formatted(self, v: Column, flag: Column | None, draws) -> Column:
        """Nulls, bounds, digits and type of the input."""
        v = self.null_transformer.inverse(v, flag, draws)
        kind = self.kinds[self.columns[0]]
        if self.enforce_min_max_values:
            v = N.clip(v, self.low, self.high)
        elif self.computer_representation != "Float":
            v = N.clip(v, *map(float, INTEGER_BOUNDS[self.computer_representation]))
        whole = isinstance(kind, T.IntegralType) or self.computer_representation != "Float"
        if self.learn_rounding_scheme and self.digits is not None:
            v = N.round_half_even(v, self.digits)
        elif whole:
            v = N.round_half_even(v)
        return v.try_cast(kind) if isinstance(kind, (T.IntegralType, T.DecimalType)) else v.cast(kind)

    def inverse(self, df, y, draws):
        return df, {self.columns[0]: self.formatted(y[None], y.get("is_null"), draws)}


class LogScaler(FloatFormatter):
    """The logarithm of the distance from a constant.

    Values at the constant or on its wrong side are an error. With ``refuse=False`` they
    have the logarithms of floating-point arithmetic: minus infinity at the constant, NaN beyond.
    """

    #: What operators have that were stored before there was a choice.
    refuse = True

    def __init__(self, missing_value_replacement: Any = "mean", missing_value_generation: str | None = "random", constant: float = 0.0, invert: bool = False, learn_rounding_scheme: bool = False, refuse: bool = True):
        if not isinstance(constant, (int, float)):
            raise ValueError("constant must be a number")
        if not isinstance(invert, bool):
            raise ValueError("invert must be true or false")
        super().__init__(missing_value_replacement, None, learn_rounding_scheme, False, "Float", missing_value_generation)
        self.constant, self.invert, self.refuse = constant, invert, refuse

    def requests(self, x, kinds):
        v = self.number(x)
        return super().requests(x, kinds) | {"edge": F.max(v) if self.invert else F.min(v)}

    def bind(self, stats, values):
        super().bind(stats, values)
        fill = self.null_transformer.value
        seen = [v for v in (stats["edge"], fill if stats["null_nulls"] else None) if v is not None]
        if self.refuse and any(v >= self.constant if self.invert else v <= self.constant for v in seen):
            wrong = lambda v: v >= self.constant if self.invert else v <= self.constant
            raise OutOfBoundsError(f"column '{self.columns[0]}' has values that aren't {'below' if self.invert else 'above'} the constant {self.constant}, so they have no logarithm", wrong)

    def forward(self, df, x, draws):
        v, flags = self.filled(df, x, draws)
        gap = F.lit(float(self.constant)) - v if self.invert else v - F.lit(float(self.constant))
        found = F.when(gap > 0, F.log(gap))
        if self.refuse:  # a value on the wrong side is an error, not a null
            found = found.when(gap.isNotNull(), F.raise_error(F.lit(f"column '{self.columns[0]}' has a value on the wrong side of {self.constant}")).cast("double"))
        else:  # Spark's logarithm has nulls there
            found = found.when(gap == 0, F.lit(-math.inf)).when(gap < 0, F.lit(math.nan))
        return df, {None: found} | flags

    def inverse(self, df, y, draws):
        v = F.lit(float(self.constant)) - F.exp(y[None]) if self.invert else F.exp(y[None]) + F.lit(float(self.constant))
        return df, {self.columns[0]: self.formatted(v, y.get("is_null"), draws)}


class LogitScaler(FloatFormatter):
    """Log odds of a value between two bounds."""

    def __init__(self, missing_value_replacement: Any = "mean", missing_value_generation: str | None = "random", min_value: float = 0.0, max_value: float = 1.0, learn_rounding_scheme: bool = False):
        for name, value in (("min_value", min_value), ("max_value", max_value)):
            if not isinstance(value, (int, float)):
                raise TransformerInputError(f"{name} must be a number")
        if min_value >= max_value:
            raise TransformerInputError(f"min_value ({min_value}) must be below max_value ({max_value})")
        super().__init__(missing_value_replacement, None, learn_rounding_scheme, False, "Float", missing_value_generation)
        self.min_value, self.max_value = float(min_value), float(max_value)

    def outside(self, v: Column) -> Column:
        return (v < self.min_value) | (v > self.max_value)

    def requests(self, x, kinds):
        v = self.number(x)
        return super().requests(x, kinds) | {"below": F.min(v), "above": F.max(v)}

    def bind(self, stats, values):
        super().bind(stats, values)
        bad = [v for v, out in ((stats["below"], (stats["below"] or 0) < self.min_value), (stats["above"], (stats["above"] or 0) > self.max_value)) if v is not None and out]
        if bad:
            raise OutOfBoundsError(f"column '{self.columns[0]}' has values outside [{self.min_value}, {self.max_value}]", self.outside)

    def forward(self, df, x, draws):
        v, flags = self.filled(df, x, draws)
        problem = F.raise_error(F.lit(f"column '{self.columns[0]}' has a value outside [{self.min_value}, {self.max_value}]")).cast("double")
        return df, {None: F.when(self.outside(v), problem).otherwise(N.logit(v, self.min_value, self.max_value))} | flags

    def inverse(self, df, y, draws):
        return df, {self.columns[0]: self.formatted(N.sigmoid(y[None], self.min_value, self.max_value), y.get("is_null"), draws)}


class GaussianNormalizer(FloatFormatter):
    """A standard normal value by the probability under a fitted distribution."""

    OLD_NAMES = {"gaussian": "norm", "student_t": "t", "truncated_gaussian": "truncnorm"}

    def __init__(self, model_missing_values: bool | None = None, learn_rounding_scheme: bool = False, enforce_min_max_values: bool = False, distribution: str = "truncnorm", missing_value_generation: str | None = "random"):
        super().__init__("mean", None, learn_rounding_scheme, enforce_min_max_values, "Float", renamed_modelling(model_missing_values, missing_value_generation))
        if distribution in self.OLD_NAMES:
            warnings.warn(f"the name {distribution!r} is deprecated: use {self.OLD_NAMES[distribution]!r}", FutureWarning, stacklevel=2)
            distribution = self.OLD_NAMES[distribution]
        if distribution not in FAMILIES:
            raise ValueError(f"unknown distribution {distribution!r}: use one of {sorted(FAMILIES)}")
        self.distribution = distribution
        self.fitted_distribution: Fitted | None = None

    def requests(self, x, kinds):
        v = self.number(x)
        out = super().requests(x, kinds)
        out |= {"d_mean": F.avg(v), "d_sd": F.stddev_pop(v), "d_low": F.min(v), "d_high": F.max(v)}
        if self.distribution in ("gaussian_kde", "t"):
            out["d_quartiles"] = F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000)
        return out

    def bind(self, stats, values):
        super().bind(stats, values)
        own = {k[2:]: v for k, v in stats.items() if k.startswith("d_")}
        if own["mean"] is None or not math.isfinite(own["sd"]):
            own |= {"mean": own["mean"] if own["mean"] is not None and math.isfinite(own["mean"]) else 0.0, "sd": 0.0, "low": 0.0, "high": 0.0}
        own["n"] = max(1, stats["null_n"] - stats["null_nulls"])
        self.moments = own
        # families that need more than moments have the normal until then
        self.fitted_distribution = Fitted.of("norm" if own["sd"] > 0 and self.distribution in ("gamma", "beta", "t", "gaussian_kde") else self.distribution, own)

    def later(self, x):
        if self.distribution not in ("gamma", "beta") or not self.moments["sd"]:
            return {}
        start, width = padded(self.moments["low"], self.moments["high"], self.moments["n"])
        v = self.number(x)
        out = {"log": F.avg(F.log(v - F.lit(start)))}
        return out if self.distribution == "gamma" else out | {"log_rest": F.avg(F.log(F.lit(start + width) - v))}

    def binning(self, x):
        if self.distribution not in ("t", "gaussian_kde") or not self.moments["sd"]:
            return None
        own = self.moments
        return Binning.of(self.number(x), own["quartiles"], own["sd"], own["low"], own["high"])

    def bind_later(self, stats, bins):
        if self.distribution == "gaussian_kde":
            self.fitted_distribution = Fitted.of_kernels(bins, self.moments["quartiles"][1], self.moments["sd"])
        else:
            self.fitted_distribution = Fitted.of(self.distribution, self.moments, stats, bins)

    @property
    def learned_distribution(self) -> dict:
        self.require_fitted()
        return {"distribution": self.fitted_distribution.family, "parameters": dict(self.fitted_distribution.parameters)}

    def forward(self, df, x, draws):
        v, flags = self.filled(df, x, draws)
        df, v = N.staged(df, v)
        df, z = self.fitted_distribution.normalized(df, v, EPSILON)
        return df, {None: z} | flags

    def inverse(self, df, y, draws):
        df, v = self.fitted_distribution.value(df, y[None].cast("double"))
        return df, {self.columns[0]: self.formatted(v, y.get("is_null"), draws)}


class ClusterBasedNormalizer(FloatFormatter):
    """A component of a fitted mixture, drawn by its posterior, and the value's place in it."""

    def __init__(self, model_missing_values: bool | None = None, learn_rounding_scheme: bool = False, enforce_min_max_values: bool = False, max_clusters: int = 10, weight_threshold: float = 0.005, missing_value_generation: str | None = "random"):
        super().__init__("mean", None, learn_rounding_scheme, enforce_min_max_values, "Float", renamed_modelling(model_missing_values, missing_value_generation))
        self.max_clusters, self.weight_threshold = max_clusters, weight_threshold
        self.mixture: Mixture | None = None

    def name_properties(self) -> None:
        self.output_properties = {"normalized": {"sdtype": "float", "next_transformer": None}, "component": {"sdtype": "categorical", "next_transformer": None}}
        if self.null_transformer.models_missing_values():
            self.output_properties["is_null"] = {"sdtype": "float", "next_transformer": None}

    def requests(self, x, kinds):
        v = self.number(x)
        return super().requests(x, kinds) | {"m_quartiles": F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000), "m_mean": F.avg(v), "m_sd": F.stddev_pop(v), "m_low": F.min(v), "m_high": F.max(v)}

    def bind(self, stats, values):
        super().bind(stats, values)
        self.extremes = (stats["m_low"], stats["m_high"])
        self.scale = (stats["m_quartiles"] or [0.0] * 3, stats["m_sd"] or 0.0)
        self.mixture = Mixture([1.0], [stats["m_mean"] or 0.0], [max(stats["m_sd"] or 0.0, 1e-6)])

    def binning(self, x):
        """The values with the mean in place of nulls, in bins: their number bounds the driver's part."""
        if self.extremes[0] is None or not math.isfinite(self.scale[1]):
            return None
        return Binning.of(F.coalesce(self.number(x), F.lit(self.null_transformer.value)), *self.scale, *self.extremes)

    def bind_later(self, stats, bins):
        found = fit_mixture(bins, self.max_clusters, self.weight_threshold)
        self.mixture = found.shifted(self.scale[0][1]) if found else self.mixture

    def forward(self, df, x, draws):
        v, flags = self.filled(df, x, draws)
        df, v = N.staged(df, v)
        df, normalized, component = self.mixture.drawn(df, v, draws.uniform("component"))
        return df, {"normalized": normalized, "component": component} | flags

    def inverse(self, df, y, draws):
        v = self.mixture.value(y["normalized"], y["component"])
        return df, {self.columns[0]: self.formatted(v, y.get("is_null"), draws)}
