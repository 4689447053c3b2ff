"""Dates and times as nanoseconds since the epoch, or as a coarser unit that loses nothing."""

from __future__ import annotations

import warnings
from datetime import UTC
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidDataError
from tessella.functions import date_shapes as S
from tessella.functions import dates as D
from tessella.functions import numeric as N
from tessella.operators.numeric import FloatFormatter, renamed_modelling

#: Factors by which the unit may grow: from nanoseconds by thousands to seconds, then minutes, hours and days.
UNITS = [10, 100, 1000, 10**4, 10**5, 10**6, 10**7, 10**8, 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9]


class UnixTimestampEncoder(FloatFormatter):
    """Nanoseconds since the epoch as doubles.

    Strings and numbers are parsed by ``datetime_format`` (strftime), or by the patterns
    that a scan of their shapes infers. Where all have one form, they come back in it; of
    several forms, each is parsed by its own, and they come back as ISO dates and times.
    Strings with one zone keep it; with several they become UTC.
    """

    INPUT_SDTYPE = "datetime"
    SUPPORTED_SDTYPES = ["datetime"]

    def __init__(self, missing_value_replacement: Any = "mean", model_missing_values: bool | None = None, datetime_format: str | None = None, missing_value_generation: str | None = "random", enforce_min_max_values: bool = False):
        super().__init__(missing_value_replacement, None, False, enforce_min_max_values, "Float", renamed_modelling(model_missing_values, missing_value_generation))
        self.datetime_format, self.given_format = datetime_format, datetime_format is not None
        #: The patterns of several forms, if the fit has found such.
        self.forms: list[str] = []
        self.zone: str | None = None
        self.mixed_zones = False

    def is_text(self) -> bool:
        return not isinstance(self.kinds[self.columns[0]], (T.TimestampType, T.TimestampNTZType, T.DateType))

    def patterns(self) -> list[str | None]:
        return [self.datetime_format] if self.datetime_format else self.forms or [None]

    def micros(self, x):
        """Microseconds by the first pattern that a value fits."""
        found = [D.micros(x[self.columns[0]], self.kinds[self.columns[0]], p) for p in self.patterns()]
        return found[0] if len(found) == 1 else F.coalesce(*found)

    def nanoseconds(self, x):
        return D.nanoseconds(self.micros(x))

    def number(self, x):
        return self.nanoseconds(x) / F.lit(float(self.unit()))

    def unit(self) -> int:
        return 1

    def texts(self, x):
        # with no pattern given, the shapes of all values tell it; the statistics are then of what is inferred
        if not self.is_text() or self.given_format:
            return None
        text = x[self.columns[0]].cast("long").cast("string") if isinstance(self.kinds[self.columns[0]], (T.DoubleType, T.FloatType)) else x[self.columns[0]].cast("string")
        return text if isinstance(self.kinds[self.columns[0]], T.StringType) else D.whole_pairs(text)

    def choose(self, shapes):
        if shapes is None:
            raise InvalidDataError(f"column '{self.columns[0]}' has more than {S.MOST_SHAPES} shapes of values: they fit no known pattern")
        found, odd = S.infer(shapes)
        if odd is not None:
            raise InvalidDataError(f"column '{self.columns[0]}' has values of the shape {odd!r}, which fit no known pattern")
        self.datetime_format, self.forms = (found[0], []) if len(found) == 1 else (None, found)
        if len(found) > 1:
            warnings.warn(f"column '{self.columns[0]}' has several forms of dates: {found}", stacklevel=2)

    def requests(self, x, kinds):
        out = super().requests(x, kinds)
        if self.is_text():
            text = x[self.columns[0]].cast("string")
            zone = D.offset_of(text)  # null for a null
            out |= {"misfits": F.count_if(x[self.columns[0]].isNotNull() & self.micros(x).isNull()), "zone_low": F.min(zone), "zone_high": F.max(zone), "example": F.min(text)}
        return out

    def bind(self, stats, values):
        if self.is_text():
            if stats["misfits"]:
                raise InvalidDataError(f"column '{self.columns[0]}' has values, such as {stats['example']!r}, that don't fit {' or '.join(p or 'any known pattern' for p in self.patterns())}")
            self.learn_zone(stats)
        super().bind(self.scaled(stats), values)

    def scaled(self, stats: dict) -> dict:
        return stats

    def learn_zone(self, stats: dict) -> None:
        if not any(D.has_zone(p) for p in self.patterns()):
            return
        self.mixed_zones = stats["zone_low"] != stats["zone_high"]
        if self.mixed_zones:
            warnings.warn(f"column '{self.columns[0]}' has several time zones: its values become UTC", stacklevel=2)
        else:
            self.zone = stats["zone_low"] or None

    def _set_fitted_parameters(self, column_name: str, null_transformer, min_max_values: tuple | None = None, dtype: T.DataType | None = None) -> None:
        """Fit without data; the extremes are timestamps or nanoseconds."""
        told = lambda v: v.replace(tzinfo=v.tzinfo or UTC).timestamp() * 1e9 if hasattr(v, "timestamp") else v
        ends = tuple(float(told(v)) for v in min_max_values) if min_max_values else None
        super()._set_fitted_parameters(column_name, null_transformer, None, ends, dtype or T.TimestampNTZType())

    def formatted(self, v, flag, draws):
        v = self.null_transformer.inverse(v, flag, draws)
        v = N.round_half_even(v.cast("double"))
        if self.enforce_min_max_values:
            v = N.clip(v, self.low, self.high)
        micros = F.round(v * F.lit(float(self.unit())) / F.lit(1000.0)).cast("long")
        kind = self.kinds[self.columns[0]]
        if not self.is_text():
            return D.to_kind(micros, kind)
        if self.datetime_format is None:
            return D.to_kind(micros, T.TimestampNTZType()).cast("string").cast(kind)
        if self.zone and D.has_zone(self.datetime_format):
            hours = self.zone if self.zone[0] not in "+-" or ":" in self.zone else f"{self.zone[:3]}:{self.zone[3:] or '00'}"
            micros = D.in_zone(micros, hours) if hours not in ("Z", "UTC") else micros
        text = D.formatted(micros, self.datetime_format.replace("%z", self._literal(self.zone or "+0000")).replace("%Z", self._literal(self.zone or "UTC")))
        return text if isinstance(kind, T.StringType) else text.try_cast(kind)

    @staticmethod
    def _literal(text: str) -> str:
        return text.replace("%", "%%")


class OptimizedTimestampEncoder(UnixTimestampEncoder):
    """The unit is the largest that divides all values; it stays what the fit found."""

    def __init__(self, missing_value_replacement: Any = "mean", model_missing_values: bool | None = None, datetime_format: str | None = None, missing_value_generation: str | None = "random", enforce_min_max_values: bool = False):
        super().__init__(missing_value_replacement, model_missing_values, datetime_format, missing_value_generation, enforce_min_max_values)
        self.divider = 1

    def unit(self) -> int:
        return self.divider if self.fitted else 1  # nanoseconds while statistics are made

    def requests(self, x, kinds):
        out = super().requests(x, kinds)
        # microseconds are integers, so divisibility is exact; smaller units always divide
        micros = self.micros(x)
        return out | {f"unit{u}": F.bool_and(F.pmod(micros, F.lit(u // 1000)) == 0) for u in UNITS if u > 1000}

    def scaled(self, stats):
        for u in UNITS:
            if u > 1000 and not stats.get(f"unit{u}"):
                break
            self.divider = u
        if stats["null_n"] == stats["null_nulls"]:
            self.divider = 1
        out = dict(stats)
        for name in ("null_mean", "null_low", "null_high", "low", "high"):
            if out.get(name) is not None:
                out[name] = float(out[name] // self.divider) if name != "null_mean" else out[name] / self.divider
        return out

    def number(self, x):
        if not self.fitted:
            return self.nanoseconds(x)
        # from microseconds, which are integers: a double of nanoseconds may lie just below its value
        micros, unit = self.micros(x), F.lit(max(1, self.divider // 1000))
        return ((micros - F.pmod(micros, unit)) / unit).cast("double")

    def filled(self, df, x, draws):
        v, flag = self.null_transformer.forward(self.number(x), draws)
        return F.floor(v).cast("double"), {} if flag is None else {"is_null": flag}
