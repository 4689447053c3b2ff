"""Booleans as 0 and 1."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.operators.null import NullTransformer
from tessella.operators.numeric import FloatFormatter, renamed_modelling


class BinaryEncoder(FloatFormatter):
    """Booleans as doubles; back by rounding."""

    INPUT_SDTYPE = "boolean"
    SUPPORTED_SDTYPES = ["boolean"]

    def __init__(self, missing_value_replacement: Any = "mode", model_missing_values: bool | None = None, missing_value_generation: str | None = "random"):
        super().__init__(missing_value_replacement, None, False, False, "Float", renamed_modelling(model_missing_values, missing_value_generation))

    def _set_fitted_parameters(self, column_name: str, null_transformer: NullTransformer) -> None:
        """Fit without data."""
        from pyspark.sql import types as T

        super()._set_fitted_parameters(column_name, null_transformer, dtype=T.BooleanType())

    def inverse(self, df, y, draws):
        v = self.null_transformer.inverse(y[None], y.get("is_null"), draws)
        v = N.clip(N.round_half_even(v.cast("double")), 0.0, 1.0)
        kind = self.kinds[self.columns[0]]
        return df, {self.columns[0]: F.when(v.isNotNull(), v > 0.5).cast(kind)}
