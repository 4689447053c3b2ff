"""Operators by name and by sdtype, the defaults, and plugins."""

from __future__ import annotations

import importlib.metadata
import warnings

from pyspark.sql import types as T

from tessella.operators.base import BaseMultiColumnTransformer, BaseTransformer
from tessella.operators.boolean import BinaryEncoder
from tessella.operators.categorical import CustomLabelEncoder, FrequencyEncoder, LabelEncoder, OneHotEncoder, OrderedLabelEncoder, OrderedUniformEncoder, UniformEncoder
from tessella.operators.ids import IDGenerator, IndexGenerator, RegexGenerator
from tessella.operators.null import NullTransformer
from tessella.operators.numeric import ClusterBasedNormalizer, FloatFormatter, GaussianNormalizer, LogitScaler, LogScaler
from tessella.operators.pii import AnonymizedFaker, PseudoAnonymizedFaker, get_anonymized_transformer
from tessella.operators.temporal import OptimizedTimestampEncoder, UnixTimestampEncoder

#: Group of entry points whose modules are imported by :func:`load_plugins`.
PLUGINS = "tessella_plugins"


def get_transformers() -> dict[str, type[BaseTransformer]]:
    """All operators by name, users' subclasses too."""
    inner = {"Generator", "ColumnFunctions", "_Categories"}
    return {c.__name__: c for c in BaseTransformer.get_subclasses() if c.__name__ not in inner and c is not BaseMultiColumnTransformer}


def get_transformer_name(transformer: type) -> str:
    if not isinstance(transformer, type) or not issubclass(transformer, BaseTransformer):
        raise ValueError(f"{transformer!r} is not a class of operators")
    return transformer.__name__


def get_class_by_transformer_name() -> dict[str, type[BaseTransformer]]:
    return get_transformers()


def get_transformer_class(name: str) -> type[BaseTransformer]:
    found = get_transformers().get(name.rpartition(".")[2])
    if found is None:
        raise ValueError(f"there is no operator {name!r}")
    return found


def get_transformers_by_type() -> dict[str | None, list[type[BaseTransformer]]]:
    out: dict[str | None, list] = {}
    for c in get_transformers().values():
        for sdtype in c.get_supported_sdtypes():
            out.setdefault(sdtype, []).append(c)
    return out


def get_default_transformers() -> dict[str, BaseTransformer]:
    """An instance for each sdtype."""
    return {
        "numerical": FloatFormatter(), "categorical": UniformEncoder(), "boolean": UniformEncoder(), "datetime": UnixTimestampEncoder(),
        "id": RegexGenerator(), "text": RegexGenerator(), "pii": AnonymizedFaker(),
    }


def get_default_transformer(sdtype: str) -> BaseTransformer:
    found = get_default_transformers().get(sdtype)
    if found is not None:
        return found
    suited = get_transformers_by_type().get(sdtype)
    if not suited:
        raise ValueError(f"no operator takes the sdtype {sdtype!r}")
    return suited[0]()


def sdtype_of(kind: T.DataType) -> str:
    """The sdtype of a column's type. Decimals are numbers and dates are datetimes."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numerical"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "categorical"
    raise TypeError(f"columns of type {kind.simpleString()} have no sdtype: set it, or leave them out")


def load_plugins() -> list[str]:
    """Import the modules that installed packages register as plugins; what fails is a warning."""
    loaded = []
    for entry in importlib.metadata.entry_points(group=PLUGINS):
        try:
            entry.load()
            loaded.append(entry.name)
        except Exception as e:  # noqa: BLE001  a plugin's fault must not stop the rest
            warnings.warn(f"the plugin {entry.name!r} can't be loaded: {e}", stacklevel=2)
    return loaded


__all__ = [
    "AnonymizedFaker", "BinaryEncoder", "ClusterBasedNormalizer", "CustomLabelEncoder", "FloatFormatter", "FrequencyEncoder", "GaussianNormalizer", "IDGenerator", "IndexGenerator", "LabelEncoder",
    "LogScaler", "LogitScaler", "NullTransformer", "OneHotEncoder", "OptimizedTimestampEncoder", "OrderedLabelEncoder", "OrderedUniformEncoder", "PseudoAnonymizedFaker", "RegexGenerator", "UniformEncoder",
    "UnixTimestampEncoder", "get_anonymized_transformer", "get_default_transformer", "get_default_transformers", "get_transformer_class", "get_transformer_name", "get_transformers", "get_transformers_by_type", "load_plugins",
]
