"""The contract of operators.

An operator names the aggregates it needs (``requests``), or that it needs its column's
distinct values with their counts (``wants_values``); a plan fuses the requests of many
operators into one scan each. ``bind`` takes the results. ``forward`` and ``inverse``
give columns, and the frame with whatever had to be joined for them.

Operators keep no rows. Random numbers depend on a row's key, so a key column (or
several) makes results repeatable; without one, rows are numbered by their place in
the input's partitions.
"""

from __future__ import annotations

import copy
import inspect
import warnings
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import NotFittedError, TransformerInputError
from tessella.functions.lookup import Dictionary
from tessella.functions.mixtures import Binning
from tessella.functions.rng import Draws
from tessella.functions.watch import Watch

#: The hidden column that holds a row's key.
KEY = "__row_key"
#: The ``row_key`` of tables without one of their own: a row's file and its number in it, so results are the same on any partitioning.
FILE_ROWS = "_metadata"
#: What ``forward`` may give beside its outputs: whether the fit has not seen a row's value. It is evaluated only if it is watched.
UNSEEN = "__unseen"


def file_rows(df: DataFrame) -> DataFrame | None:
    """Rows with their file and their number in it as the key; None if the data aren't read straight from Parquet files.

    Selections, filters, sorts and repartitions keep where a row is from; joins, unions and groupings don't.
    """
    try:
        return df.withColumn(KEY, F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))
    except AnalysisException:
        return None


def with_key(df: DataFrame, row_key: str | list[str] | None) -> DataFrame:
    """Add the key column: the given columns as text, a row's place in its file (FILE_ROWS), or its number in its partition."""
    if KEY in df.columns:
        return df
    if row_key == FILE_ROWS and FILE_ROWS not in df.columns:
        if (found := file_rows(df)) is not None:
            return found
        warnings.warn("the rows don't come straight from Parquet files: random numbers go by a row's place in its partition, and are others on another partitioning", stacklevel=3)
        row_key = None
    names = [row_key] if isinstance(row_key, str) else list(row_key or [])
    # without a key a row has its place in the input's partitions: an input that is not read from files should be stored first
    if not names:
        return df.withColumn(KEY, F.monotonically_increasing_id().cast("string"))
    return df.withColumn(KEY, F.concat_ws("|", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]))


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


class BaseTransformer:
    """One column in, one or more columns out."""

    INPUT_SDTYPE: str | None = None
    SUPPORTED_SDTYPES: list[str] | None = None
    IS_GENERATOR = False
    #: Whether columns of arrays, maps and structs are taken.
    TAKES_NESTED = False
    #: Whether fitting needs the column's distinct values.
    wants_values = False

    def __init__(self):
        self.columns: list[str] = []
        self.kinds: dict[str, T.DataType] = {}
        self.output_properties: dict[str | None, dict] = {None: {"sdtype": "float", "next_transformer": None}}
        self.output_columns: list[str] = []
        self.prefix: str | None = None
        self.row_key: str | list[str] | None = None
        self.seeds = {"fit": 42, "transform": 43, "reverse_transform": 44}
        self.calls = {"transform": 0, "reverse_transform": 0}
        self.fitted = False

    # what operators define

    def texts(self, x: dict[str, Column]) -> Column | None:
        """Strings whose shapes must be known before ``requests``: one scan for all operators that have some."""
        return None

    def choose(self, shapes: list[tuple[str, int, list, list]] | None) -> None:
        """Take the shapes of ``texts`` (shape, rows, the least and the largest of each number); None if there are too many."""

    def requests(self, x: dict[str, Column], kinds: dict[str, T.DataType]) -> dict[str, Column]:
        """Aggregates by name."""
        return {}

    def bind(self, stats: dict[str, Any], values: Dictionary | None) -> None:
        """Take the aggregates and, if wanted, the distinct values."""

    def later(self, x: dict[str, Column]) -> dict[str, Column]:
        """Aggregates by name that need what ``bind`` took: one scan for all operators that have some."""
        return {}

    def binning(self, x: dict[str, Column]) -> Binning | None:
        """A column whose sums in bins are needed: one scan for all operators that have one."""
        return None

    def bind_later(self, stats: dict[str, Any], bins: Any) -> None:
        """Take the results of ``later`` and ``binning``, if there were any."""

    def forward(self, df: DataFrame, x: dict[str, Column], draws: Draws) -> tuple[DataFrame, dict[str | None, Column]]:
        """Output columns by suffix (None: no suffix)."""
        raise NotImplementedError

    def inverse(self, df: DataFrame, y: dict[str | None, Column], draws: Draws) -> tuple[DataFrame, dict[str, Column]]:
        """Input columns by name."""
        raise NotImplementedError

    def validate(self, data: DataFrame) -> None:
        """Warn of values that the operator can't keep; asked for by ``transform(data, validate=True)``."""

    # metadata

    @classmethod
    def get_name(cls) -> str:
        return cls.__name__

    @classmethod
    def get_subclasses(cls) -> list[type[BaseTransformer]]:
        found = []
        for sub in cls.__subclasses__():
            found += [sub] if not inspect.isabstract(sub) and not sub.__name__.startswith("Base") else []
            found += sub.get_subclasses()
        return found

    @classmethod
    def get_input_sdtype(cls) -> str | None:
        return cls.INPUT_SDTYPE

    @classmethod
    def get_supported_sdtypes(cls) -> list[str | None]:
        return list(cls.SUPPORTED_SDTYPES or [cls.INPUT_SDTYPE])

    def is_generator(self) -> bool:
        return self.IS_GENERATOR

    def get_input_column(self) -> str:
        return self.columns[0]

    def get_input_columns(self) -> list[str]:
        return self.columns

    def get_output_columns(self) -> list[str]:
        return list(self.output_columns)

    def outputs_by_name(self) -> dict[str, str | None]:
        """Output column to suffix."""
        return dict(zip(self.output_columns, self.output_properties, strict=True))

    def get_output_sdtypes(self) -> dict[str, str]:
        return {n: self.output_properties[s]["sdtype"] for n, s in self.outputs_by_name().items()}

    def get_next_transformers(self) -> dict[str, BaseTransformer | None]:
        return {n: self.output_properties[s].get("next_transformer") for n, s in self.outputs_by_name().items()}

    def __repr__(self) -> str:
        """The class and the parameters that aren't the defaults."""
        shown = []
        for name, p in list(inspect.signature(type(self).__init__).parameters.items())[1:]:
            value = getattr(self, name, p.default)
            if p.default is inspect.Parameter.empty or value != p.default:
                shown.append(f"{name}={value!r}")
        return f"{type(self).__name__}({', '.join(shown)})"

    # random state

    def set_random_state(self, seed: int, method: str) -> None:
        if method not in self.seeds:
            raise ValueError(f"'{method}' is not one of {sorted(self.seeds)}")
        self.seeds[method] = seed

    def reset_randomization(self) -> None:
        """The next calls give what the first ones gave."""
        self.calls = dict.fromkeys(self.calls, 0)

    def draws(self, method: str) -> Draws:
        return Draws(F.col(KEY), self.seeds[method], "#".join(self.columns), self.calls[method])

    # life cycle

    def name_outputs(self, taken: list[str]) -> None:
        """Output names: the prefix, or prefix.suffix; '#' is added until none is taken."""
        prefix = self.get_prefix()
        names = lambda p: [s if p is None else p if s is None else f"{p}.{s}" for s in self.output_properties]
        others, made = set(taken) - set(self.columns), names(prefix)
        while others & set(made) and prefix is not None:
            warnings.warn(f"{self.get_name()}: {sorted(others & set(made))} are taken, so '#' is added to the names of its outputs", stacklevel=2)
            prefix += "#"
            made = names(prefix)
        self.output_columns = made

    def get_prefix(self) -> str | None:
        return "#".join(self.columns)

    def prepare(self, df: DataFrame, columns: str | list[str], row_key=None) -> None:
        self.columns, self.fitted = [columns] if isinstance(columns, str) else list(columns), False
        if missing := [c for c in self.columns if c not in df.columns]:
            raise KeyError(f"columns {missing} are not in the data")
        self.kinds = {c: kind_of(df, c) for c in self.columns}
        nested = [c for c, k in self.kinds.items() if isinstance(k, (T.ArrayType, T.MapType, T.StructType))]
        if nested and not (self.TAKES_NESTED or self.IS_GENERATOR):
            raise TransformerInputError(f"columns {nested} are of nested types, which {self.get_name()} can't take")
        self.row_key = row_key

    def fit(self, data: DataFrame, column: str | list[str], row_key: str | list[str] | None = None) -> None:
        from tessella.plans.fusion import fit_together

        self.prepare(data, column, row_key)
        fit_together(with_key(data, row_key), [self])
        self.name_outputs(data.columns)

    def inputs(self) -> dict[str, Column]:
        return {c: column(c) for c in self.columns}

    def require_fitted(self) -> None:
        if not self.fitted:
            raise NotFittedError(f"the {self.get_name()} is not fitted")

    def transform(self, data: DataFrame, validate: bool = False, watch: Watch | None = None) -> DataFrame:
        """Replace the input columns by the outputs; data without them stay as they are.

        ``validate`` looks for values that the fit has not seen, and warns: a job of its own.
        ``watch`` notes them in the result's own job.
        """
        if any(c not in data.columns for c in self.columns):
            return data
        self.require_fitted()
        if validate:
            self.validate(data)
        df = with_key(data, self.row_key)
        df, made = self.forward(df, self.inputs(), self.draws("transform"))
        self.calls["transform"] += 1
        if watch is not None and UNSEEN in made:
            df = watch.over(df, {self.columns[0]: (column(self.columns[0]), made[UNSEEN])})
        outputs = [made[s].alias(n) for n, s in self.outputs_by_name().items()]
        return df.select(*[column(c) for c in data.columns if c not in self.columns], *outputs)

    def fit_transform(self, data: DataFrame, column: str | list[str], row_key: str | list[str] | None = None) -> DataFrame:
        self.fit(data, column, row_key)
        return self.transform(data)

    def reverse_transform(self, data: DataFrame) -> DataFrame:
        """Replace the output columns by the inputs; data without them stay as they are."""
        if any(c not in data.columns for c in self.output_columns):
            return data
        self.require_fitted()
        df = with_key(data, self.row_key)
        df, made = self.inverse(df, {s: column(n) for n, s in self.outputs_by_name().items()}, self.draws("reverse_transform"))
        self.calls["reverse_transform"] += 1
        return df.select(*[column(c) for c in data.columns if c not in self.output_columns], *[made[c].alias(c) for c in self.columns])

    def copy(self) -> BaseTransformer:
        return copy.deepcopy(self)


class BaseMultiColumnTransformer(BaseTransformer):
    """Several columns in, named outputs."""

    def __init__(self):
        super().__init__()
        self.columns_to_sdtypes: dict[str, str] = {}

    def get_input_column(self) -> str:
        raise NotImplementedError("a multi-column transformer has several inputs: see get_input_columns")

    def get_prefix(self) -> str | None:
        return None

    def validate_sdtypes(self, columns_to_sdtypes: dict[str, str]) -> None:
        """Raise TransformerInputError for columns that the operator can't take."""

    def fit(self, data: DataFrame, columns_to_sdtypes: dict[str, str], row_key=None) -> None:
        if not isinstance(columns_to_sdtypes, dict) or not columns_to_sdtypes:
            raise TransformerInputError("columns_to_sdtypes must be a dictionary of columns and sdtypes")
        self.validate_sdtypes(columns_to_sdtypes)
        self.columns_to_sdtypes = dict(columns_to_sdtypes)
        super().fit(data, list(columns_to_sdtypes), row_key)


class ColumnFunctions(BaseTransformer):
    """A user's operator from two functions of a Column (or, with ``pandas_type``, of a pandas Series)."""

    INPUT_SDTYPE = "numerical"
    SUPPORTED_SDTYPES = ["numerical", "categorical", "boolean", "datetime", "id", "pii", "text"]
    TAKES_NESTED = True

    def __init__(self, forward_function, inverse_function, pandas_type: str | None = None):
        super().__init__()
        self.forward_function, self.inverse_function, self.pandas_type = forward_function, inverse_function, pandas_type

    def _made(self, function, x: Column, kind: str) -> Column:
        return F.pandas_udf(function, kind)(x) if self.pandas_type else function(x)

    def forward(self, df, x, draws):
        return df, {next(iter(self.output_properties)): self._made(self.forward_function, x[self.columns[0]], self.pandas_type)}

    def inverse(self, df, y, draws):
        kind = self.kinds[self.columns[0]]
        return df, {self.columns[0]: self._made(self.inverse_function, y[next(iter(self.output_properties))], kind.simpleString()).cast(kind)}
