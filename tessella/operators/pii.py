"""Personal data: dropped and made anew, or replaced by pseudonyms."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import TransformerInputError, TransformerProcessingError
from tessella.functions.lookup import LITERALS, Dictionary
from tessella.functions.numeric import staged
from tessella.functions.permutation import MOST, Permutation
from tessella.functions.rng import Draws, uniform
from tessella.functions.sketches import distinct_found, distinct_requests
from tessella.functions.tables import by_ranges, cut, running_over
from tessella.operators.base import BaseTransformer
from tessella.operators.categorical import LabelEncoder
from tessella.operators.ids import Generator, check_distinct, check_rule, value_counts
from tessella.sources.providers import CATALOGUE, LETTERS, SDTYPE_ANONYMIZERS, Digits, get_provider_name, space_size

#: Letters of a value beyond those of a function.
WORD = 6


class AnonymizedFaker(Generator):
    """Fake values of a provider's function, with as many nulls as the fit saw.

    Without a rule, values are drawn by a row's number. With one, a value has a number:
    'unique' has one for each row of all calls, 'match' as many as the fit saw values,
    'scale' repeats them as the fit saw values repeated (``distinct='sketch'`` counts values for 'match'
    by a sketch, without a grouping). A keyed permutation makes a rank of
    the number, and the rank's digits choose the value's parts, so different numbers have
    different values, over calls too. Numbers beyond the function's values are words of
    letters, with a warning.
    """

    INPUT_SDTYPE = "pii"
    RULES = (None, "unique", "match", "scale")

    def __init__(self, provider_name: str | None = None, function_name: str | None = None, function_kwargs: dict | None = None, locales: list[str] | None = None, cardinality_rule: str | None = None, enforce_uniqueness: bool | None = None, missing_value_generation: str | None = "random", distinct: str = "exact"):
        super().__init__()
        self.cardinality_rule = check_rule(cardinality_rule, enforce_uniqueness, self.RULES)
        self.distinct = check_distinct(distinct)
        if missing_value_generation not in (None, "random"):
            raise TransformerInputError(f"missing_value_generation can't be {missing_value_generation!r}: use 'random' or None")
        self.provider_name = provider_name or (get_provider_name(function_name) if function_name else "BaseProvider")
        if function_name is None and provider_name not in (None, "BaseProvider"):
            raise TransformerInputError("a provider needs a function_name")
        self.function_name = function_name or "lexify"
        self.function_kwargs, self.locales, self.missing_value_generation = function_kwargs or {}, locales, missing_value_generation
        self.check_provider_function(self.provider_name, self.function_name)
        self.null_share, self.n_distinct, self.repetitions = 0.0, 0, []

    @staticmethod
    def check_provider_function(provider_name: str | None, function_name: str) -> None:
        if function_name not in CATALOGUE.get(provider_name or "", {}):
            raise TransformerProcessingError(f"there is no function {function_name!r} of a provider {provider_name!r}")

    @classmethod
    def get_supported_sdtypes(cls) -> list:
        """All sdtypes but those of statistics."""
        known = {s for sub in BaseTransformer.get_subclasses() if sub is not cls and sub.__dict__.get("SUPPORTED_SDTYPES") for s in sub.SUPPORTED_SDTYPES}
        return sorted((known | {"pii"}) - {"numerical", "datetime", "categorical", "boolean"})

    def requests(self, x, kinds):
        v = x[self.columns[0]]
        counts = {"n": F.count(F.lit(1)), "nulls": F.count_if(v.isNull())}
        return counts | distinct_requests(v, kinds[self.columns[0]], False) if self.sketched() else counts

    def bind(self, stats, values):
        self.output_properties = {}
        self.null_share = stats["nulls"] / stats["n"] if stats["n"] else 0.0
        if self.sketched():
            self.n_distinct = distinct_found(stats)

    def fit(self, data, column, row_key=None):
        super().fit(data, column, row_key)
        self.second_pass(data)

    def second_pass(self, data: DataFrame) -> None:
        """Distinct values, and how many are repeated how often: a row for each count of repetitions."""
        if self.cardinality_rule not in ("match", "scale") or self.sketched():
            return
        filled = data.where(F.col(f"`{self.columns[0]}`").isNotNull())
        histogram = value_counts(filled, F.col(f"`{self.columns[0]}`")).groupBy("n").agg(F.count(F.lit(1)).alias("values"))
        self.repetitions = [(r.n, r["values"]) for r in histogram.orderBy("n").collect()]
        self.n_distinct = sum(v for _, v in self.repetitions)

    def _set_fitted_parameters(self, column_name: str, nan_frequency: float = 0.0, cardinality: int | None = None, dtype: T.DataType | None = None) -> None:
        """Fit without data."""
        if self.cardinality_rule == "match" and cardinality is None:
            raise TransformerInputError("the rule 'match' needs a cardinality")
        self.columns, self.kinds, self.fitted = [column_name], {column_name: dtype or T.StringType()}, True
        self.null_share, self.n_distinct = nan_frequency, cardinality or 0
        self.name_outputs([])

    def value(self, key, salt: str):
        return CATALOGUE[self.provider_name][self.function_name](lambda part: uniform(key, f"{salt}|{part}"), **self.function_kwargs)

    def generated(self, df, number, draws: Draws, n: int):
        at, salt = number + F.lit(self.made), draws.salt("fake")
        if self.cardinality_rule is None:
            made = self.value(at.cast("string"), salt)
        else:
            most = self.made + n
            if self.cardinality_rule == "match":
                most = max(1, self.n_distinct)
                at = number % F.lit(most)
            elif self.cardinality_rule == "scale" and self.repetitions:
                df, at = self.repeats.dealt(df, n, self.repetitions, f"{draws.seed}|{draws.field}|repeat")
            df, made = self._ranked(df, at, f"{draws.seed}|{draws.field}|fake", most)
        if self.missing_value_generation and self.null_share and n:
            # as many nulls as the share says, at the rows that a permutation puts first
            df, place = Permutation(n, draws.salt("null")).column(df, number)
            made = F.when(place >= int(self.null_share * n), made)
        return df, made.cast("string") if isinstance(self.kinds[self.columns[0]], T.StringType) else made

    def _ranked(self, df, at, key: str, most: int):
        """A value for each number below ``most``, and none for two."""
        maker = CATALOGUE[self.provider_name][self.function_name]
        size = space_size(maker, self.function_kwargs)
        df, at = staged(df, at)
        df, rank = Permutation(size, key).column(df, at % F.lit(size))
        df, rank = staged(df, rank)
        made = maker(Digits(rank), **self.function_kwargs)
        if most <= size:
            return df, made
        warnings.warn(f"column '{self.columns[0]}' needs more than the {size} values of {self.function_name!r}: further ones are random letters", stacklevel=2)
        letters = max(WORD, len(str(self.function_kwargs.get("text", ""))) + 1)  # longer than a template of letters
        space = min(len(LETTERS) ** letters, MOST)
        df, rank = Permutation(space, f"{key}|more").column(df, (at - F.lit(size)) % F.lit(space))
        df, rank = staged(df, rank)
        word = CATALOGUE["BaseProvider"]["lexify"](Digits(rank), text="?" * letters)
        again = F.call_function("div", at - F.lit(size), F.lit(space))
        word = F.when(again > 0, F.concat(word, again.cast("string"))).otherwise(word)
        return df, F.when(at < size, made.cast("string")).otherwise(word)


class PseudoAnonymizedFaker(AnonymizedFaker):
    """Each value becomes a fake one of its own; reverse gives the fake values, not the originals."""

    IS_GENERATOR = False

    def __init__(self, provider_name: str | None = None, function_name: str | None = None, function_kwargs: dict | None = None, locales: list[str] | None = None):
        super().__init__(provider_name, function_name, function_kwargs, locales, "unique")
        self.dictionary: Dictionary | None = None
        self.bind_properties()

    def bind_properties(self) -> None:
        self.output_properties = {None: {"sdtype": "categorical", "next_transformer": LabelEncoder(add_noise=True)}}

    def requests(self, x, kinds):
        return {}

    def bind(self, stats, values):
        self.bind_properties()

    def second_pass(self, data: DataFrame) -> None:
        """Distinct values are numbered by a random order of their hashes; a number's value is a pseudonym."""
        name, kind = self.columns[0], self.kinds[self.columns[0]]
        values = data.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("value")).distinct()
        salt = f"{self.seeds['fit']}|{name}|pseudonym"
        order = [F.col("_h"), F.col("value")]
        dealt = by_ranges(values.withColumn("_h", F.md5(F.concat(F.lit(f"{salt}|"), F.col("value").cast("string")))), order, F.lit(0))
        ordered, size = running_over(dealt, order), dealt.count()
        named, made = self._ranked(ordered.select("value", "_number"), F.col("_number"), salt, size)
        table = cut(named.select("value", made.cast("string").alias("pseudonym")))
        rows = [r.asDict() for r in table.collect()] if size <= LITERALS else None
        self.dictionary = Dictionary({"value": kind, "pseudonym": T.StringType()}, rows=rows, table=None if rows is not None else table, size=size)

    def get_mapping(self) -> dict:
        """The mapping, if it is small enough for the driver."""
        if self.dictionary.rows is None:
            raise TransformerProcessingError(f"the mapping has {self.dictionary.size} rows: use mapping_table")
        return {r["value"]: r["pseudonym"] for r in self.dictionary.rows}

    def mapping_table(self, df: DataFrame) -> DataFrame:
        return self.dictionary.as_table(df)

    def forward(self, df, x, draws):
        v = x[self.columns[0]]
        df, at = self.dictionary.lookup(df, v, "value", ["pseudonym"])
        problem = F.raise_error(F.lit(f"column '{self.columns[0]}' has values that the fit has not seen")).cast("string")
        return df, {None: F.when(v.isNotNull() & at["pseudonym"].isNull(), problem).otherwise(at["pseudonym"])}

    def inverse(self, df, y, draws):
        return df, {self.columns[0]: y[None]}


def get_anonymized_transformer(function_name: str, transformer_kwargs: dict | None = None) -> AnonymizedFaker:
    """The operator for an sdtype or a provider's function."""
    found = SDTYPE_ANONYMIZERS.get(function_name)
    if found is None:
        if get_provider_name(function_name) is None:
            raise TransformerProcessingError(f"neither an sdtype nor a provider's function: {function_name!r}")
        found = {"provider_name": get_provider_name(function_name), "function_name": function_name}
    return AnonymizedFaker(**(found | (transformer_kwargs or {})))
