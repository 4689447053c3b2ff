"""Categories: as intervals, labels or indicators.

The order of categories without an ``order_by`` is that of their first rows by the row
key, or else (rows have no order of their own) by count and then value.
"""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import TransformerInputError
from tessella.functions import numeric as N
from tessella.functions.lookup import LITERALS, Dictionary
from tessella.functions.tables import cut, running
from tessella.operators.base import UNSEEN, BaseTransformer

#: Width of a frequency's noise: a sixth of its interval.
NOISE = 6.0
#: Share that ordered categories without rows get together.
UNSEEN_SHARE = 0.1


def _check_encoding(value: str | None) -> None:
    if value not in (None, "new_category"):
        raise ValueError(f"missing_value_encoding can't be {value!r}: use 'new_category' or None")


class _Categories(BaseTransformer):
    """What encoders by a dictionary share: its order, unseen values and missing ones."""

    INPUT_SDTYPE = "categorical"
    SUPPORTED_SDTYPES = ["categorical", "boolean"]
    wants_values = True

    def __init__(self, order_by: str | None = None, missing_value_encoding: str | None = "new_category"):
        super().__init__()
        if order_by not in (None, "alphabetical", "numerical_value"):
            raise TransformerInputError(f"order_by can't be {order_by!r}: use 'numerical_value', 'alphabetical' or None")
        _check_encoding(missing_value_encoding)
        self.order_by, self.missing_value_encoding = order_by, missing_value_encoding
        self.dictionary: Dictionary | None = None

    @property
    def name(self) -> str:
        return self.columns[0]

    def kept(self, values: Dictionary) -> Dictionary:
        """Without the missing value, unless it is a category."""
        if self.missing_value_encoding == "new_category":
            return values
        if values.rows is not None:
            rows = [r for r in values.rows if r["value"] is not None]
            return Dictionary(values.kinds, rows=rows, size=len(rows))
        return Dictionary(values.kinds, table=values.table.where("value IS NOT NULL"), size=values.size)

    def sorted_rows(self, rows: list[dict]) -> list[dict]:
        missing = [r for r in rows if r["value"] is None]
        filled = [r for r in rows if r["value"] is not None]
        if self.order_by:
            if self.order_by == "numerical_value" and any(isinstance(r["value"], (str, bytes)) for r in filled):
                try:
                    filled.sort(key=lambda r: float(r["value"]))
                except ValueError:
                    raise TransformerInputError("order_by 'numerical_value' needs numbers") from None
                return filled + missing
            return sorted(filled, key=lambda r: str(r["value"]) if self.order_by == "alphabetical" and not isinstance(r["value"], str) else r["value"]) + missing
        if rows and rows[0].get("first") is not None:
            return sorted(rows, key=lambda r: _key_order(r["first"]))
        return sorted(filled, key=lambda r: (-r["n"], r["value"])) if not missing else sorted(rows, key=lambda r: (-r["n"], r["value"] is None, _plain(r["value"])))

    def table_order(self) -> list[Column]:
        if self.order_by == "numerical_value":
            return [F.col("value").try_cast("double").asc_nulls_last(), F.col("value")]
        if self.order_by:
            return [F.col("value").asc_nulls_last()]
        if self.row_key:
            return [F.col("first").try_cast("decimal(38,0)").asc_nulls_last(), F.length("first"), F.col("first"), F.col("value")]
        return [F.desc("n"), F.col("value").asc_nulls_last()]

    def numbered(self, values: Dictionary) -> Dictionary:
        """Add label (from 0), lo and hi (the interval by frequency; the last one ends at 1)."""
        kinds = {"value": values.kinds["value"], "n": T.LongType(), "label": T.LongType(), "lo": T.DoubleType(), "hi": T.DoubleType()}
        if values.rows is not None:
            rows = self.sorted_rows(values.rows)
            total, before, out = sum(r["n"] for r in rows), 0, []
            for k, r in enumerate(rows):
                out.append({"value": r["value"], "n": r["n"], "label": k, "lo": before / total, "hi": (before + r["n"]) / total})
                before += r["n"]
            return Dictionary(kinds, rows=out, size=len(out))
        total = values.table.agg(F.sum("n")).first()[0]
        table = running(values.table, self.table_order(), F.col("n"))
        table = table.select("value", "n", F.col("_number").cast("long").alias("label"), (F.col("_before") / total).alias("lo"), ((F.col("_before") + F.col("n")) / total).alias("hi"))
        table = cut(table)
        return Dictionary(kinds, table=table, size=table.count())

    def bind(self, stats, values):
        self.dictionary = self.numbered(self.kept(values))

    def passes(self, x: Column) -> Column:
        """Whether a value is left missing."""
        return x.isNull() if self.missing_value_encoding is None else F.lit(False)

    def listed(self) -> list[dict]:
        """The dictionary's rows, if they are few enough for the driver."""
        if self.dictionary.rows is None:
            raise TransformerInputError(f"column '{self.name}' has {self.dictionary.size} categories, too many for a Python dictionary: use mapping_table")
        return self.dictionary.rows

    def mapping_table(self, df) -> DataFrame:
        """The categories with their labels and intervals, however many they are."""
        return self.dictionary.as_table(df)

    def validate(self, data) -> None:
        """Warn of values that the fit has not seen (a job of its own)."""
        self.warn_of_unseen(data)

    def random_known(self, draws, purpose: str = "unseen") -> Column:
        """A label drawn evenly."""
        return F.floor(draws.uniform(purpose) * F.lit(float(max(1, self.dictionary.size)))).cast("long")

    def unseen_values(self, data, most: int = 3) -> list:
        """Up to ``most`` values of the data that the fit has not seen (a job of its own)."""
        x = F.col(f"`{self.name}`")
        known = self.dictionary.as_table(data).select(F.col("value").alias("_known"))
        new = data.select(x.alias("v")).distinct().join(known, F.col("v").eqNullSafe(F.col("_known")), "left_anti")
        return [r.v for r in (new.where("v IS NOT NULL") if self.missing_value_encoding is None else new).limit(most).collect()]

    def warn_of_unseen(self, data) -> None:
        if found := self.unseen_values(data):
            warnings.warn(f"column '{self.name}' has values that the fit has not seen, such as {found}: they get random categories", stacklevel=2)


def _key_order(key: str) -> tuple:
    """Keys that are whole numbers are in the order of numbers, others by length and text."""
    digits = key.removeprefix("-")
    return (0, int(key), "") if digits.isascii() and digits.isdigit() else (1, len(key), key)


def _plain(value: Any) -> Any:
    return 0 if value is None else value


class UniformEncoder(_Categories):
    """A number drawn evenly from the category's interval, whose length is its frequency."""

    def __init__(self, order_by: str | None = None, missing_value_encoding: str | None = "new_category"):
        super().__init__(order_by, missing_value_encoding)

    @property
    def intervals(self) -> dict:
        return {r["value"]: [r["lo"], r["hi"]] for r in self.listed()}

    @property
    def frequencies(self) -> dict:
        return {r["value"]: r["hi"] - r["lo"] for r in self.listed()}

    def _set_fitted_parameters(self, column_name: str, intervals: dict, dtype: T.DataType | None = None) -> None:
        """Fit without data."""
        kind = dtype or T.StringType()
        rows = [{"value": v, "n": 0, "label": k, "lo": float(a), "hi": float(b)} for k, (v, (a, b)) in enumerate(intervals.items())]
        self.columns, self.kinds, self.fitted = [column_name], {column_name: kind}, True
        self.dictionary = Dictionary({"value": kind, "n": T.LongType(), "label": T.LongType(), "lo": T.DoubleType(), "hi": T.DoubleType()}, rows=rows, size=len(rows))
        self.name_outputs([])

    def forward(self, df, x, draws):
        v = x[self.name]
        df, at = self.dictionary.lookup(df, v, "value", ["lo", "hi"])
        u = draws.uniform("place")
        df, spare = self.dictionary.lookup(df, self.random_known(draws), "label", ["lo", "hi"])
        known = F.when(at["lo"].isNotNull(), at["lo"] + (at["hi"] - at["lo"]) * u)
        return df, {None: F.when(~self.passes(v), F.coalesce(known, spare["lo"] + (spare["hi"] - spare["lo"]) * u)), UNSEEN: at["lo"].isNull() & ~self.passes(v)}

    def inverse(self, df, y, draws):
        df, value = self.dictionary.interval(df, N.clip(y[None].cast("double"), 0.0, 1.0), "value")
        return df, {self.name: value}


class _Ordered:
    """A given order of categories; a value of the data outside it is an error."""

    def check_order(self, order: list) -> None:
        names = [str(v) if v is not None else None for v in order]
        if len(set(names)) < len(names):
            raise TransformerInputError("order has repeated categories")
        self.order = list(order)

    def in_order(self, values: Dictionary) -> Dictionary:
        """The ordered categories with the counts that the data have of them."""
        kind = values.kinds["value"]
        order = self.order if self.missing_value_encoding == "new_category" else [v for v in self.order if v is not None]
        # an order of mixed types meets a column of one type by the values' text
        own = {str(r["value"]) if r["value"] is not None else None: r for r in self.met(values, order)}
        named = {str(v) if v is not None else None: v for v in order}
        if unknown := [r["value"] for k, r in own.items() if k not in named]:
            raise TransformerInputError(f"column '{self.name}' has categories that its order lacks, such as {unknown[:5]}")
        rows = [{"value": None if k is None else own[k]["value"] if k in own else (k if isinstance(kind, T.StringType) else v), "n": own[k]["n"] if k in own else 0, "first": None} for k, v in named.items()]
        return Dictionary(values.kinds, rows=rows, size=len(rows))

    def met(self, values: Dictionary, order: list) -> list[dict]:
        """The data's categories; if they are more than the order has, one more than it has, of which it lacks one."""
        found = self.kept(values)
        return found.rows if found.rows is not None else [r.asDict() for r in found.table.limit(len(order) + 1).collect()]

    def stored(self, rows: list[dict]) -> Dictionary:
        """The dictionary; a table if its rows are too many for a plan."""
        kind = self.kinds[self.name]
        kinds = {"value": kind, "n": T.LongType(), "label": T.LongType(), "lo": T.DoubleType(), "hi": T.DoubleType()}
        if len(rows) <= LITERALS:
            return Dictionary(kinds, rows=rows, size=len(rows))
        # the order's own values may be of another type
        text = kind if isinstance(kind, T.BinaryType) else T.StringType()
        told = [r | {"value": r["value"] if r["value"] is None or text is kind else str(r["value"])} for r in rows]
        table = Dictionary(kinds | {"value": text}, rows=told).as_table(SparkSession.active().range(0))
        return Dictionary(kinds, table=cut(table.withColumn("value", F.col("value").cast(kind))), size=len(rows))

    def sorted_rows(self, rows):
        return rows


class OrderedUniformEncoder(_Ordered, UniformEncoder):
    """:class:`UniformEncoder` with a given order; categories without rows share UNSEEN_SHARE."""

    def __init__(self, order: list, missing_value_encoding: str | None = "new_category"):
        UniformEncoder.__init__(self, None, missing_value_encoding)
        self.check_order(order)

    def bind(self, stats, values):
        ordered = self.in_order(values)
        self.dictionary = self.numbered(ordered) if any(r["n"] for r in ordered.rows) else None
        total, unseen = sum(r["n"] for r in ordered.rows), sum(not r["n"] for r in ordered.rows)
        before, out = 0.0, []
        for k, r in enumerate(ordered.rows):
            share = r["n"] / total * (1 - UNSEEN_SHARE if unseen else 1) if r["n"] else (UNSEEN_SHARE if total else 1.0) / unseen
            out.append({"value": r["value"], "n": r["n"], "label": k, "lo": before, "hi": before + share})
            before += share
        if out:
            out[-1]["hi"] = 1.0
        self.dictionary = self.stored(out)


class FrequencyEncoder(_Categories):
    """The middle of the category's interval, the most frequent first; with noise a normal draw around it."""

    def __init__(self, add_noise: bool = False):
        super().__init__(None, "new_category")
        warnings.warn("FrequencyEncoder is deprecated: use UniformEncoder", FutureWarning, stacklevel=2)
        self.add_noise = add_noise

    def sorted_rows(self, rows):
        return sorted(rows, key=lambda r: (-r["n"], *(_key_order(r["first"]) if r.get("first") is not None else (r["value"] is None, _plain(r["value"])))))

    def table_order(self):
        return [F.desc("n"), F.col("first").try_cast("decimal(38,0)").asc_nulls_last(), F.length("first"), F.col("first"), F.col("value").asc_nulls_last()]

    def forward(self, df, x, draws):
        df, at = self.dictionary.lookup(df, x[self.name], "value", ["lo", "hi"])
        df, spare = self.dictionary.lookup(df, self.random_known(draws), "label", ["lo", "hi"])
        lo, hi = F.coalesce(at["lo"], spare["lo"]), F.coalesce(at["hi"], spare["hi"])
        middle = lo + (hi - lo) / 2
        if self.add_noise:
            u = N.clip(draws.uniform("noise"), 2.0**-53, 1 - 2.0**-53)
            df, u = N.staged(df, u)
            noisy = middle + N.normal_ppf(u) * (hi - lo) / F.lit(NOISE)
            middle = F.greatest(F.least(noisy, hi - F.lit(1e-9)), lo)
        return df, {None: middle, UNSEEN: at["lo"].isNull()}

    def inverse(self, df, y, draws):
        df, value = self.dictionary.interval(df, N.clip(y[None].cast("double"), 0.0, 1.0), "value", closed="left")
        return df, {self.name: value}


class LabelEncoder(_Categories):
    """The category's number; with noise a draw between it and the next."""

    def __init__(self, add_noise: bool = False, order_by: str | None = None, missing_value_encoding: str | None = "new_category"):
        super().__init__(order_by, missing_value_encoding)
        self.add_noise = add_noise

    @property
    def values_to_categories(self) -> dict:
        return {r["label"]: r["value"] for r in self.listed()}

    @property
    def categories_to_values(self) -> dict:
        return {r["value"]: r["label"] for r in self.listed()}

    def forward(self, df, x, draws):
        v = x[self.name]
        df, at = self.dictionary.lookup(df, v, "value", ["label"])
        label = F.when(~self.passes(v), F.coalesce(at["label"], self.random_known(draws)))
        return df, {None: label.cast("double") + draws.uniform("noise") if self.add_noise else label, UNSEEN: at["label"].isNull() & ~self.passes(v)}

    def inverse(self, df, y, draws):
        v = y[None].cast("double")
        v = N.clip(F.floor(v).cast("double") if self.add_noise else v, 0.0, float(max(0, self.dictionary.size - 1)))
        label = N.round_half_even(v).cast("long")
        df, at = self.dictionary.lookup(df, label, "label", ["value"])
        return df, {self.name: F.when(label.isNotNull(), at["value"])}


class OrderedLabelEncoder(_Ordered, LabelEncoder):
    """:class:`LabelEncoder` with a given order."""

    def __init__(self, order: list, add_noise: bool = False, missing_value_encoding: str | None = "new_category"):
        LabelEncoder.__init__(self, add_noise, None, missing_value_encoding)
        self.check_order(order)

    def bind(self, stats, values):
        ordered = self.in_order(values)
        self.dictionary = self.stored([{"value": r["value"], "n": r["n"], "label": k, "lo": 0.0, "hi": 0.0} for k, r in enumerate(ordered.rows)])


class CustomLabelEncoder(OrderedLabelEncoder):
    """The old name of :class:`OrderedLabelEncoder`."""

    def __init__(self, order: list, add_noise: bool = False):
        warnings.warn("CustomLabelEncoder is deprecated: use OrderedLabelEncoder", FutureWarning, stacklevel=2)
        super().__init__(order, add_noise)


class OneHotEncoder(_Categories):
    """An indicator for each category, and one for missing values if there are any.

    With ``sparse`` there is one output column, a struct of size, indices (from 0) and values, as sparse
    vectors have, so a column may have any number of categories. A value that the fit has not seen has no
    index. On the way back the largest of the vector's numbers tells the category, the first one
    among equals; numbers that are not listed are 0, null and NaN count as 0, indices beyond the size are left out.
    """

    #: Categories, which are columns of the output, at most; a plan of more columns is the caller's choice.
    MOST = 1000

    def __init__(self, most_columns: int = MOST, sparse: bool = False):
        super().__init__(None, "new_category")
        self.most_columns, self.sparse = most_columns, sparse

    def table_order(self):
        return [F.col("value").isNull(), *super().table_order()]

    def bind(self, stats, values):
        if self.sparse:
            self.dictionary = self.numbered(values)
            self.output_properties = {None: {"sdtype": "vector", "next_transformer": None}}
            return
        if values.size > self.most_columns:
            raise TransformerInputError(f"column '{self.name}' has {values.size} categories, more than {self.most_columns} columns: see most_columns, or sparse=True")
        rows = self.sorted_rows(values.rows if values.rows is not None else [r.asDict() for r in values.table.collect()])
        self.dictionary = Dictionary({"value": values.kinds["value"], "label": T.LongType()}, rows=[{"value": r["value"], "label": k} for k, r in enumerate(rows)], size=len(rows))
        self.output_properties = {f"value{k}": {"sdtype": "float", "next_transformer": None} for k in range(len(rows))}

    def sorted_rows(self, rows):
        return sorted(super().sorted_rows(rows), key=lambda r: r["value"] is None)

    @property
    def dummies(self) -> list:
        return [r["value"] for r in self.listed()]

    def forward(self, df, x, draws):
        kind, v = self.kinds[self.name], x[self.name]
        if self.sparse:
            df, at = self.dictionary.lookup(df, v, "value", ["label"])
            found = F.array_compact(F.array(at["label"].cast("int")))
            vector = F.struct(F.lit(self.dictionary.size).alias("size"), found.alias("indices"), F.transform(found, lambda _: F.lit(1.0)).alias("values"))
            return df, {None: vector, UNSEEN: at["label"].isNull()}
        filled = [F.lit(r["value"]).cast(kind) for r in self.dictionary.rows if r["value"] is not None]
        known = F.when(v.isNull(), F.lit(len(filled) < len(self.dictionary.rows))).otherwise(v.isin(*filled) if filled else F.lit(False))
        return df, {f"value{r['label']}": v.eqNullSafe(F.lit(r["value"]).cast(kind)).cast("int") for r in self.dictionary.rows} | {UNSEEN: ~known}

    def _largest(self, vector: Column) -> Column:
        """The first place of a sparse vector's largest number; null for a null vector."""
        listed = F.arrays_zip(vector["indices"].alias("i"), vector["values"].cast("array<double>").alias("v"))
        listed = F.filter(listed, lambda e: (e["i"] >= 0) & (e["i"] < self.dictionary.size))
        listed = F.transform(listed, lambda e: F.struct(F.coalesce(F.nanvl(e["v"], F.lit(0.0)), F.lit(0.0)).alias("v"), e["i"].cast("long").alias("i")))
        # one of the first places, as many as are listed and one more, is not listed, if any
        listed_at = F.transform(listed, lambda e: e["i"])
        absent = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(listed).cast("long")), listed_at))
        zero = F.when(absent < self.dictionary.size, F.array(F.struct(F.lit(0.0).alias("v"), absent.alias("i"))))
        every = F.transform(F.concat(listed, F.coalesce(zero, F.filter(listed, lambda _: F.lit(False)))), lambda e: F.struct((-e["v"]).alias("v"), e["i"].alias("i")))
        return F.when(vector.isNotNull(), F.array_min(every)["i"])

    def inverse(self, df, y, draws):
        if not self.dictionary.size:
            return df, {self.name: F.lit(None).cast(self.kinds[self.name])}
        if self.sparse:
            df, at = self.dictionary.lookup(df, self._largest(y[None]), "label", ["value"])
            return df, {self.name: at["value"]}
        scores = F.array(*[y[f"value{r['label']}"].cast("double") for r in self.dictionary.rows])
        first = F.array_position(scores, F.array_max(scores)) - 1
        df, at = self.dictionary.lookup(df, first, "label", ["value"])
        return df, {self.name: at["value"]}
