"""Whole tables: a config of sdtypes and operators, fitted level by level, applied as one projection."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import ConfigNotSetError, InvalidConfigError, InvalidDataError, NotFittedError
from tessella.functions.watch import Watch
from tessella.operators.base import FILE_ROWS, KEY, UNSEEN, BaseMultiColumnTransformer, BaseTransformer, column, with_key
from tessella.operators.ids import Generator
from tessella.plans import registry, store
from tessella.plans.fusion import fit_together

Field = str | tuple[str, ...]


class Config(dict):
    """sdtypes by column, and operators by column or tuple of columns; prints as JSON."""

    def __repr__(self) -> str:
        shown = {"sdtypes": self["sdtypes"], "transformers": {str(k): repr(v) for k, v in self["transformers"].items()}}
        return json.dumps(shown, indent=4)


def _members(field: Field) -> tuple[str, ...]:
    return field if isinstance(field, tuple) else (field,)


class HyperTransformer:
    """Transform and reverse all columns of a table.

    ``row_key`` names columns that identify a row: with them random numbers are the same
    on any partitioning, and categories are ordered by their first rows. For Parquet files
    FILE_ROWS is such a key, without a column of its own.
    """

    def __init__(self, row_key: str | list[str] | None = None):
        self.row_key = row_key
        self.field_sdtypes: dict[str, str] = {}
        self.field_transformers: dict[Field, BaseTransformer | None] = {}
        self._reset()
        self._modified = False

    def _reset(self) -> None:
        self._fitted = False
        self._levels: list[list[BaseTransformer]] = []
        self._output_columns: list[str] = []
        self._input_columns: list[str] = []

    # config

    def detect_initial_config(self, data: DataFrame) -> None:
        """Sdtypes from the schema, and their default operators; no data are read."""
        self._reset()
        self._modified = False
        self.field_sdtypes = {f.name: registry.sdtype_of(f.dataType) for f in data.schema.fields}
        self.field_transformers = {c: registry.get_default_transformer(s) for c, s in self.field_sdtypes.items()}

    def get_config(self) -> Config:
        return Config(sdtypes=self.field_sdtypes, transformers=self.field_transformers)

    def set_config(self, config: dict[str, dict]) -> None:
        self._check_config(config)
        if self.field_transformers:
            warnings.warn("the config is replaced: fit again before transforming", stacklevel=2)
        self.field_sdtypes.update(config["sdtypes"])
        members = {m for f in config["transformers"] for m in _members(f)}
        kept = {f: t for f, t in self.field_transformers.items() if not members & set(_members(f))}
        self.field_transformers = kept | dict(config["transformers"])
        self._modified = True

    def _check_config(self, config: Any) -> None:
        if not isinstance(config, dict) or set(config) != {"sdtypes", "transformers"}:
            raise InvalidConfigError("a config has the keys 'sdtypes' and 'transformers'")
        named = [m for f in config["transformers"] for m in _members(f)]
        if len(set(named)) < len(named):
            raise InvalidConfigError(f"columns with two operators: {sorted({n for n in named if named.count(n) > 1})}")
        if set(named) != set(config["sdtypes"]):
            raise InvalidConfigError(f"columns with an sdtype or an operator only: {sorted(set(named) ^ set(config['sdtypes']))}")
        self._check_sdtypes(config["sdtypes"])
        self._check_operators(config["transformers"])
        for f, t in config["transformers"].items():
            self._check_fit(f, t, config["sdtypes"])

    @staticmethod
    def _check_sdtypes(sdtypes: dict[str, str]) -> None:
        known = set(registry.get_transformers_by_type())
        if bad := {c: s for c, s in sdtypes.items() if s not in known}:
            raise InvalidConfigError(f"unknown sdtypes: {bad}; known are {sorted(s for s in known if s)}")

    @staticmethod
    def _check_operators(operators: dict[Field, Any]) -> None:
        if bad := {f: t for f, t in operators.items() if t is not None and not isinstance(t, BaseTransformer)}:
            raise InvalidConfigError(f"not instances of operators: {bad}")
        seen: dict[int, Field] = {}
        for f, t in operators.items():
            if t is not None and id(t) in seen:
                raise InvalidConfigError(f"{seen[id(t)]!r} and {f!r} share one instance of {t.get_name()}: give each its own")
            seen[id(t)] = f

    @staticmethod
    def _check_fit(field: Field, operator: BaseTransformer | None, sdtypes: dict[str, str]) -> None:
        if operator is None:
            return
        if isinstance(operator, BaseMultiColumnTransformer):
            operator.validate_sdtypes({m: sdtypes[m] for m in _members(field)})
            return
        if isinstance(field, tuple):
            raise InvalidConfigError(f"{operator.get_name()} takes one column, not {field}")
        if sdtypes[field] not in operator.get_supported_sdtypes():
            raise InvalidConfigError(f"column {field!r} is {sdtypes[field]}, which {operator.get_name()} can't take")

    def _need_config(self) -> None:
        if not self.field_transformers:
            raise ConfigNotSetError("there is no config: call detect_initial_config or set_config")

    def _field_of(self, name: str) -> Field:
        return next((f for f in self.field_transformers if name in _members(f)), name)

    def _known(self, names) -> None:
        if missing := [n for n in names if n not in self.field_sdtypes]:
            raise InvalidConfigError(f"columns that the config lacks: {missing}")

    def update_sdtypes(self, column_name_to_sdtype: dict[str, str]) -> None:
        self._need_config()
        self._known(column_name_to_sdtype)
        self._check_sdtypes(column_name_to_sdtype)
        changed = []
        for name, sdtype in column_name_to_sdtype.items():
            self.field_sdtypes[name] = sdtype
            field = self._field_of(name)
            operator = self.field_transformers[field]
            if isinstance(field, tuple):
                self._split(field)
                changed.append(name)
            elif operator is not None and sdtype not in operator.get_supported_sdtypes():
                self.field_transformers[name] = registry.get_default_transformer(sdtype)
                changed.append(name)
        if changed:
            warnings.warn(f"operators of {changed} don't suit their sdtypes any more: they are the defaults now", stacklevel=2)
        self._modified = True

    def _split(self, field: tuple[str, ...]) -> None:
        """Give the members of a field operators of their own."""
        out: dict[Field, BaseTransformer | None] = {}
        for f, t in self.field_transformers.items():
            out |= {m: registry.get_default_transformer(self.field_sdtypes[m]) for m in field} if f == field else {f: t}
        self.field_transformers = out

    def update_transformers(self, column_name_to_transformer: dict[Field, BaseTransformer | None]) -> None:
        self._need_config()
        self._known(m for f in column_name_to_transformer for m in _members(f))
        self._check_operators(column_name_to_transformer)
        for field, operator in column_name_to_transformer.items():
            self._check_fit(field, operator, self.field_sdtypes)
            others = [t for f, t in self.field_transformers.items() if f not in column_name_to_transformer]
            if operator is not None and any(t is operator for t in others):
                raise InvalidConfigError(f"{operator.get_name()} for {field!r} is in use for another column: give each its own")
            for m in _members(field):
                own = self._field_of(m)
                if own != field and isinstance(own, tuple):
                    self._split(own)
            if isinstance(field, tuple):
                self.field_transformers = {f: t for f, t in self.field_transformers.items() if f not in field}
            self.field_transformers[field] = operator
        self._modified = True

    def update_transformers_by_sdtype(self, sdtype: str, transformer: BaseTransformer | None = None, transformer_name: str | None = None, transformer_parameters: dict | None = None) -> None:
        self._need_config()
        self._check_sdtypes({"": sdtype})
        if transformer_name is not None:
            cls = registry.get_transformers().get(transformer_name)
            if cls is None:
                raise InvalidConfigError(f"there is no operator {transformer_name!r}")
            transformer = cls(**(transformer_parameters or {}))
        elif transformer is not None:
            warnings.warn("the parameter transformer is deprecated: use transformer_name", FutureWarning, stacklevel=2)
        else:
            raise InvalidConfigError("transformer_name is needed")
        if sdtype not in transformer.get_supported_sdtypes():
            raise InvalidConfigError(f"{transformer.get_name()} can't take the sdtype {sdtype}")
        for name, own in list(self.field_sdtypes.items()):
            if own == sdtype:
                if isinstance(field := self._field_of(name), tuple):
                    self._split(field)
                self.field_transformers[name] = transformer.copy()
        self._modified = True

    def remove_transformers(self, column_names: list[str]) -> None:
        """The columns pass through as they are."""
        self._need_config()
        if unknown := [c for c in column_names if c not in self.field_sdtypes]:
            raise InvalidConfigError(f"columns that the config lacks: {unknown}")
        for c in column_names:
            if isinstance(field := self._field_of(c), tuple):
                self._split(field)
            self.field_transformers[c] = None

    def remove_transformers_by_sdtype(self, sdtype: str) -> None:
        self._need_config()
        self._check_sdtypes({"": sdtype})
        self.remove_transformers([c for c, s in self.field_sdtypes.items() if s == sdtype])

    # fit

    def _check_columns(self, data: DataFrame) -> None:
        self._need_config()
        if set(data.columns) != set(self.field_sdtypes):
            raise InvalidDataError(f"the data and the config differ in the columns {sorted(set(data.columns) ^ set(self.field_sdtypes))}")

    def fit(self, data: DataFrame) -> None:
        """Learn all operators: a scan or two for each level of chained operators."""
        self._fit(data, fit_together)

    def _fit(self, data: DataFrame, learn: Callable[[DataFrame, list[BaseTransformer]], None]) -> None:
        """Learn level by level; ``learn`` fits prepared operators."""
        self._check_columns(data)
        self._reset()
        self._input_columns = list(data.columns)
        fields: list[tuple[Field, BaseTransformer]] = []
        for c in data.columns:
            field = self._field_of(c)
            operator = self.field_transformers[field]
            if operator is not None and all(operator is not t for _, t in fields):
                fields.append((field, operator))
        passing = [c for c in data.columns if self.field_transformers[self._field_of(c)] is None]
        df, taken = with_key(data, self.row_key), list(data.columns)
        final: dict[str, list[str]] = {c: [c] for c in passing}
        level = [(list(_members(f)), t, c) for f, t in fields for c in [_members(f)[0]]]
        while level:
            for columns, operator, _ in level:
                if isinstance(operator, BaseMultiColumnTransformer):
                    operator.columns_to_sdtypes = {c: self.field_sdtypes.get(c, "categorical") for c in columns}
                operator.prepare(df, columns, self.row_key)
            learn(df, [t for _, t, _ in level])
            following = []
            for columns, operator, origin in level:
                if hasattr(operator, "second_pass"):
                    operator.second_pass(df)
                operator.name_outputs(taken)
                taken = [c for c in taken if c not in columns] + operator.get_output_columns()
                for name, after in operator.get_next_transformers().items():
                    if after is None:
                        final.setdefault(origin, []).append(name)
                    else:
                        following.append(([name], after, origin))
                final.setdefault(origin, [])
            self._levels.append([t for _, t, _ in level])
            if following:
                df = self._forward(df, [t for _, t, _ in level])
            level = following
        order = {m: _members(f)[0] for f, _ in fields for m in _members(f)}
        firsts = list(dict.fromkeys(order.get(c, c) for c in data.columns))
        self._output_columns = [o for c in firsts for o in final.get(c, [])]
        self._fitted, self._modified = True, False
        self.reset_randomization()

    @property
    def _sequence(self) -> list[BaseTransformer]:
        return [t for level in self._levels for t in level]

    def _need_fit(self) -> None:
        self._need_config()
        if not self._fitted or self._modified:
            raise NotFittedError("the plan is not fitted, or its config has changed: call fit")

    def reset_randomization(self) -> None:
        for t in self._sequence:
            t.reset_randomization()

    def save(self, path: str) -> None:
        """Store the fitted plan in a new folder: :meth:`load` gives it back in any session."""
        self._need_fit()
        store.save(self, path)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> HyperTransformer:
        return store.load(path, spark)

    # apply

    @staticmethod
    def _forward(df: DataFrame, operators: list[BaseTransformer], watch: Watch | None = None) -> DataFrame:
        """All operators of one level in one projection; those whose inputs are missing are left out."""
        operators = [t for t in operators if all(c in df.columns for c in t.columns)]
        names, made, noted = list(df.columns), [], {}
        for t in operators:
            df, own = t.forward(df, t.inputs(), t.draws("transform"))
            t.calls["transform"] += 1
            made += [own[s].alias(n) for n, s in t.outputs_by_name().items()]
            if UNSEEN in own:
                noted[t.columns[0]] = (column(t.columns[0]), own[UNSEEN])
        if watch is not None:
            df = watch.over(df, noted)
        used = {c for t in operators for c in t.columns}
        return df.select(*[column(c) for c in names if c not in used], *made)

    def _transform(self, data: DataFrame, watch: Watch | None = None) -> DataFrame:
        names = [c for c in data.columns]
        df = with_key(data, self.row_key if self._has_key(data) else None)
        for level in self._levels:
            df = self._forward(df, level, watch)
        passing = [c for c in names if self.field_transformers.get(self._field_of(c)) is None]
        return df.select(*[column(c) for c in self._output_columns if c in df.columns and (c not in names or c in passing or c in self._made())])

    def _made(self) -> set[str]:
        return {c for t in self._sequence for c in t.get_output_columns()}

    def _has_key(self, data: DataFrame) -> bool:
        if self.row_key == FILE_ROWS and FILE_ROWS not in data.columns:
            return True  # with_key warns where rows come from no files
        names = [self.row_key] if isinstance(self.row_key, str) else list(self.row_key or [])
        found = bool(names) and all(n in data.columns for n in names)
        if names and not found:
            warnings.warn(f"the data lack the row key {names}: random numbers go by a row's place in its partition, and are others on another partitioning", stacklevel=4)
        return found

    def transform(self, data: DataFrame, watch: Watch | None = None) -> DataFrame:
        """All columns; ``watch`` notes values that the fit has not seen in the result's own job."""
        self._need_fit()
        self._check_columns(data)
        return self._transform(data, watch)

    def transform_subset(self, data: DataFrame, watch: Watch | None = None) -> DataFrame:
        """As transform, for some of the columns."""
        self._need_fit()
        if unknown := set(data.columns) - set(self.field_sdtypes):
            raise InvalidDataError(f"columns that the fit has not seen: {sorted(unknown)}")
        return self._transform(data, watch)

    def fit_transform(self, data: DataFrame) -> DataFrame:
        self.fit(data)
        return self.transform(data)

    def _reverse(self, data: DataFrame, generators: bool) -> DataFrame:
        key = self.row_key if self._has_key(data) else None
        df, rows = with_key(data, key), None
        for level in reversed(self._levels):
            names, used, made = list(df.columns), set(), []
            for t in level:
                if isinstance(t, Generator) and t.is_generator():
                    if not generators:
                        continue
                elif not t.get_output_columns() or any(c not in names for c in t.get_output_columns()):
                    continue
                outputs = {s: column(n) for n, s in t.outputs_by_name().items()}
                if isinstance(t, Generator):
                    t.rows = rows
                df, own = t.inverse(df, outputs, t.draws("reverse_transform"))
                t.calls["reverse_transform"] += 1
                rows = t.rows if isinstance(t, Generator) else rows
                used |= set(t.get_output_columns())
                made += [own[c].alias(c) for c in t.columns]
            df = df.select(*[column(c) for c in names if c not in used], *made)
        return df.select(*[column(c) for c in self._input_columns if c in df.columns])

    def reverse_transform(self, data: DataFrame) -> DataFrame:
        self._need_fit()
        if missing := [c for c in self._output_columns if c not in data.columns]:
            raise InvalidDataError(f"outputs that the data lack: {missing}")
        if unknown := set(data.columns) - set(self._output_columns):
            raise InvalidDataError(f"columns that are no outputs: {sorted(unknown)}")
        return self._reverse(data, generators=True)

    def reverse_transform_subset(self, data: DataFrame) -> DataFrame:
        """As reverse_transform, for some of the outputs; generators make nothing."""
        self._need_fit()
        if unknown := set(data.columns) - set(self._output_columns):
            raise InvalidDataError(f"columns that are no outputs: {sorted(unknown)}")
        return self._reverse(data, generators=False)

    def create_anonymized_columns(self, num_rows: int, column_names: list[str], spark: SparkSession | None = None) -> DataFrame:
        """New rows of columns that operators make from nothing."""
        self._need_fit()
        if isinstance(num_rows, bool) or not isinstance(num_rows, int) or num_rows <= 0:
            raise ValueError("num_rows must be a whole number above 0")
        if unknown := [c for c in column_names if c not in self.field_sdtypes]:
            raise InvalidConfigError(f"columns that the config lacks: {unknown}")
        wanted = {id(t): t for c in column_names for t in [self.field_transformers[self._field_of(c)]]}
        if any(t is None or not t.is_generator() for t in wanted.values()):
            raise InvalidConfigError("only columns that are made by generators can be anonymized")
        if partial := [c for t in wanted.values() for c in t.columns if c not in column_names]:
            raise InvalidConfigError(f"columns that are made together with these: {partial}")
        spark = spark or SparkSession.active()
        df, made = spark.range(num_rows).select(F.col("id").cast("string").alias(KEY)), []
        for t in sorted(wanted.values(), key=lambda t: t.columns):
            t.rows = num_rows
            df, own = t.inverse(df, {}, t.draws("reverse_transform"))
            made += [own[c].alias(c) for c in t.columns]
        return df.select(*made).select(*[column(c) for c in self._input_columns if c in column_names])
