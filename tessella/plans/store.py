"""Fitted plans and operators in a folder: JSON of their state, and dictionaries that are tables as Parquet beside it.

What is loaded needs nothing of the session that saved it: tables are read from the
folder, not from where the fit left them. Only classes of this library and operators that
are imported are made again.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import importlib
import json
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.errors import InvalidDataError
from tessella.operators.base import BaseTransformer

#: The layout of the folder.
VERSION = 1
LIBRARY = __name__.partition(".")[0]


def _named(cls: type) -> str:
    return f"{cls.__module__}:{cls.__qualname__}"


def _class(name: str) -> type:
    """A class of this library, or an operator that its user has imported."""
    module, _, path = name.partition(":")
    if module.partition(".")[0] == LIBRARY:
        found: Any = importlib.import_module(module)
        for part in path.split("."):
            found = getattr(found, part)
        return found
    known = {_named(c): c for c in BaseTransformer.get_subclasses()}
    if name not in known:
        raise InvalidDataError(f"{name} is not known: import the module that has it before loading")
    return known[name]


class _Writer:
    def __init__(self, path: str):
        self.path, self.tables = path, 0
        self.seen: dict[int, int] = {}

    def told(self, value: Any) -> Any:
        """A value as JSON; what JSON lacks is told by a pair of a kind and a value."""
        if value is None or isinstance(value, (bool, str)):
            return value
        if isinstance(value, (int, np.integer)):
            return int(value)
        if isinstance(value, (float, np.floating)):
            return {"float": float(value).hex()}
        if isinstance(value, list):
            return [self.told(v) for v in value]
        if isinstance(value, dict) and type(value) is dict:
            return {"dict": [[self.told(k), self.told(v)] for k, v in value.items()]}
        if isinstance(value, (tuple, set, frozenset)):
            return {type(value).__name__: [self.told(v) for v in value]}
        if isinstance(value, np.ndarray):
            return {"array": [str(value.dtype), list(value.shape), self.told(value.ravel().tolist())]}
        if isinstance(value, T.DataType):
            return {"kind": value.json()}
        if isinstance(value, (dt.datetime, dt.date)):
            return {type(value).__name__: value.isoformat()}
        if isinstance(value, dt.timedelta):
            return {"timedelta": [value.days, value.seconds, value.microseconds]}
        if isinstance(value, Decimal):
            return {"decimal": str(value)}
        if isinstance(value, (bytes, bytearray)):
            return {"bytes": bytes(value).hex()}
        if isinstance(value, DataFrame):
            name = f"tables/{self.tables}"
            self.tables += 1
            value.write.parquet(f"{self.path}/{name}")
            return {"table": [name, value.schema.json()]}
        if isinstance(value, BaseTransformer) or dataclasses.is_dataclass(value) or type(value).__module__.partition(".")[0] == LIBRARY:
            if id(value) in self.seen:
                return {"again": self.seen[id(value)]}
            self.seen[id(value)] = len(self.seen)
            return {"object": [_named(type(value)), [[k, self.told(v)] for k, v in value.__dict__.items()]]}
        raise InvalidDataError(f"a {type(value).__name__} can't be stored")


class _Reader:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.objects: list[Any] = []

    def made(self, told: Any) -> Any:
        if isinstance(told, list):
            return [self.made(v) for v in told]
        if not isinstance(told, dict):
            return told
        ((kind, value),) = told.items()
        if kind == "object":
            out = object.__new__(_class(value[0]))
            self.objects.append(out)
            for k, v in value[1]:
                object.__setattr__(out, k, self.made(v))
            return out
        simple = {
            "float": lambda: float.fromhex(value),
            "dict": lambda: {self.made(k): self.made(v) for k, v in value},
            "tuple": lambda: tuple(map(self.made, value)),
            "set": lambda: set(map(self.made, value)),
            "frozenset": lambda: frozenset(map(self.made, value)),
            "array": lambda: np.array(self.made(value[2]), value[0]).reshape(value[1]),
            "kind": lambda: T._parse_datatype_json_string(value),
            "datetime": lambda: dt.datetime.fromisoformat(value),
            "date": lambda: dt.date.fromisoformat(value),
            "timedelta": lambda: dt.timedelta(*value),
            "decimal": lambda: Decimal(value),
            "bytes": lambda: bytes.fromhex(value),
            "table": lambda: self.spark.read.schema(T.StructType.fromJson(json.loads(value[1]))).parquet(f"{self.path}/{value[0]}"),
            "again": lambda: self.objects[value],
        }
        return simple[kind]()


def packed(value: Any) -> Any:
    """A value of plain types as JSON."""
    return _Writer("").told(value)


def unpacked(spark: SparkSession, told: Any) -> Any:
    return _Reader(spark, "").made(told)


def save(thing: Any, path: str, spark: SparkSession | None = None) -> None:
    """Store a fitted plan or operator in a new folder, which may be in any store that Spark writes."""
    spark = spark or SparkSession.active()
    path = path.rstrip("/")
    state = json.dumps({"version": VERSION, "state": _Writer(path).told(thing)})
    # the state comes last: a folder without it was never finished
    spark.createDataFrame([(state,)], "state string").coalesce(1).write.text(f"{path}/state")


def load(path: str, spark: SparkSession | None = None) -> Any:
    """What :func:`save` stored."""
    spark = spark or SparkSession.active()
    path = path.rstrip("/")
    stored = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()["value"])
    if stored["version"] != VERSION:
        raise InvalidDataError(f"{path} has the layout {stored['version']}, and this library reads {VERSION}")
    return _Reader(spark, path).made(stored["state"])
