"""Dictionaries from fits, met by literals while they are small and by joins beyond.

A dictionary has a row for each value: ``value`` and other columns. Up to LITERALS rows
it is a part of the plan: an array for labels, a map or CASE of up to CASES entries, or
so few literal rows that they are broadcast. A larger one stays a table and is joined,
and Spark broadcasts it only if its size allows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a dictionary that may be written into a plan, and rows that a map or a CASE, which are searched one by one, may have.
LITERALS, CASES = 1000, 64


def typed(value: Any, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


@dataclass
class Dictionary:
    """``rows`` (small) or ``table`` (any size), with the types of the columns."""

    kinds: dict[str, T.DataType]
    rows: list[dict] | None = None
    table: DataFrame | None = None
    size: int = 0

    def __getstate__(self) -> dict:
        """For copies and pickles: a stored table is told by its folder, and read again from there."""
        state = dict(self.__dict__)
        if self.table is not None:
            folders = {f.rpartition("/")[0] for f in self.table.inputFiles()}
            if len(folders) != 1:
                raise TypeError("only a dictionary whose table is stored in one folder can be copied")
            state["table"] = (folders.pop(), self.table.schema.json())
        return state

    def __setstate__(self, state: dict) -> None:
        if state["table"] is not None:
            folder, schema = state["table"]
            state = state | {"table": SparkSession.active().read.schema(T.StructType.fromJson(json.loads(schema))).parquet(folder)}
        self.__dict__.update(state)

    def _joinable(self, wanted: list[str]) -> tuple[DataFrame, dict[str, str]]:
        tag = uuid4().hex[:8]
        names = {c: f"_{c}_{tag}" for c in wanted}
        return self.table.select(*[F.col(c).alias(n) for c, n in names.items()]), names

    def lookup(self, df: DataFrame, key: Column, by: str, wanted: list[str]) -> tuple[DataFrame, dict[str, Column]]:
        """The ``wanted`` columns of the row whose column ``by`` equals ``key`` (null meets null); null for none."""
        kind = self.kinds[by]
        key = key.cast(kind)
        if self.rows is not None:
            filled = [r for r in self.rows if r[by] is not None]
            null = next((r for r in self.rows if r[by] is None), None)
            out = {}
            if [r[by] for r in filled] == list(range(len(filled))) and filled and isinstance(kind, T.LongType):
                # labels from 0: places in an array
                place = F.when((key >= 0) & (key < len(filled)), (key + 1).cast("int"))
                for c in wanted:
                    at = F.element_at(F.array(*[typed(r[c], self.kinds[c]) for r in filled]), place)
                    out[c] = F.when(key.isNull(), typed(null[c] if null else None, self.kinds[c])).otherwise(at)
                return df, out
            if len(filled) > CASES:
                tag = uuid4().hex[:8]
                names = {c: f"_{c}_{tag}" for c in dict.fromkeys([by, *wanted])}
                one = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(*[typed(r[c], self.kinds[c]).alias(n) for c, n in names.items()]) for r in self.rows])).alias("r"))
                joined = df.join(F.broadcast(one.select("r.*")), key.eqNullSafe(F.col(names[by])), "left")  # LITERALS rows at most
                return joined, {c: F.col(names[c]) for c in wanted}
            for c in wanted:
                of_null = typed(null[c] if null else None, self.kinds[c])
                if filled:
                    pairs = [x for r in filled for x in (typed(r[by], kind), typed(r[c], self.kinds[c]))]
                    out[c] = F.when(key.isNull(), of_null).otherwise(F.try_element_at(F.create_map(*pairs), F.coalesce(key, typed(filled[0][by], kind))))
                else:
                    out[c] = F.when(key.isNull(), of_null)
            return df, out
        side, names = self._joinable(list(dict.fromkeys([by, *wanted])))
        joined = df.join(side, key.eqNullSafe(F.col(names[by])), "left")
        return joined, {c: F.col(names[c]) for c in wanted}

    def interval(self, df: DataFrame, v: Column, wanted: str, closed: str = "right", strict: bool = False) -> tuple[DataFrame, Column]:
        """``wanted`` of the interval (lo, hi] or [lo, hi) that holds ``v`` in [0, 1]; the first holds 0, the last 1.

        ``strict``: of the interval that holds any ``v`` by its own bounds; null for none.
        """
        if self.rows is not None and len(self.rows) <= CASES:
            rows = sorted((r for r in self.rows if r["hi"] > r["lo"] or len(self.rows) == 1), key=lambda r: r["lo"])
            if not rows:
                return df, F.lit(None).cast(self.kinds[wanted])
            out = F.when(v.isNull(), F.lit(None).cast(self.kinds[wanted]))
            if strict:
                for r in rows:
                    out = out.when((v > r["lo"]) & (v <= r["hi"]) if closed == "right" else (v >= r["lo"]) & (v < r["hi"]), typed(r[wanted], self.kinds[wanted]))
                return df, out
            for r in rows[:-1]:
                out = out.when(v <= r["hi"] if closed == "right" else v < r["hi"], typed(r[wanted], self.kinds[wanted]))
            return df, out.otherwise(typed(rows[-1][wanted], self.kinds[wanted]))
        table = self.as_table(df)
        n = F.lit(float(max(self.size, 1)))
        bucket = F.floor(v * n)
        tag = uuid4().hex[:8]
        lo, hi, at, name = (f"_{c}_{tag}" for c in ("lo", "hi", "at", "it"))
        side = table.where("hi > lo").select(F.col("lo").alias(lo), F.col("hi").alias(hi), F.col(wanted).alias(name), F.explode(F.sequence(F.floor(F.col("lo") * n), F.floor(F.col("hi") * n))).alias(at))
        inside = (v > F.col(lo)) & (v <= F.col(hi)) if closed == "right" else (v >= F.col(lo)) & (v < F.col(hi))
        if not strict:
            inside = inside | ((v == 0) & (F.col(lo) == 0) if closed == "right" else (v >= 1) & (F.col(hi) >= 1))
        joined = df.join(side, (bucket == F.col(at)) & inside, "left")
        return joined, F.col(name)

    def as_table(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            return self.table
        schema = T.StructType([T.StructField(c, k) for c, k in self.kinds.items()])
        return df.sparkSession.createDataFrame([tuple(r[c] for c in self.kinds) for r in self.rows], schema)
