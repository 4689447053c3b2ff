"""Counts of distinct values by mergeable sketches (HyperLogLog), in the scan of the other statistics.

A sketch has 2^LG_K bytes whatever it counts. Its estimate has a standard error of
ERROR (relative), also after merging; up to some hundreds of values it is exact but for chance.
Nulls are not counted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logarithm of a sketch's slots, and the relative standard error of merged sketches.
LG_K = 14
ERROR = 1.04 / 2 ** (LG_K / 2)


def sketch(x: Column, kind: T.DataType) -> Column:
    """An aggregate: the sketch of a column's values, told by their text; zeros are one value."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = x + F.lit(0.0).cast(kind)
    return F.hll_sketch_agg(x if isinstance(kind, T.BinaryType) else x.cast("string"), F.lit(LG_K))


def distinct_requests(x: Column, kind: T.DataType, null_too: bool) -> dict[str, Column]:
    """Aggregates by name that :func:`distinct_found` takes; ``null_too`` counts null as a value."""
    own = sketch(x, kind)
    return {"sketch": own, "about": F.hll_sketch_estimate(own), "blank": F.count_if(x.isNull() & F.lit(null_too))}


def distinct_found(stats: dict) -> int:
    return (stats["about"] or 0) + bool(stats["blank"])


def union(sketches: Iterable[bytes]) -> tuple[bytes, int]:
    """The sketch of all, and its estimate; the sketches are those of batches, 2^LG_K bytes each."""
    rows = SparkSession.active().createDataFrame([(bytearray(s),) for s in sketches], "s binary")
    whole = F.hll_union_agg("s")
    found = rows.agg(whole.alias("s"), F.hll_sketch_estimate(whole).alias("n")).first()
    return bytes(found.s), found.n


def distinct_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> dict[str, int]:
    """Distinct values by column without nulls: sketches of all columns in one scan, or exact counts, which shuffle the values."""
    kinds = {f.name: f.dataType for f in df.schema.fields if columns is None or f.name in columns}
    names = list(kinds)
    own = {c: F.col(f"`{c}`") for c in names}
    if not names:
        return {}
    if not exact:
        found = df.agg(*[F.hll_sketch_estimate(sketch(own[c], kinds[c])).alias(f"_{i}") for i, c in enumerate(names)]).first()
        return {c: found[i] for i, c in enumerate(names)}
    zero = lambda c: own[c] + F.lit(0.0).cast(kinds[c]) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else own[c]
    entries = F.array(*[F.struct(F.lit(i).alias("i"), (F.base64(own[c]) if isinstance(kinds[c], T.BinaryType) else zero(c).cast("string")).alias("v")) for i, c in enumerate(names)])
    spread = df.select(F.explode(entries).alias("e")).select("e.i", "e.v").where("v IS NOT NULL").distinct()
    found = {r.i: r["count"] for r in spread.groupBy("i").count().collect()}  # a row for each column
    return {c: found.get(i, 0) for i, c in enumerate(names)}
