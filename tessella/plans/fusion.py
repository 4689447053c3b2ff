"""Fits of many operators in two scans: one aggregation, and one grouping of all values that are wanted; date strings have one more, of their shapes.

What needs the first statistics (logarithms beyond an edge, sums in bins) is one more aggregation and one more grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import OutOfBoundsError
from tessella.functions import date_shapes as S
from tessella.functions.lookup import LITERALS, Dictionary
from tessella.functions.mixtures import binned
from tessella.functions.tables import cut
from tessella.functions.watch import report, report_columns
from tessella.operators.base import KEY, BaseTransformer, column, kind_of


def _text(x: Column, kind: T.DataType) -> Column:
    """A value as text that casts back to the same value."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.nanvl(x, F.lit(None).cast(kind)) + F.lit(0.0).cast(kind)
    return x.cast("string")


def _order_of_rows(df: DataFrame, row_key: str | list[str] | None) -> tuple[Column, bool]:
    """What the first row of a value is told by: an integer key itself, else the key's length and text."""
    names = [row_key] if isinstance(row_key, str) else list(row_key or [])
    if len(names) == 1 and names[0] in df.columns and isinstance(kind_of(df, names[0]), T.IntegralType):
        return column(names[0]).cast("long"), True
    return F.struct(F.length(KEY).alias("l"), F.col(KEY).alias("k")), False


def value_counts(df: DataFrame, columns: dict[str, T.DataType], row_key: str | list[str] | None) -> dict[str, Dictionary]:
    """Per column: value (null too), n, and first (the smallest key, if rows have keys of their own)."""
    return dictionaries(cut(counted(df, columns, row_key)), columns)


def counted(df: DataFrame, columns: dict[str, T.DataType], row_key: str | list[str] | None) -> DataFrame:
    """i (the column's place), v (a value as text), n, first."""
    names = list(columns)
    entries = F.array(*[F.struct(F.lit(i).alias("i"), _text(column(c), columns[c]).alias("v")) for i, c in enumerate(names)])
    order, plain = _order_of_rows(df, row_key)
    least = F.min("o")
    first = (least if plain else least["k"]).cast("string") if row_key else F.lit(None).cast("string")
    spread = df.select((order if row_key else F.lit(None)).alias("o"), F.explode(entries).alias("e")).select("o", "e.i", "e.v")
    return spread.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def recounted(counts: DataFrame, df: DataFrame, row_key: str | list[str] | None) -> DataFrame:
    """The sums of several tables of :func:`counted`; ``df`` has the columns of the rows."""
    plain = _order_of_rows(df, row_key)[1]
    first = F.min(F.col("first").cast("long")).cast("string") if plain else F.min(F.struct(F.length("first"), F.col("first").alias("k")))["k"]
    return counts.groupBy("i", "v").agg(F.sum("n").alias("n"), first.alias("first"))


def dictionaries(counts: DataFrame, columns: dict[str, T.DataType]) -> dict[str, Dictionary]:
    """What a stored table of :func:`counted` has, by column."""
    names = list(columns)
    sizes = {r.i: r.n for r in counts.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    small = [i for i, n in sizes.items() if n <= LITERALS]
    literal: dict[int, list] = {i: [] for i in range(len(names))}
    if small:
        for r in counts.where(F.col("i").isin(small)).collect():  # at most LITERALS rows for each column
            literal[r.i].append(r)
    out = {}
    for i, c in enumerate(names):
        kinds = {"value": columns[c], "n": T.LongType(), "first": T.StringType()}
        table = counts.where(F.col("i") == i).select(F.col("v").cast(columns[c]).alias("value"), "n", "first")
        if sizes.get(i, 0) > LITERALS:
            out[c] = Dictionary(kinds, table=table, size=sizes[i])
        else:
            # small: the values come back in their own type
            rows = [r.asDict() for r in table.collect()] if literal[i] and not isinstance(columns[c], T.StringType) else [{"value": r.v, "n": r.n, "first": r["first"]} for r in literal[i]]
            out[c] = Dictionary(kinds, rows=rows, size=len(rows))
    return out


def aggregated(df: DataFrame, wanted: list[dict[str, Column]]) -> dict[int, dict]:
    """The results of several operators' aggregates, by the operator's place and the aggregate's name, from one scan."""
    columns = [c.alias(f"{i}|{name}") for i, own in enumerate(wanted) for name, c in own.items()]
    found = iter(df.agg(*columns).first() if columns else ())
    return {i: {name: next(found) for name in own} for i, own in enumerate(wanted) if own}


def date_shapes(df: DataFrame, texts: dict[int, Column]) -> dict[int, list[tuple] | None]:
    """By the texts' places: their shapes, rows and extremes of numbers; None where there are more than a column of dates has."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in texts.items()])
    spread = df.select(F.explode(entries).alias("e")).select("e.i", "e.t").where("t IS NOT NULL")
    seen = cut(spread.groupBy("i", S.shape(F.col("t")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), *S.extremes(F.col("t"))))
    sizes = {r.i: r["count"] for r in seen.groupBy("i").count().collect()}  # a row for each column
    out: dict[int, list[tuple] | None] = {i: [] if sizes.get(i, 0) <= S.MOST_SHAPES else None for i in texts}
    few = [i for i, own in out.items() if own is not None]
    for r in seen.where(F.col("i").isin(few)).collect():  # at most MOST_SHAPES rows for each column
        out[r.i].append((r["shape"], r.n, r.lows, r.highs))
    return out


def _with_examples(error: OutOfBoundsError, df: DataFrame, op: BaseTransformer) -> OutOfBoundsError:
    """The error with up to five of its values: one more scan, only of data that are refused."""
    v = column(op.columns[0])
    found = report(df.agg(*[c.alias(name) for name, c in report_columns(v, F.coalesce(error.bad(v.cast("double")), F.lit(False))).items()]).first().asDict())
    return OutOfBoundsError(f"{error}, such as {found}" if found.rows else str(error), error.bad)


def fit_together(df: DataFrame, operators: list[BaseTransformer]) -> None:
    """Fit prepared operators on ``df``, which has the key column."""
    texts = {i: t for i, op in enumerate(operators) if (t := op.texts(op.inputs())) is not None}
    for i, own in (date_shapes(df, texts) if texts else {}).items():
        operators[i].choose(own)
    found = aggregated(df, [op.requests(op.inputs(), op.kinds) for op in operators])
    valued = {op.columns[0]: op.kinds[op.columns[0]] for op in operators if op.wants_values}
    values = value_counts(df, valued, next((op.row_key for op in operators if op.row_key), None)) if valued else {}
    for i, op in enumerate(operators):
        try:
            op.bind(found.get(i, {}), values.get(op.columns[0]) if op.wants_values else None)
        except OutOfBoundsError as e:
            raise _with_examples(e, df, op) from None
    found = aggregated(df, [op.later(op.inputs()) for op in operators])
    wanted = {i: b for i, op in enumerate(operators) if (b := op.binning(op.inputs())) is not None}
    bins = binned(df, wanted) if wanted else {}
    for i, op in enumerate(operators):
        if i in found or i in bins:
            op.bind_later(found.get(i, {}), bins.get(i))
        op.fitted = True
