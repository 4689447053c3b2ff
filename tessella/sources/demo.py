"""The demonstration table, and random columns of each sdtype for tests and measurements."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numeric import normal_ppf
from tessella.functions.rng import uniform
from tessella.sources.providers import FIRST, pick, whole

DEMO = "last_login timestamp_ntz, email_optin boolean, credit_card string, age bigint, dollars_spent double"
CARDS = ["VISA", "AMEX", "DISCOVER"]
#: Five hand-written rows, with a missing value in all columns but one.
DEMO_ROWS = [
    (dt.datetime(2022, 3, 14), False, "VISA", 31, 12.5),
    (dt.datetime(2022, 7, 2), None, "AMEX", 24, None),
    (None, True, "VISA", 45, 60.99),
    (dt.datetime(2021, 11, 30), False, "DISCOVER", 19, 7.25),
    (dt.datetime(2022, 1, 8), True, None, 62, 81.4),
]


def get_demo(spark: SparkSession, num_rows: int = 5) -> DataFrame:
    """The hand-written rows, and beyond them random ones."""
    rows = spark.createDataFrame(DEMO_ROWS[:num_rows], DEMO)
    if num_rows <= len(DEMO_ROWS):
        return rows
    u = lambda what: uniform(F.col("id"), f"demo|{what}")
    some = lambda what, x: F.when(u(f"{what}?") >= 0.2, x)
    more = spark.range(num_rows - len(DEMO_ROWS)).select(
        some("login", F.date_add(F.lit("2000-01-01").cast("date"), whole(u("login"), 0, 9999).cast("int")).cast("timestamp_ntz")).alias("last_login"),
        some("optin", u("optin") < 0.5).alias("email_optin"),
        some("card", pick(u("card"), CARDS)).alias("credit_card"),
        whole(u("age"), 18, 99).alias("age"),
        some("spent", F.round(u("spent") * 100, 2)).alias("dollars_spent"),
    )
    return rows.unionByName(more)


def add_nulls(x: Column, key: Column, salt: str, share: float = 0.3) -> Column:
    """Make a share of a column missing."""
    return F.when(uniform(key, f"{salt}|null") >= share, x)


def _normal(u: Column) -> Column:
    return normal_ppf(F.greatest(u, F.lit(2.0**-52)))


def _step(seconds: int) -> Callable[[Column, Callable], Column]:
    return lambda i, u: F.timestamp_seconds(F.lit(1_000_000_000) + i * F.lit(seconds)).cast("timestamp_ntz")


#: By sdtype and name: a column from the row's number and a function that draws uniform numbers.
GENERATORS: dict[str, dict[str, Callable[[Column, Callable[[str], Column]], Column]]] = {
    "boolean": {
        "RandomBoolean": lambda i, u: u("b") < 0.5,
        "RandomSkewedBoolean": lambda i, u: u("b") < 0.1,
        "ConstantBoolean": lambda i, u: F.lit(True),
    },
    "categorical": {
        "RandomInteger": lambda i, u: whole(u("c"), 1, 5),
        "RandomString": lambda i, u: pick(u("c"), FIRST[:5]),
        "RandomMixed": lambda i, u: pick(u("c"), ["2000-01-01", "1", "0.5", "text", "true"]),
        "SingleInteger": lambda i, u: F.lit(7).cast("long"),
        "SingleString": lambda i, u: F.lit("A"),
        "UniqueInteger": lambda i, u: i,
        "UniqueString": lambda i, u: F.concat(F.lit("v"), i.cast("string")),
    },
    "datetime": {
        "RandomGapDatetime": lambda i, u: F.timestamp_seconds(F.lit(1_000_000_000) + whole(u("t"), 0, 86_399)).cast("timestamp_ntz"),
        "RandomGapSecondsDatetime": lambda i, u: F.timestamp_micros(F.lit(10**15) + whole(u("t"), 0, 999_999)).cast("timestamp_ntz"),
        "EqualGapHoursDatetime": _step(3600),
        "EqualGapDaysDatetime": _step(86_400),
        "EqualGapWeeksDatetime": _step(604_800),
    },
    "numerical": {
        "RandomInteger": lambda i, u: whole(u("n"), -(2**31), 2**31 - 1),
        "ConstantInteger": lambda i, u: F.lit(42).cast("long"),
        "AlmostConstantInteger": lambda i, u: F.when(u("n") < 0.99, F.lit(42)).otherwise(F.lit(43)).cast("long"),
        "Normal": lambda i, u: _normal(u("n")),
        "BigNormal": lambda i, u: _normal(u("n")) * 1e10,
    },
    "id": {"RandomString": lambda i, u: pick(u("s"), FIRST)},
    "pii": {"RandomString": lambda i, u: pick(u("s"), FIRST)},
    "text": {"RandomString": lambda i, u: pick(u("s"), FIRST)},
}


def random_column(spark: SparkSession, sdtype: str, name: str, rows: int, nulls: bool = False, seed: int = 42) -> DataFrame:
    """A table of ``row`` and ``value``."""
    salt = f"{seed}|{sdtype}|{name}"
    value = GENERATORS[sdtype][name](F.col("id"), lambda what: uniform(F.col("id"), f"{salt}|{what}"))
    return spark.range(rows).select(F.col("id").alias("row"), (add_nulls(value, F.col("id"), salt) if nulls else value).alias("value"))
