"""Random numbers as a function of a seed, a purpose and a row's key.

The same key gives the same number on any partitioning, and md5 gives the same number
in any engine, so randomised operators can be held against SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits taken from the digest, and the numbers they tell apart.
HEX_DIGITS, STEPS = 13, float(1 << 52)


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) for each key."""
    text = F.concat(F.lit(f"{salt}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(STEPS)


def uniform_sql(key: str, salt: str) -> str:
    """The same number in DuckDB's SQL."""
    return f"(CAST('0x' || substr(md5('{salt}|' || coalesce(CAST({key} AS VARCHAR), '')), 1, {HEX_DIGITS}) AS UBIGINT) / {STEPS})"


@dataclass(frozen=True)
class Draws:
    """Where an operator gets its random numbers from: the row's key, a seed, and the count of earlier calls."""

    key: Column
    seed: int
    field: str
    epoch: int = 0

    def salt(self, purpose: str) -> str:
        return f"{self.seed}|{self.field}|{purpose}" + (f"|{self.epoch}" if self.epoch else "")

    def uniform(self, purpose: str) -> Column:
        return uniform(self.key, self.salt(purpose))

    def of(self, field: str) -> Draws:
        return replace(self, field=field)
