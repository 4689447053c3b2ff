"""Keyed permutations of the numbers below a size: every number comes once, in an order without a stride.

A number is a pair of digits, the lower one of about the root of the size and 1000 at
most. Rounds add a keyed square of one digit to the other in turn, each modulo its base
(a Feistel network over two bases), which permutes the pairs. Pairs beyond the size, of
which there are fewer than the lower base, are walked on until they are inside; their ends
are found once on the driver, so a column needs no loop. Up to 1000 numbers are a table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import staged

#: Numbers that are permuted by a table, and the lower base.
SMALL = 1000
#: Rounds, and the prime that squares are made by: products of two numbers below it fit 63 bits.
ROUNDS, PRIME = 4, (1 << 31) - 1
MOST = (1 << 63) - 1


def _drawn(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


@dataclass
class Permutation:
    """The permutation of range(size) that a key chooses; Python, columns and SQL give the same numbers."""

    size: int
    key: str
    table: list[int] = field(init=False, default_factory=list, repr=False)
    ends: list[int] = field(init=False, default_factory=list, repr=False)

    def __post_init__(self):
        if not 0 < self.size <= MOST:
            raise ValueError(f"a permutation has 1 to {MOST} numbers, not {self.size}")
        self.moved, self.low, self.high = self.size, 1, self.size
        if self.size <= SMALL:
            self.table = sorted(range(self.size), key=lambda i: (_drawn(f"{self.key}|{i}"), i))
            return
        self.low = min(isqrt(self.size), SMALL)
        if self.size > 1 << 62:  # pairs stay within 63 bits: the last few numbers stay where they are
            self.moved -= self.size % self.low
        self.high = -(-self.moved // self.low)
        self.added = [[_drawn(f"{self.key}|{r}|{k}") % PRIME for k in range(4)] for r in range(ROUNDS)]
        for i in range(self.moved, self.low * self.high):
            while i >= self.moved:
                i = self._round_trip(i)
            self.ends.append(i)

    def _round_trip(self, i: int) -> int:
        upper, lower = divmod(i, self.low)
        for r, (a, b, c, d) in enumerate(self.added):
            x = (lower if r % 2 == 0 else upper) % PRIME
            first, second = (x + a) % PRIME * ((x + b) % PRIME) % PRIME, (x + c) % PRIME * ((x + d) % PRIME) % PRIME
            if r % 2 == 0:
                upper = (upper + (first * PRIME + second) % self.high) % self.high
            else:
                lower = (lower + first % self.low) % self.low
        return upper * self.low + lower

    def number(self, i: int) -> int:
        if self.table:
            return self.table[i]
        if i >= self.moved:
            return i
        i = self._round_trip(i)
        return i if i < self.moved else self.ends[i - self.moved]

    def column(self, df: DataFrame, i: Column) -> tuple[DataFrame, Column]:
        """The numbers of a column, and the frame with the steps that they need; null for null."""
        if self.table:
            return df, F.element_at(F.array(*map(F.lit, self.table)), (i + 1).cast("int")).cast("long")
        df, i = staged(df, i.cast("long"))
        df, upper = staged(df, F.call_function("div", i, F.lit(self.low)))
        df, lower = staged(df, i % F.lit(self.low))
        for r, (a, b, c, d) in enumerate(self.added):
            df, x = staged(df, (lower if r % 2 == 0 else upper) % F.lit(PRIME))
            square = lambda u, v, x=x: ((x + u) % PRIME) * ((x + v) % PRIME) % PRIME
            if r % 2 == 0:
                df, upper = staged(df, (upper + (square(a, b) * F.lit(PRIME) + square(c, d)) % F.lit(self.high)) % F.lit(self.high))
            else:
                df, lower = staged(df, (lower + square(a, b) % F.lit(self.low)) % F.lit(self.low))
        df, found = staged(df, upper * F.lit(self.low) + lower)
        if self.ends:
            found = F.when(found < self.moved, found).otherwise(F.element_at(F.array(*map(F.lit, self.ends)), (found - F.lit(self.moved - 1)).cast("int")).cast("long"))
        return df, found if self.moved == self.size else F.when(i >= self.moved, i).otherwise(found)

    def sql(self, i: str, source: str, name: str = "permuted") -> str:
        """DuckDB's SQL for the rows of ``source`` with the column ``name``."""
        if self.table:
            return f"(SELECT *, {self.table}[CAST({i} AS INT) + 1] AS {name} FROM {source})"
        steps, upper, lower = [f"CAST({i} AS BIGINT) // {self.low} AS u_", f"CAST({i} AS BIGINT) % {self.low} AS l_"], "u_", "l_"
        for r, (a, b, c, d) in enumerate(self.added):
            x = f"({lower if r % 2 == 0 else upper} % {PRIME})"
            square = lambda u, v, x=x: f"((({x} + {u}) % {PRIME}) * (({x} + {v}) % {PRIME}) % {PRIME})"
            if r % 2 == 0:
                steps.append(f"({upper} + ({square(a, b)} * {PRIME} + {square(c, d)}) % {self.high}) % {self.high} AS u_{r}")
                upper = f"u_{r}"
            else:
                steps.append(f"({lower} + {square(a, b)} % {self.low}) % {self.low} AS l_{r}")
                lower = f"l_{r}"
        found = f"{upper} * {self.low} + {lower}"
        if self.ends:
            found = f"CASE WHEN {found} < {self.moved} THEN {found} ELSE {self.ends}[CAST({found} - {self.moved - 1} AS INT)] END"
        return f"(SELECT * EXCLUDE ({', '.join(s.rpartition(' AS ')[2] for s in steps)}), CASE WHEN {i} >= {self.moved} THEN {i} ELSE {found} END AS {name} FROM (SELECT *, {', '.join(steps)} FROM {source}))"
