"""Values that don't fit, noted by the job that transforms them, or told by one aggregation.

A report is a count and up to EXAMPLES values: the least of each of PARTS parts by hash, so
its size is bounded whatever the data, and it is the same on any partitioning.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

EXAMPLES, PARTS = 5, 16
#: Letters of a long text that an example keeps.
SHOWN = 200


@dataclass
class Report:
    """Rows whose values don't fit, and up to EXAMPLES of these values in order."""

    rows: int
    examples: list

    def __str__(self) -> str:
        return f"{self.examples} ({self.rows} rows)"


def report_columns(v: Column, bad: Column) -> dict[str, Column]:
    """Aggregates by name that :func:`report` takes."""
    part = F.pmod(F.xxhash64(v), F.lit(PARTS))
    return {"rows": F.count_if(bad), "nulls": F.count_if(bad & v.isNull())} | {f"least{k}": F.min(F.when(bad & (part == k), v)) for k in range(PARTS)}


def report(found: dict[str, Any]) -> Report:
    examples = sorted(v for k in range(PARTS) if (v := found[f"least{k}"]) is not None)[:EXAMPLES]
    if found["nulls"] and len(examples) < EXAMPLES:
        examples.append(None)
    return Report(found["rows"], examples)


class Watch:
    """Notes the values that a fit has not seen while a result is computed: no job of its own.

    Give it to ``transform``, run the result whole, and ask. ``reports`` waits until the
    result's first job has ended, so it must not be asked before one is begun. A job that
    computes only a part of the rows (``first``, ``limit``) notes that part.
    """

    def __init__(self):
        self._parts: list[tuple[Observation, list[str]]] = []

    def over(self, df: DataFrame, noted: dict[str, tuple[Column, Column]]) -> DataFrame:
        """``df``, whose jobs note by column the value and whether it doesn't fit."""
        if not noted:
            return df
        observation = Observation()
        metrics = []
        for i, (v, bad) in enumerate(noted.values()):
            # long texts are shown in part
            shown = F.substring(v, 1, SHOWN) if dict(df.select(v.alias("v")).dtypes)["v"] == "string" else v
            metrics += [c.alias(f"{i}|{name}") for name, c in report_columns(shown, bad).items()]
        self._parts.append((observation, list(noted)))
        return df.observe(observation, *metrics)

    @property
    def reports(self) -> dict[str, Report]:
        """By column, where some rows' values don't fit."""
        out = {}
        for observation, names in self._parts:
            found = observation.get
            for i, name in enumerate(names):
                own = report({k.partition("|")[2]: v for k, v in found.items() if k.partition("|")[0] == str(i)})
                if own.rows:
                    out[name] = own
        return out

    def warn(self) -> None:
        """A warning for each column with values that the fit has not seen."""
        for name, own in self.reports.items():
            warnings.warn(f"column '{name}' has values that the fit has not seen, such as {own}", stacklevel=2)
