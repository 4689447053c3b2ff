"""Fits over streams: each micro-batch leaves mergeable statistics, and a plan is made of all of them at any time.

A batch's statistics (counts, extremes, means and deviations with their counts, whether
all values divide, and the counts of categories) are stored under the batch's id. A batch
that is replayed overwrites its own, so it counts once. The plan made of them is that of
one fit over all rows: sums and extremes are exact, and means differ in the order of
additions only.

Operators whose fit takes more than one look at the rows have no such statistics and are
refused: mixtures, kernel densities, gamma, beta and Student's t, date strings without a
given pattern, the rules 'scale' and (unless by sketches) 'match', pseudonyms, and chains of operators.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.errors import NotFittedError
from tessella.functions.sketches import union
from tessella.functions.tables import cut
from tessella.operators.base import BaseTransformer, with_key
from tessella.operators.numeric import ClusterBasedNormalizer, GaussianNormalizer
from tessella.operators.pii import PseudoAnonymizedFaker
from tessella.plans.fusion import aggregated, counted, dictionaries, recounted
from tessella.plans.store import packed, unpacked
from tessella.plans.table import HyperTransformer

#: Names of statistics by how they are merged; other names raise.
SUMS = {"null_n", "null_nulls", "n", "nulls", "misfits", "blank"}
LEAST = {"null_low", "low", "rep_low", "below", "d_low", "zone_low", "example"}
MOST = {"null_high", "high", "rep_high", "above", "d_high", "zone_high", "digits", "whole"}
ALL = {"rep_whole", "finite"}
MEANS = {"null_mean", "d_mean"}


def check_streamable(operator: BaseTransformer) -> None:
    """Raise ValueError for an operator that can't be fitted from one look at the rows."""
    bad = isinstance(operator, (ClusterBasedNormalizer, PseudoAnonymizedFaker)) or getattr(operator, "cardinality_rule", None) in ("match", "scale") and not operator.sketched()
    bad = bad or isinstance(operator, GaussianNormalizer) and operator.distribution in ("gamma", "beta", "t", "gaussian_kde")
    if bad or operator.texts(operator.inputs()) is not None:
        raise ValueError(f"{operator!r} for {operator.columns} needs more than one look at the rows: fit it on a batch")


def merged(operator: BaseTransformer, batches: list[dict[str, Any]]) -> dict[str, Any]:
    """The statistics of all batches' rows together."""
    out: dict[str, Any] = {}
    filled = [b["null_n"] - b["null_nulls"] if "null_n" in b else 0 for b in batches]
    for name in batches[0]:
        values = [(b[name], n) for b, n in zip(batches, filled, strict=True) if b[name] is not None]
        if not values:
            out[name] = None
        elif name in SUMS:
            out[name] = sum(v for v, _ in values)
        elif name in LEAST or name == "edge" and not operator.invert:
            out[name] = min(v for v, _ in values)
        elif name in MOST or name == "edge":
            out[name] = max(v for v, _ in values)
        elif name in ALL or name.startswith("unit"):
            out[name] = all(v for v, _ in values)
        elif name in MEANS:
            out[name] = math.fsum(v * n for v, n in values) / max(1, sum(n for _, n in values))
        elif name == "sketch":
            out["sketch"], out["about"] = union(v for v, _ in values)
        elif name not in ("d_sd", "about"):
            raise ValueError(f"the statistic {name!r} of {operator.get_name()} can't be merged")
    if "d_sd" in batches[0]:
        # squared deviations about the whole mean
        parts = [(b["d_sd"], b["d_mean"], n) for b, n in zip(batches, filled, strict=True) if b["d_sd"] is not None]
        squares = math.fsum(n * (sd * sd + (mean - out["d_mean"]) ** 2) for sd, mean, n in parts)
        out["d_sd"] = math.sqrt(squares / max(1, sum(n for _, _, n in parts))) if parts else None
    return out


class StreamFit:
    """Statistics of a stream's batches in a folder that driver and executors share, and plans made of them."""

    def __init__(self, make: Callable[[], HyperTransformer], path: str):
        self.make, self.path = make, path.rstrip("/")

    def absorb(self, df: DataFrame, batch_id: int) -> None:
        """Store a batch's statistics; the same id again overwrites them."""
        plan, told = self.make(), {}

        def learn(rows: DataFrame, operators: list[BaseTransformer]) -> None:
            for op in operators:
                check_streamable(op)
            told["stats"] = aggregated(rows, [op.requests(op.inputs(), op.kinds) for op in operators])
            valued = {op.columns[0]: op.kinds[op.columns[0]] for op in operators if op.wants_values}
            if valued:
                counted(rows, valued, plan.row_key).write.mode("overwrite").parquet(f"{self.path}/values/batch={batch_id}")
            raise _Told

        try:
            plan._fit(df, learn)
        except _Told:
            pass
        spark = df.sparkSession
        state = packed({"stats": told.get("stats", {}), "schema": df.schema})
        # the statistics come last: a batch counts when it has them
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.path}/stats/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Absorb a stream; by default what is there now."""

        def run(df: DataFrame, batch_id: int) -> None:
            df.persist()
            try:
                self.absorb(df, batch_id)
            finally:
                df.unpersist()

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def plan(self, spark: SparkSession) -> HyperTransformer:
        """The plan that one fit over the rows of all batches would give."""
        try:
            rows = spark.read.text(f"{self.path}/stats", wholetext=True).select("value", F.col("batch").cast("long").alias("batch")).collect()  # a row for each batch
        except Exception as e:
            raise NotFittedError("no batch has been absorbed") from e
        states = {r.batch: unpacked(spark, json.loads(r["value"])) for r in rows}
        schema: T.StructType = next(iter(states.values()))["schema"]
        plan = self.make()

        def learn(df: DataFrame, operators: list[BaseTransformer]) -> None:
            if all(op.fitted for op in plan.field_transformers.values() if op is not None):
                raise ValueError("chains of operators need more than one look at the rows: fit them on a batch")
            valued = {op.columns[0]: op.kinds[op.columns[0]] for op in operators if op.wants_values}
            values = {}
            if valued:
                counts = spark.read.parquet(f"{self.path}/values").where(F.col("batch").isin(list(states)))
                values = dictionaries(cut(recounted(counts.drop("batch"), df, plan.row_key)), valued)
            for i, op in enumerate(operators):
                stats = [s["stats"][i] for s in states.values() if i in s["stats"]]
                op.bind(merged(op, stats) if stats else {}, values.get(op.columns[0]) if op.wants_values else None)
                op.fitted = True

        plan._fit(with_key(spark.createDataFrame([], schema), None).select(*schema.names), learn)
        return plan


class _Told(Exception):
    """Ends a fit after its first look."""


def fit_batches(make: Callable[[], HyperTransformer], path: str, batches: Iterable[DataFrame], spark: SparkSession) -> HyperTransformer:
    """The plan of some tables, absorbed one after another."""
    fit = StreamFit(make, path)
    for k, df in enumerate(batches):
        fit.absorb(df, k)
    return fit.plan(spark)
