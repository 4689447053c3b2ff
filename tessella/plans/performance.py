"""Measurements of operators: seconds, bytes and peak memory for each row, over tables of growing size."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.base import BaseTransformer
from tessella.sources.demo import random_column

SIZES = (1_000, 10_000, 100_000)
CATEGORICAL_SIZES = (1_000, 10_000)


def _run(df: DataFrame) -> None:
    """Compute all rows, keep none."""
    df.write.format("noop").mode("overwrite").save()


def _peaks(spark: SparkSession) -> dict[tuple[int, int], int]:
    """Peak execution memory of each stage attempt that Spark still lists, summed over the stage's tasks."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.peakExecutionMemory() for s in (stages.apply(k) for k in range(stages.size()))}


def _measured(spark: SparkSession, work: Callable[[], object], times: int) -> tuple[float, float]:
    """Mean seconds, and the largest peak of execution memory of a stage (that of hash tables, sorts and shuffles)."""
    before, took = _peaks(spark), []
    for _ in range(times):
        began = time.perf_counter()
        work()
        took.append(time.perf_counter() - began)
    return sum(took) / len(took), float(max((n for k, n in _peaks(spark).items() if k not in before), default=0))


def nulls_left(transformed: DataFrame, transformer: BaseTransformer) -> dict[str, int]:
    """How many nulls each output column of a transform still has (only those that have some)."""
    names = transformer.get_output_columns()
    found = transformed.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names]).first() if names else {}
    return {n: found[n] for n in names if found[n]}


def profile_transformer(spark: SparkSession, transformer: BaseTransformer, sdtype: str, generator: str, rows: int, nulls: bool = False, times: int = 3) -> dict[str, float]:
    """Mean seconds and peak memory of fit, transform and reverse_transform over a cached table, and the outputs' size in bytes."""
    data = random_column(spark, sdtype, generator, rows, nulls).cache()
    data.count()
    own, out = transformer.copy(), {}

    def measure(name: str, work: Callable[[], object]) -> None:
        out[f"{name}_time"], out[f"{name}_memory"] = _measured(spark, work, times)

    measure("fit", lambda: own.copy().fit(data, "value", "row"))
    own.fit(data, "value", "row")
    measure("transform", lambda: _run(own.transform(data)))
    made = own.transform(data).cache()
    made.count()
    measure("reverse_transform", lambda: _run(own.reverse_transform(made)))
    stats = made._jdf.queryExecution().optimizedPlan().stats()
    out["transformed_bytes"] = float(str(stats.sizeInBytes()))
    made.unpersist()
    data.unpersist()
    return out


def evaluate_transformer_performance(spark: SparkSession, transformer: BaseTransformer, sdtype: str, generator: str, nulls: bool = False, times: int = 3) -> dict[str, float]:
    """The largest figure for each row over all sizes."""
    worst: dict[str, float] = {}
    for rows in CATEGORICAL_SIZES if sdtype == "categorical" else SIZES:
        for name, value in profile_transformer(spark, transformer, sdtype, generator, rows, nulls, times).items():
            worst[name] = max(worst.get(name, 0.0), value / rows)
    return worst
