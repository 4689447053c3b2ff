"""Apply fitted operators and plans to streams, and refit them as data arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.errors import NotFittedError
from tessella.operators.base import BaseTransformer
from tessella.plans.table import HyperTransformer


def transform_stream(plan: HyperTransformer | BaseTransformer, stream: DataFrame) -> DataFrame:
    """The transformed stream; the plan was fitted on a batch.

    Operators that number rows over the whole table can't do so on a stream, and rows
    of a stream have no numbers, so random draws need a row key.
    """
    operators = plan._sequence if isinstance(plan, HyperTransformer) else [plan]
    if not operators or not all(t.fitted for t in operators):
        raise NotFittedError("fit the plan on a batch first")
    if not plan.row_key:
        raise ValueError("a plan for streams needs a row_key")
    return plan.transform(stream)


def reverse_stream(plan: HyperTransformer, stream: DataFrame) -> DataFrame:
    """Reverse a stream of outputs; columns that generators make are left out."""
    return plan.reverse_transform_subset(stream)


def refit_by_batch(stream: DataFrame, make: Callable[[], HyperTransformer], sink: Callable[[DataFrame, HyperTransformer, int], None], checkpoint: str, every: int = 1) -> StreamingQuery:
    """Fit a new plan on each ``every``-th micro-batch, and pass each batch transformed to ``sink(df, plan, batch_id)``."""
    held: dict[str, HyperTransformer] = {}

    def run(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        if "plan" not in held or batch_id % every == 0:
            held["plan"] = make()
            held["plan"].fit(df)
        sink(held["plan"].transform(df), held["plan"], batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["refit_by_batch", "reverse_stream", "transform_stream"]
