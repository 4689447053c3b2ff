"""Tables that fits keep: lineage cuts in the shared folder, and running sums that no single task makes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
#: Spark's setting by which a query's shuffle files go at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a private one only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_LOCAL_ROOT[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back: it is made once and outlives executors.

    The write's shuffle files go when it has ended: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def by_ranges(table: DataFrame, order: list[Column], amount: Column) -> DataFrame:
    """The rows stored by ranges of their order, with the range (_part) and the amount (_amount)."""
    return cut(table.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_amount": amount}))


def running(table: DataFrame, order: list[Column], amount: Column) -> DataFrame:
    """Add _number (from 0) and _before (the sum of ``amount`` of all earlier rows) in ``order``.

    Ranges of the order are summed side by side; only a row for each range meets in one task.
    """
    return running_over(by_ranges(table, order, amount), order)


def running_over(dealt: DataFrame, order: list[Column]) -> DataFrame:
    """The same for rows that :func:`by_ranges` has stored."""
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), zero).alias("_rows_before"), F.coalesce(F.sum("_total").over(before), zero).alias("_total_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = dealt.withColumns(
        {"_number": F.row_number().over(inside) - 1, "_inner": F.coalesce(F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)}
    )
    joined = numbered.join(F.broadcast(parts), "_part")  # a row for each partition
    return joined.withColumns({"_number": F.col("_number") + F.col("_rows_before"), "_before": F.col("_inner") + F.col("_total_before")}).drop(
        "_part", "_amount", "_inner", "_rows_before", "_total_before"
    )
