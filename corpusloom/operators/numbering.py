"""Row numbers and running totals in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

_PLACE = (1 << 33) - 1


def _ordered(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """Rows in ranges of the order, stored, with the range and the place in it."""
    n = parts or max(1, df.sparkSession.sparkContext.defaultParallelism)
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(laid.select("*", F.shiftright("_id", 33).cast("int").alias("_range"), F.col("_id").bitwiseAND(F.lit(_PLACE)).alias("_place")).drop("_id"), "numbered")


def _before(sums: dict[int, int]) -> Column:
    """What the ranges before a row's range sum up to; one entry a range."""
    total, pairs = 0, []
    for key in sorted(sums):
        pairs += [F.lit(key), F.lit(total)]
        total += sums[key]
    return F.element_at(F.create_map(*pairs), F.col("_range")) if pairs else F.lit(0)


def number_rows(df: DataFrame, *order: str, name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of the columns: a long column ``name``.

    Ranges of the order are sorted side by side; the driver holds one count a range.
    """
    laid = _ordered(df, list(order), parts)
    counts = {r["_range"]: r["n"] for r in laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    return laid.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_place") + _before(counts)).cast("long").alias(name))


def running_total(df: DataFrame, value: str, *order: str, name: str = "before", parts: int | None = None) -> DataFrame:
    """Sum of the values of all rows before each row in the order: a long column ``name``."""
    laid = _ordered(df, list(order), parts)
    sums = {r["_range"]: r["n"] or 0 for r in laid.groupBy("_range").agg(F.sum(value).alias("n")).collect()}
    within = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return laid.select(*(F.col(f"`{c}`") for c in df.columns), (within + _before(sums)).cast("long").alias(name), "_range", "_place").drop("_range", "_place")
