"""Running counts and previous values along a key, in two levels.

A plain window orders a whole key in one task.  Here a key is cut into buckets
of its integer order column; only one row per bucket travels along the key, so
a key that holds a large share of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


WIDTH = 4096


def running_before(
    rows: DataFrame, keys: Sequence[str], order: str, total: str, name: str, width: int = WIDTH
) -> DataFrame:
    """Sum of ``total`` over earlier rows of the same key."""
    bucketed = rows.withColumn("_bucket", F.expr(f"`{order}` div {width}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum(total).alias("_t"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_t").over(along), zero).alias("_base"))
    )
    return (
        bucketed.withColumn("_in", F.coalesce(F.sum(total).over(inside), zero))
        .join(totals, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_base", "_in", "_bucket")
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """Dense row number from 0 along a key."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running_before(one, keys, order, "_one", name, width).drop("_one")


def with_previous(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int = WIDTH
) -> DataFrame:
    """Value of the previous row of the same key, null for the first."""
    bucketed = rows.withColumn("_bucket", F.expr(f"`{order}` div {width}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    ends = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.max_by(value, order).alias("_last"))
        .select(*keys, "_bucket", F.lag("_last").over(along).alias("_carried"))
    )
    return (
        bucketed.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_lag", F.lag(value).over(inside))
        .join(ends, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_first", "_lag", "_carried", "_bucket")
    )
