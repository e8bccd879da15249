"""Positions in a total order, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.storage import cut


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """Rows with their place from 1 in an order. They are sorted by ranges, each range numbered in its
    own task, and the ranges' sizes, one row each, give the first number of each."""
    columns = rows.columns
    placed = cut(rows.orderBy(*order).withColumn("m__", F.monotonically_increasing_id()))
    part = F.shiftright("m__", 33)
    sizes = placed.groupBy(part.alias("p__")).agg(F.count("*").alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(sizes.select("p__", before.alias("o__")))  # one row for each range
    return placed.join(first, part == F.col("p__")).select(*columns, (F.col("o__") + F.col("m__").bitwiseAND((1 << 33) - 1) + 1).alias(name))
