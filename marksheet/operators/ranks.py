"""Exact positions over a whole table, without a window that gathers it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.io import settled


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "position", ties: bool = False, parts: int | None = None) -> DataFrame:
    """The row number of every row in ``order`` from 1, or its rank where ``ties`` share one.

    Rows are dealt by ranges of the order, counted for each range, and numbered inside theirs after
    those before; only one number a range is gathered. Equal rows share a range, so ranks need no
    second look at borders. Ranges are drawn from a sample, so they are written down before they are
    read twice.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt = settled(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row a range.
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    place = (F.rank() if ties else F.row_number()).over(inside)
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)
