"""Running totals within a key that may hold any part of all rows.

A plain window puts a key in one task.  Here rows are cut into ranges of (keys, order), each range keeps its own running total, and a range's
start is the total of the ranges of its key before it.  Only the first key of a range can have begun in an earlier one, so what
is carried is at most a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables


def _together(fold: Callable, a: Column, b: Column) -> Column:
    return F.greatest(a, b) if fold is F.max else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


class Ranges:
    """Rows of df by ranges of keys and order, of about at_once rows each if that is given; the order has to tell apart the rows of a key as far as results depend on it."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], at_once: int | None = None):
        self.keys, self.order, self.part = keys, order, tables.fresh(df, "__part")
        by = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]
        self.ranges = -(-df.count() // at_once) or 1 if at_once else None
        self.rows = tables.table(df.repartitionByRange(*([self.ranges] if at_once else []), *by).withColumn(self.part, F.spark_partition_id()))

    def running(self, rows: DataFrame, name: str, fold: Callable, value: Column, current: bool = True) -> DataFrame:
        """rows (those of the ranges, maybe with more columns) with name: fold (F.sum or F.max) of value over the key's rows up to each, or before it."""
        keys = [F.col(f"`{c}`") for c in self.keys]
        line = Window.partitionBy(*keys, self.part).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in self.order]).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        totals = rows.groupBy(*keys, self.part).agg(fold(value).alias("__total"))
        earlier = Window.partitionBy(*keys).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumn("__carried", fold("__total").over(earlier)).where("__carried is not null").drop("__total")
        local = rows.withColumn(name, fold(value).over(line))
        both = local.join(F.broadcast(carried), tables.same(local, carried, [*self.keys, self.part]), "left")  # a row for each range at most
        return both.select(*[local[c] for c in rows.columns], _together(fold, local[name], carried["__carried"]).alias(name))
