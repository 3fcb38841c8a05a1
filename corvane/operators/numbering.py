"""Consecutive numbers over a whole table, or within groups, without one task seeing a group, a day or all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.durable import broadcast_below, cut

_IN_PARTITION = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(rows: DataFrame, order: list[str], *, within: list[str] | None = None, name: str = "rn") -> DataFrame:
    """rows with `name`: 0, 1, 2, ... in `order`, in each group of `within`.

    Rows are range-partitioned by group and order, so that a hot group or day
    lies in several tasks; each partition is sorted and counted, a running sum
    over the few partitions gives each its first number, and a group's own
    numbers begin at its smallest.  Ties in order are numbered in any way, so
    order should end in a key.
    """
    groups = within or []
    ranged = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    placed = cut(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", _IN_PARTITION)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__from"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    firsts = counts.select("__part", "__from", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    whole = placed.join(broadcast_below(cut(firsts), 100_000), "__part").withColumn(name, (F.col("__first") + F.col("__id") - F.col("__from")).cast("long"))
    if groups:
        least = cut(whole.groupBy(*groups).agg(F.min(name).alias("__least")).select(*[F.col(g).alias(f"__of_{g}") for g in groups], "__least"))
        match = F.lit(True)
        for g in groups:
            match = match & whole[g].eqNullSafe(F.col(f"__of_{g}"))
        whole = whole.join(broadcast_below(least, 100_000), match).withColumn(name, F.col(name) - F.col("__least"))
    return whole.select(*rows.columns, name)
