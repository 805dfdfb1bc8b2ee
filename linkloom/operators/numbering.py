"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import cut_lineage


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in the given order: ranges are sorted in parallel and shifted by the ranges' sizes.

    The ranges are materialised once, as a range partitioning isn't the same when it is made again.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    kept = cut_lineage(ranged)
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each task
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", shift.alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return kept.withColumn("_i", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_i") + F.col("_shift")).drop("_range", "_i", "_shift")


def bounded_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All rows if there are at most ``most``, else a share of them chosen by the hash of ``keys``, so that there are hardly ever more.

    The share is four standard deviations below the bound; no task sees more than its own rows.
    """
    kept = cut_lineage(rows)
    n = kept.count()
    if n <= most:
        return kept
    share = max(0.0, most - 4 * most**0.5) / n
    return kept.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < int(share * (1 << 31)))
