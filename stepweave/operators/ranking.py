"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import stored

def global_rank(df: DataFrame, order: Sequence[Column | str], to: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds to: 1, 2, ... in the order given, which has to be without ties.

    Rows are dealt into ranges, counted by range and numbered within; a range begins where those before it end. The ranged rows
    are written first: bounds are sampled anew by each plan that deals them. The only table that is in one place has one row for
    each range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", within).join(F.broadcast(starts), "_range").withColumn(to, (F.col("_own") + F.col("_start")).cast("bigint")).drop("_own", "_start", "_range")  # starts has a row for each range
