"""Places in a total order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import held


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1. Sorted ranges are kept once, so that places and sizes come from the same rows;
    only the ranges' sizes, one for each, are added up in a row. Rows equal in ``order`` may take each other's places."""
    parts = held(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
