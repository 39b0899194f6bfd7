"""Numbers in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_path


def numbered(rows: DataFrame, keys: list[str], group: str | None = None, number: str = "number") -> DataFrame:
    """rows with number, from 0 without gaps in the order of keys, in each group by itself if there is one.

    Rows are sorted by ranges over all tasks and written to the shared folder, and each task
    numbers its own from where the ones before it end; so a group of nearly all rows is no
    window of one task. Rows with equal keys may be in any order.
    """
    spark = rows.sparkSession
    order = [*([group] if group else []), *keys]
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    folder = shared_path(spark, "sorted")
    at.write.parquet(folder)
    at = spark.read.schema(at.schema).parquet(folder).withColumn("__task", F.shiftright("__at", 33)).withColumn("__group", F.col(group) if group else F.lit(0))
    counts = at.groupBy("__group", "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a row for each task and group
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__group").alias("__g"), F.col("__task").alias("__t"), "__first", before.alias("__before"))
    joined = at.join(starts, (F.col("__task") == F.col("__t")) & F.col("__group").eqNullSafe(F.col("__g")))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias(number))
