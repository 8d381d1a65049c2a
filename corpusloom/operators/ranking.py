"""Places in the order of a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[Column], path: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in ``order``, which should leave no ties.

    Rows are dealt by ranges of the order, whose limits Spark samples, and written to ``path``, as sampling again would
    give others; a row's place is that within its range, after the sizes of those before. The sizes are one row a range.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_within", within).join(offsets, "_range").withColumn(name, F.col("_within") + F.col("_before")).select(*df.columns, name)
