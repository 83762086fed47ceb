"""Global order without one task: ranges of rows, each sorted where it is, and the numbers of rows before each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.plans.storage import settled


def numbered(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """df with name: 0, 1, 2 and so on in the given order. Rows that the order doesn't tell apart get their numbers in any."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("rows")).orderBy("_part").collect()  # a row for each partition
    before, begin = 0, []
    for r in sizes:
        begin.append((r._part, before))
        before += r.rows
    offsets = spark.createDataFrame(begin, "_part long, _before long")
    own = [c for c in sorted_.columns if c != "_at"]
    return sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*own, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
