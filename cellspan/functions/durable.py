"""Tables that outlive executors, for plans that must see the same rows twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made and set only where none is named and all runs on one machine."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cellspan-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A place for a new folder that all executors see."""
    return f"{shared_dir(spark)}/cellspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` = 1..n in the given order, without one task that sees all rows.

    Rows are range-partitioned and sorted, each partition numbers its own, and starts after the rows of the partitions before:
    one row a partition is summed up for that.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = written(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    split = place.withColumn("__part", F.shiftright("__at", 33).cast("int")).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = split.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))  # a row for each partition
    return split.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__in") + 1).drop("__at", "__part", "__in", "__start")
