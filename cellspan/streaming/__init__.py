"""Streams: atlases that arrive in a folder are classified as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.sources import catalog


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of catalog rows; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
    return catalog.classify(found.select(F.regexp_replace("path", "^file:/*", "/").alias("path")))


def upsert_batch(into: str):
    """Function for ``foreachBatch`` that puts a batch's records into the folder ``into``, as ``batch=<number>``.

    Nothing that is there is read or replaced but the batch's own folder: a batch that is replayed writes the same rows again, and one that broke off
    is written anew when it is replayed.  :func:`read_catalog` gives one row for each name.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{into}/batch={number}")

    return put


def read_catalog(spark: SparkSession, into: str) -> DataFrame:
    """The catalog of all batches: of each name the latest batch's record, and ``first_seq``, the batch that it came with first.

    Within a batch the record whose path sorts last wins, as in a crawl.
    """
    found = spark.read.schema(f"{', '.join(f'{c} string' for c in catalog.HEADER)}, batch long").parquet(into)
    latest = catalog.upsert(found.withColumn("seq", F.struct("batch", "Atlas_path")))
    return latest.withColumn("first_seq", F.col("first_seq.batch"))
