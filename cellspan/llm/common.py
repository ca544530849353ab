"""Helpers shared by the corpus operators: durable intermediate tables, input columns, small Arrow tools."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.functions.durable import shared_dir


def own_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables, in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/cellspan/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; with ``by`` in a folder for each value of that column.

    It cuts the lineage: a lost executor costs the reading tasks only, and both branches of a plan
    that use the table see the very same rows.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    schema = T.StructType([f for f in df.schema if f.name != by] + [f for f in df.schema if f.name == by])
    return df.sparkSession.read.schema(schema).parquet(path)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for working columns that ``df`` has no column of, whatever their case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return tuple(found)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; those that hold maps go in as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; ``CELLSPAN_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("CELLSPAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(rows: list[tuple], schema, weight=None, limit: int = 8 << 20):
    """Yield Arrow batches of ``rows`` whose summed ``weight`` stays near ``limit`` bytes."""
    import pyarrow as pa

    start, total = 0, 0
    for i, row in enumerate(rows):
        total += weight(row) if weight else 64
        if total >= limit:
            yield _batch(pa, rows[start : i + 1], schema)
            start, total = i + 1, 0
    if start < len(rows):
        yield _batch(pa, rows[start:], schema)


def _batch(pa, rows, schema):
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def materialise_bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """Like :func:`materialise`, dealt into buckets by ``column``, so that grouping by it later needs no shuffle."""
    spark, table = df.sparkSession, f"cellspan_{uuid.uuid4().hex}"
    path = f"{own_folder(spark)}/{name}-{table}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name only: the files of a table with a path of its own stay
    return found


def forget(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; only once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
