"""Run options as YAML files, and marker lists as tables."""

from __future__ import annotations

from argparse import Namespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_options(path: str, into: Namespace | None = None) -> Namespace:
    """Options of a YAML file; those given in ``into`` are replaced by the file's."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    options = Namespace(**vars(into)) if into else Namespace()
    for key, value in found.items():
        setattr(options, key, value)
    return options


def save_options(options: Namespace, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(vars(options), f, sort_keys=True)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """``(celltype, gene, pos)`` of a CSV or TSV with columns ``celltype`` and ``gene``, in the file's order; incomplete rows are left out."""
    sep = "\t" if path.endswith((".tsv", ".txt")) else ","
    rows = spark.read.csv(path, header=True, sep=sep).select("celltype", "gene").where("celltype IS NOT NULL AND gene IS NOT NULL")
    # A marker list is small; its order is that of one file's lines.
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    return numbered.select("celltype", "gene", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("pos"))
