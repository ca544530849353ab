"""Discovery of atlases in a folder tree, their catalog, and the layout of output files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Families, their file endings and the catalog's columns.
ANNDATA, CELLRANGER_NEW, CELLRANGER_OLD, SEURAT = "AnnData", "Cellranger >= v3", "Cellranger < v3", "Seurat"
NEW_FILE, OLD_FILE = "filtered_feature_bc_matrix.h5", "matrix.mtx"
ENDINGS = {"scanpy": (".h5ad",), "cellranger": (NEW_FILE, OLD_FILE), "seurat": (".rds",)}
HEADER = ("Atlas_name", "Atlas_type", "Atlas_extension", "Atlas_path")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in HEADER])
WORKING = "cellspan_files"
FOLDERS = ("summary", "adata", "qc", "violin", "umap", "tsne", "cluster", "annotation", "dimred", "specificity", "temp")
LISTS = {"scanpy": "List_scanpy.csv", "cellranger": "List_cellranger.csv", "seurat": "List_seurat.csv"}
TSV, QC_FIGURE, UMAP_FIGURE, TSNE_FIGURE = ".tsv", "_qc.svg", "_umap.svg", "_tsne.svg"


def crawl(spark: SparkSession, path: str, family: str) -> DataFrame:
    """``(path)`` of all files below ``path`` that end like the family's; contents are not read, empty files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    ends = F.lit(False)
    for e in ENDINGS[family]:
        ends = ends | F.col("path").endswith(e)
    return found.where(ends)


def _name_of_file(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def classify(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Catalog rows of paths of any family; other paths, and 10x paths with too few parts for a name, are dropped.

    A 10x atlas is named by the folder above ``outs``: the third part from the end for the current layout, the fifth for the old one.
    """
    path = F.col(path_col)
    parts = F.split(path, "/")
    kind = (
        F.when(path.endswith(".h5ad"), ANNDATA).when(path.endswith(NEW_FILE), CELLRANGER_NEW).when(path.endswith(OLD_FILE), CELLRANGER_OLD).when(path.endswith(".rds"), SEURAT)
    )
    name = (
        F.when(kind == CELLRANGER_NEW, F.try_element_at(parts, F.lit(-3))).when(kind == CELLRANGER_OLD, F.try_element_at(parts, F.lit(-5))).otherwise(_name_of_file(path))
    )
    found = paths.where(kind.isNotNull())
    return found.select(name.alias("Atlas_name"), kind.alias("Atlas_type"), _extension(path).alias("Atlas_extension"), path.alias("Atlas_path")).where("Atlas_name IS NOT NULL")


def upsert(records: DataFrame, order_col: str = "seq") -> DataFrame:
    """One row for each name: the last record's values at the first record's place (``first_seq``)."""
    last = F.max_by(F.struct(*[c for c in HEADER if c != "Atlas_name"]), order_col)
    found = records.groupBy("Atlas_name").agg(last.alias("r"), F.min(order_col).alias("first_seq"))
    return found.select("Atlas_name", "r.*", "first_seq")


def list_atlases(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Crawl, classify, upsert by name in path order, and save the family's list; returns it."""
    make_folders(path)
    found = classify(crawl(spark, path, family)).withColumn("seq", F.row_number().over(Window.orderBy("Atlas_path")))  # file listing: one row an atlas
    rows = upsert(found).orderBy("first_seq").select(*HEADER).toPandas()
    rows.to_csv(list_path(path, family), index=False)
    return spark.createDataFrame(rows, SCHEMA) if len(rows) else spark.createDataFrame([], SCHEMA)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """All saved lists with a column ``family``; a list that isn't there is empty."""
    found = spark.createDataFrame([], SCHEMA).withColumn("family", F.lit(""))
    for family in LISTS:
        file = list_path(path, family)
        if os.path.exists(file):
            found = found.unionByName(spark.read.schema(SCHEMA).csv(file, header=True).withColumn("family", F.lit(family)))
    return found


class UnknownAtlas(LookupError):
    """No saved list has an atlas of this name."""


def find(catalog: DataFrame, name: str) -> dict[str, str]:
    """The atlas of a name; where several families have it, AnnData comes first, then Cellranger, then Seurat."""
    rank = F.array_position(F.array(*map(F.lit, LISTS)), F.col("family"))
    row = catalog.where(F.col("Atlas_name") == name).orderBy(rank).select(*HEADER).first()
    if row is None:
        raise UnknownAtlas(f"no atlas named {name} in the saved lists")
    return row.asDict()


def working_dir(path: str) -> str:
    return os.path.join(path, WORKING)


def folder(path: str, name: str) -> str:
    return os.path.join(working_dir(path), name)


def make_folders(path: str) -> None:
    for name in FOLDERS:
        os.makedirs(folder(path, name), exist_ok=True)


def list_path(path: str, family: str) -> str:
    return os.path.join(working_dir(path), LISTS[family])


def file_path(path: str, folder_name: str, atlas: str, extension: str = TSV) -> str:
    return os.path.join(folder(path, folder_name), atlas + extension)


def report_path(path: str, kind: str) -> str:
    return os.path.join(working_dir(path), f"report_{kind}.html")
