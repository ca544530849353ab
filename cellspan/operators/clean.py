"""Normalisation of an atlas: unique gene names, and integer cluster columns as categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Parts of the names of annotation columns.
OBS_CLUSTERS = (
    "cell_type", "CellType", "celltype", "ann_finest_level", "cellranger_graphclust", "cellranger_kmeans",
    "seurat_clusters", "RNA_snn_res.0.5", "louvain", "leiden", "orig.ident",
)


def names_unique(genes: DataFrame, name_col: str = "gene_name") -> bool:
    found = genes.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(name_col), F.lit(""))).alias("d")).first()
    return found.n == found.d


def unique_names(genes: DataFrame, name_col: str = "gene_name", pos_col: str = "gene_pos", into: str = "unique_name") -> DataFrame:
    """``genes`` with a unique name: the first bearer keeps it, later ones get ``-1``, ``-2`` and so on.

    Numbers that another gene's name already has are skipped.  All is one plan: a name's taken numbers are collected from names
    of the form ``<name>-<number>``, and its later bearers get the numbers that are left, in order of position.
    """
    stem = F.regexp_extract(name_col, r"^(.*)-([1-9]\d{0,8})$", 1)
    taken = (
        genes.where(F.col(name_col).rlike(r"^.*-[1-9]\d{0,8}$"))
        .groupBy(stem.alias("__stem"))
        .agg(F.collect_set(F.regexp_extract(name_col, r"-(\d+)$", 1).cast("int")).alias("__taken"))
    )
    of_name = Window.partitionBy(name_col)
    numbered = genes.withColumn("__k", F.row_number().over(of_name.orderBy(pos_col)) - 1).withColumn("__n", F.count("*").over(of_name))
    met = numbered.join(taken, F.col(name_col) == F.col("__stem"), "left")
    free = F.array_except(F.sequence(F.lit(1), F.col("__n").cast("int") + F.size(F.coalesce("__taken", F.array().cast("array<int>")))), F.coalesce("__taken", F.array().cast("array<int>")))
    name = F.when(F.col("__k") == 0, F.col(name_col)).otherwise(F.concat_ws("-", F.col(name_col), F.element_at(free, F.greatest(F.col("__k"), F.lit(1)).cast("int")).cast("string")))
    return met.withColumn(into, name).drop("__k", "__n", "__stem", "__taken")


def positional_names(genes: DataFrame, name_col: str = "gene_name", pos_col: str = "gene_pos") -> DataFrame:
    """Every name followed by ``_`` and its position (from 0)."""
    return genes.withColumn(name_col, F.concat_ws("_", name_col, F.col(pos_col).cast("string")))


def clean_genes(genes: DataFrame, raw: bool = False) -> DataFrame:
    """Names made unique, by suffixes at first and by positions if that fails; duplicated raw names go by position at once."""
    if names_unique(genes):
        return genes
    if raw:
        return positional_names(genes)
    for _ in range(2):
        genes = unique_names(genes, into="__unique").withColumn("gene_name", F.col("__unique")).drop("__unique")
        if names_unique(genes):
            return genes
    return positional_names(genes)


def categorical_clusters(cells: DataFrame, patterns: tuple[str, ...] = OBS_CLUSTERS) -> tuple[DataFrame, list[str]]:
    """Integer columns whose names contain a pattern become strings; returns the table and the names of those columns."""
    changed = [n for n, kind in cells.dtypes if kind in ("int", "bigint") and any(p in n for p in patterns)]
    return cells.withColumns({n: F.col(f"`{n}`").cast("string") for n in changed}) if changed else cells, changed
