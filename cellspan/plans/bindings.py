"""Roles of the driver's tables: suppliers are cells, parts are genes, line items are expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import qc

MT, RIBO = ("red",), ("blue", "cold")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("celltype"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("cell_id"), F.col("s_suppkey").alias("cell_pos"), "celltype"
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("gene_pos"), F.col("p_name").alias("gene_name"))
    return qc.gene_classes(part, mt=MT, ribo=RIBO)


def branded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes that many others share their names with."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_pos"), F.col("p_brand").alias("gene_name"))


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
    return items.agg(F.sum("l_quantity").alias("value"))


def typed_expr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with their nation key as type, entries by 20 genes, and the genes."""
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("celltype"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 20).alias("gene"), F.col("l_quantity").alias("value"))
    names = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("gene")).distinct()
    return found, items, names


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    return found.select("vec_id", "label", (F.col("label") % 3).alias("label_mod"), vec.alias("vec"), F.slice(vec, 1, 2).alias("low"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells with annotation columns: two viable ones, one with missing values, one of a single category, one number."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_type").alias("celltype"),
        F.col("p_brand").alias("seurat_clusters"),
        F.when(F.col("p_size") > 1, F.col("p_type")).alias("leiden"),
        F.lit("one").alias("louvain"),
        F.col("p_size").alias("cell_type_size"),
        F.col("p_name").alias("other"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(atlas, slot, key, pos)``: regions are atlases, nations are keys of five slots."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    slot = F.element_at(F.array(*map(F.lit, ("obs", "obsm", "var", "varm", "uns"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("atlas"), slot.alias("slot"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("pos")
    )


def embeddings_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with embeddings named by their nations' keys."""
    kind = F.element_at(F.array(*map(F.lit, ("X_pca", "X_tsne", "X_umap", "X_scvi"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).where("n_nationkey % 7 > 2").select(
        F.col("r_name").alias("atlas"), F.lit("obsm").alias("slot"), F.concat_ws("_", kind, F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("long").alias("pos")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of every family, and some of none, made from page numbers."""
    k = F.col("page_id")
    end = F.element_at(
        F.array(*map(F.lit, (".h5ad", "/outs/filtered_feature_bc_matrix.h5", "/outs/filtered_gene_bc_matrices/hg19/matrix.mtx", ".rds", "/notes.txt"))), (k % 5 + 1).cast("int")
    )
    found = table(spark, sf_dir, "pages")
    return found.select(k.alias("seq"), F.concat(F.lit("/data/run"), (k % 7).cast("string"), F.lit("/atlas"), (k % 60).cast("string"), end).alias("path"))
