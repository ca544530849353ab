"""10x Genomics outputs: Matrix Market folders, cluster and projection CSV files, old and current layouts."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mtx(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cells(cell_id, cell_pos)``, ``genes(gene_id, gene_pos, gene_name)`` and ``expr(cell_id, gene_id, value)`` of a folder.

    The file has a line for each nonzero entry (gene, cell, value; counted from 1), after comments and a line of sizes; so entries
    are read as text in parallel, and positions become names by two joins with small tables.  The line of sizes is told from entries by its place.
    Another number of entries than it says, or an entry outside the sizes, raises :class:`BrokenMatrix`.
    """
    genes_file = next((f for f in ("genes.tsv", "features.tsv") if os.path.exists(os.path.join(folder, f))), "genes.tsv")
    genes = _lines(spark, os.path.join(folder, genes_file)).select(
        F.col("pos").alias("gene_pos"), F.split("value", "\t")[0].alias("gene_id"), F.coalesce(F.try_element_at(F.split("value", "\t"), F.lit(2)), F.split("value", "\t")[0]).alias("gene_name")
    )
    cells = _lines(spark, os.path.join(folder, "barcodes.tsv")).select(F.trim("value").alias("cell_id"), F.col("pos").alias("cell_pos"))
    parts = F.split(F.trim("value"), r"\s+")
    lines = _matrix_lines(spark, os.path.join(folder, "matrix.mtx"))
    head = lines.where("block = 0").agg(F.min("at").alias("at"), F.min_by(F.trim("value"), "at").alias("sizes")).first()
    if head.sizes is None:
        raise BrokenMatrix(f"{folder}: matrix.mtx has no line of sizes")
    entries = lines.where(~((F.col("block") == 0) & (F.col("at") == head["at"]))).select(
        (parts[0].cast("long") - 1).alias("gene_pos"), (parts[1].cast("long") - 1).alias("cell_pos"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1")).cast("double").alias("value")
    )
    sizes = [int(x) for x in head.sizes.split()]
    found = entries.agg(F.count("*").alias("n"), F.max("gene_pos").alias("genes"), F.max("cell_pos").alias("cells")).first()
    if len(sizes) != 3 or found.n != sizes[2] or (found.genes or 0) >= max(1, sizes[0]) or (found.cells or 0) >= max(1, sizes[1]):
        raise BrokenMatrix(f"{folder}: sizes {head.sizes}, but {found.n} entries up to gene {(found.genes or 0) + 1} and cell {(found.cells or 0) + 1}")
    expr = entries.join(genes.select("gene_pos", "gene_id"), "gene_pos").join(cells, "cell_pos").select("cell_id", "gene_id", "value")
    return cells, genes, expr


class BrokenMatrix(ValueError):
    """A matrix file that contradicts its own line of sizes."""


def _matrix_lines(spark: SparkSession, file: str) -> DataFrame:
    """``(value, block, at)`` of the lines that are no comments: where the file's split begins, and a number that grows within it."""
    lines = spark.read.text(file).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))


def _lines(spark: SparkSession, file: str) -> DataFrame:
    """``(pos, value)`` of a text file's lines, numbered from 0 (as one file's splits are read in order)."""
    return spark.read.text(file, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", "\r", ""), F.lit("\n")), "\n"))).select(F.col("pos").cast("long").alias("pos"), F.col("col").alias("value"))


@dataclass(frozen=True)
class Companions:
    """Files beside a matrix: clusterings by column name, projections by key, and those that need as many rows as cells."""

    clusters: dict[str, str] = field(default_factory=dict)
    projections: dict[str, str] = field(default_factory=dict)
    counted: frozenset[str] = frozenset()


def companions(matrix_path: str) -> Companions:
    """What lies beside a matrix file, by its layout."""
    return _old_layout(matrix_path) if matrix_path.endswith("matrix.mtx") else _current_layout(matrix_path)


def _below(folder: str) -> list[str]:
    return sorted(os.path.join(root, f) for root, _, files in os.walk(folder) for f in files)


def _current_layout(matrix_path: str) -> Companions:
    """Clusterings and projections that aren't of the ATAC part; files of a combined layout take precedence."""
    analysis = os.path.join(os.path.dirname(matrix_path), "analysis")
    files = _below(analysis)
    clusters, projections = {}, {}
    above = [(f, os.path.dirname(os.path.dirname(f)), os.path.basename(os.path.dirname(f))) for f in files if os.path.basename(f) == "clusters.csv"]
    graph = [f for f, parent, own in above if own.endswith("graphclust") and not parent.endswith("atac")]
    if graph:
        clusters["cellranger_graphclust"] = graph[-1]
    ten = [f for f, _, own in above if "kmeans_10" in own]
    five = [f for f, parent, own in above if f"gex{os.sep}kmeans_5" in os.path.join(parent, own)]
    if ten or five:
        clusters["cellranger_kmeans_10" if ten else "cellranger_kmeans_5"] = (ten or five)[0]
    for kind in ("umap", "tsne", "pca"):
        mine = [f for f in files if f.startswith(os.path.join(analysis, kind) + os.sep) and f.endswith("projection.csv") and not os.path.dirname(f).endswith("atac")]
        if mine:
            projections[f"X_{kind}"] = mine[-1]
    combined = os.path.join(analysis, "dimensionality_reduction", "gex")
    if os.path.isdir(combined):
        projections = {f"X_{k}": p for k in ("umap", "tsne", "pca") if os.path.exists(p := os.path.join(combined, f"{k}_projection.csv"))}
    return Companions(clusters, projections)


def _old_layout(matrix_path: str) -> Companions:
    out = os.path.dirname(os.path.dirname(os.path.dirname(matrix_path)))
    files = _below(out)
    clusters = {}
    graph = [f for f in files if os.path.basename(f) == "clusters.csv" and os.path.basename(os.path.dirname(f)).endswith("graphclust")]
    if graph:
        clusters["cellranger_graphclust"] = graph[-1]
    ks = [(int(m[1]), f) for f in files if (m := re.search(r"kmeans/(\d+)_clusters/clusters\.csv$", f.replace(os.sep, "/"))) and 3 <= int(m[1]) <= 15]
    if ks:
        k, file = max(ks)
        clusters[f"cellranger_kmeans_{k}"] = file
    found = {f"X_{k}": p for k in ("umap", "tsne", "pca") if os.path.exists(p := os.path.join(out, "analysis_csv", k, "projection.csv"))}
    return Companions(clusters, found, frozenset(("X_tsne", "X_pca")))


def read_indexed(spark: SparkSession, file: str) -> DataFrame:
    """A CSV with a header; its first column becomes ``cell_id``."""
    found = spark.read.csv(file, header=True, inferSchema=True)
    return found.withColumnRenamed(found.columns[0], "cell_id")


def attach_clusters(cells: DataFrame, clusters: DataFrame, name: str, cluster_col: str = "Cluster") -> DataFrame:
    """``cells`` with a column of clusters by barcode; cells that the file lacks get NULL."""
    return cells.join(clusters.select("cell_id", F.col(cluster_col).alias(name)), "cell_id", "left")


class BarcodeMismatch(ValueError):
    """A projection's barcodes aren't those of the cells."""


def attach_projection(cells: DataFrame, projection: DataFrame, key: str, only_if_counted: bool = False) -> DataFrame | None:
    """``(obsm_key, cell_id, vec)`` of a projection.

    With ``only_if_counted`` a projection of another number of rows is left out (None); otherwise barcodes that differ raise an error.
    """
    dims = [c for c in projection.columns if c != "cell_id"]
    made = projection.select(F.lit(key).alias("obsm_key"), "cell_id", F.array(*[F.col(f"`{c}`").cast("double") for c in dims]).alias("vec"))
    if only_if_counted and made.count() != cells.count():
        return None
    apart = made.select("cell_id", F.lit(1).alias("b")).join(cells.select("cell_id", F.lit(1).alias("a")), "cell_id", "full").where("a IS NULL OR b IS NULL")
    if not apart.isEmpty():
        raise BarcodeMismatch(f"{key}: barcodes differ from those of the cells")
    return made
