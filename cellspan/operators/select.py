"""Choice of the columns and representations that later operators work on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quality columns, and how the two families name them.
QC_DISPLAY = ("violin_plot", "total_counts", "n_genes_by_counts", "pct_counts_mt")
TO_SEURAT = {
    "total_counts": "nCount_RNA", "n_genes_by_counts": "nFeature_RNA", "pct_counts_mt": "percent.mito",
    "pct_counts_ribo": "percent.ribo", "violin_plot": "violin_plot",
}
FROM_SEURAT = {"nCount_RNA": "total_counts", "nFeature_RNA": "n_genes_by_counts", "percent.mito": "pct_counts_mt", "percent.ribo": "pct_counts_ribo"}
#: A representation by preference: a UMAP, else a t-SNE, else the expression itself.
UMAP, TSNE = r"^.*umap*.", r"^.*tsne*."


def qc_keys(columns: list[str], wanted: tuple[str, ...] = QC_DISPLAY) -> list[str]:
    """Wanted quality columns that exist, in the table's order."""
    return [c for c in columns if c in wanted]


def qc_keys_seurat(columns: list[str], wanted: tuple[str, ...] = QC_DISPLAY) -> list[str]:
    """Wanted quality columns by their names in a Seurat export, in the wanted order; names without a translation are skipped."""
    return [TO_SEURAT[w] for w in wanted if TO_SEURAT.get(w) in columns]


def annotation_keys(cells: DataFrame, patterns, categories: dict[str, list[str]] | None = None, dedupe: bool = False, missing_drops: bool = True) -> DataFrame:
    """``(key, n_categories)`` of the viable annotation columns, sorted by name.

    Viable: the name contains a pattern, the column is categorical (a string), no value is missing, and there is not exactly
    one category (the literal ``nan`` doesn't count).  A name that several patterns match appears several times, unless
    ``dedupe``.  ``categories`` gives declared ones, unused ones included; a column not listed there has those that it holds.
    With ``missing_drops=False`` (Seurat) missing values are allowed.
    """
    strings = [n for n, kind in cells.dtypes if kind == "string"]
    hits = [(n, 1 if dedupe else sum(p in n for p in patterns)) for n in strings if any(p in n for p in patterns)]
    if not hits:
        return cells.sparkSession.createDataFrame([], "key string, n_categories long")
    declared = categories or {}
    facts = []
    for n, _ in hits:
        c = F.col(f"`{n}`")
        size = F.lit(len([x for x in declared[n] if x != "nan"])) if n in declared else F.count_distinct(F.when(c != "nan", c))
        facts += [F.count_if(c.isNull()).alias(f"missing {n}"), size.cast("long").alias(f"categories {n}")]
    one = cells.agg(*facts)  # all columns in one pass, one row
    rows = F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(f"`missing {n}`").alias("missing"), F.col(f"`categories {n}`").alias("n_categories")) for n, times in hits for _ in range(times)
    ])
    found = one.select(F.explode(rows).alias("r")).select("r.*").where("n_categories <> 1")
    return (found.where("missing = 0") if missing_drops else found).select("key", "n_categories").orderBy("key")


def embedding_keys(manifest: DataFrame) -> DataFrame:
    """``(atlas, key, pos)`` of all embeddings, in storage order."""
    return manifest.where("slot = 'obsm'").select("atlas", "key", "pos").orderBy("atlas", "pos")


def representation(manifest: DataFrame) -> DataFrame:
    """``(atlas, obsm_key)`` for every atlas of the manifest: its first UMAP, else its first t-SNE, else the empty string."""
    key, pos = F.when(F.col("slot") == "obsm", F.col("key")), F.col("pos")

    def first(pattern: str) -> Column:
        return F.min_by(F.when(key.rlike(pattern), key), F.when(key.rlike(pattern), pos))

    return manifest.groupBy("atlas").agg(F.coalesce(first(UMAP), first(TSNE), F.lit("")).alias("obsm_key"))


def representation_of(keys: list[str]) -> str:
    """The same choice for a list of keys in storage order."""
    for pattern in (UMAP, TSNE):
        for k in keys:
            if re.match(pattern, k):
                return k
    return ""
