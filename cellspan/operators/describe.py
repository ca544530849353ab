"""Summary and structure tables of atlases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("obs", "obsm", "var", "varm", "uns")
SUMMARY = ("AtlasFileType", "NbCells", "NbGenes", "AnnData.raw", "AnnData.X", "File_extension", "File_path")


def summary(catalog: DataFrame, cells: DataFrame, genes: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One row an atlas.  ``cells`` and ``genes`` have a column ``atlas``; ``flags`` is ``(atlas, has_raw, has_x)``.

    ``File_extension`` is the atlas's name, but for Seurat the true extension; Seurat atlases have no raw and always an X.
    """
    seurat = F.col("Atlas_type") == "Seurat"
    found = catalog.join(cells.groupBy(F.col("atlas").alias("c")).agg(F.count("*").alias("NbCells")), F.col("Atlas_name") == F.col("c"), "left")
    found = found.join(genes.groupBy(F.col("atlas").alias("g")).agg(F.count("*").alias("NbGenes")), F.col("Atlas_name") == F.col("g"), "left")
    raw, x = F.lit(False), F.lit(True)
    if flags is not None:
        found = found.join(flags.withColumnRenamed("atlas", "f"), F.col("Atlas_name") == F.col("f"), "left")
        raw, x = (F.when(seurat, d).otherwise(F.coalesce(F.col(c), d)) for c, d in (("has_raw", raw), ("has_x", x)))
    return found.select(
        F.col("Atlas_type").alias("AtlasFileType"),
        F.coalesce("NbCells", F.lit(0)).alias("NbCells"),
        F.coalesce("NbGenes", F.lit(0)).alias("NbGenes"),
        raw.alias("AnnData.raw"),
        x.alias("AnnData.X"),
        F.when(seurat, F.col("Atlas_extension")).otherwise(F.col("Atlas_name")).alias("File_extension"),
        F.col("Atlas_path").alias("File_path"),
    )


def _codes(keys: Column) -> Column:
    return F.concat(F.lit("<code>"), F.array_join(keys, "</code><br><code>"), F.lit("</code>"))


def structure(manifest: DataFrame, empty_slots: tuple[str, ...] = ()) -> DataFrame:
    """``(atlas, atlas_obs, obsm, var, varm, uns)``: each slot's keys in order, each in a ``code`` element.

    ``empty_slots`` are shown empty whatever the manifest holds (``var`` and ``varm`` of Seurat atlases).
    """
    def keys(slot: str) -> Column:
        here = F.collect_list(F.when((F.col("slot") == slot) & F.lit(slot not in empty_slots), F.struct("pos", "key")))
        return F.transform(F.array_sort(here), lambda x: x["key"])

    return manifest.groupBy("atlas").agg(*[_codes(keys(s)).alias("atlas_obs" if s == "obs" else s) for s in SLOTS])
