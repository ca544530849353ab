"""An atlas as a bundle of tables, and how each family gets there.

The canonical form is a folder of Parquet tables ``cells genes expr embed manifest`` (and ``raw_genes`` if there is a raw part); HDF5 and R
files are exported to it, as their decoders aren't part of Spark.
"""

from __future__ import annotations

import importlib.util
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.sources import catalog, tenx


class UnreadableAtlas(RuntimeError):
    """The atlas's file can't be read here."""


@dataclass
class Bundle:
    """Tables of one atlas: ``cells(cell_id, cell_pos, ...)``, ``genes``, nonzero ``expr``, ``embed(obsm_key, cell_id, vec)``, ``manifest(slot, key, pos)``."""

    name: str
    family: str
    cells: DataFrame
    genes: DataFrame
    expr: DataFrame
    embed: DataFrame
    manifest: DataFrame
    has_raw: bool = False
    raw_genes: DataFrame | None = None
    categories: dict[str, list[str]] = field(default_factory=dict)

    def points(self, key: str, *columns: str) -> DataFrame:
        """Cells with the vector of an embedding, or of the whole expression for the empty key."""
        kept = self.cells.select("cell_id", *[F.col(f"`{c}`") for c in columns])
        return kept.join(self.embed.where(F.col("obsm_key") == key).select("cell_id", "vec") if key else self.dense(), "cell_id")

    def dense(self) -> DataFrame:
        """``(cell_id, vec)`` of the expression, zeros included, in the order of ``gene_pos``."""
        n = self.genes.count()
        at = self.expr.join(self.genes.select("gene_id", "gene_pos"), "gene_id").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_pos", "value"))).alias("m"))
        value = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
        return self.cells.select("cell_id").join(at, "cell_id", "left").select("cell_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(value).alias("vec"))


EMBED = "obsm_key string, cell_id string, vec array<double>"
MANIFEST = "slot string, key string, pos long"


def read(spark: SparkSession, record: dict[str, str]) -> Bundle:
    """The bundle of a catalog record, by its family."""
    kind, path, name = record["Atlas_type"], record["Atlas_path"], record["Atlas_name"]
    exported = os.path.splitext(path)[0] + ".bundle"
    if os.path.isdir(exported):
        return read_bundle(spark, exported, name, kind)
    if kind == catalog.CELLRANGER_OLD:
        return read_old_tenx(spark, path, name)
    need = "h5py" if kind in (catalog.ANNDATA, catalog.CELLRANGER_NEW) else "R"
    if need == "R" or importlib.util.find_spec(need) is None:
        raise UnreadableAtlas(f"{path}: {need} is needed to decode it; export it to {exported}")
    if kind == catalog.CELLRANGER_NEW:
        from cellspan.sources.hdf5 import read_tenx_h5

        return read_tenx_h5(spark, path, name)
    from cellspan.sources.hdf5 import read_h5ad

    return read_h5ad(spark, path, name)


def read_bundle(spark: SparkSession, folder: str, name: str, family: str) -> Bundle:
    def table(t: str, schema: str | None = None) -> DataFrame | None:
        path = os.path.join(folder, f"{t}.parquet")
        return spark.read.parquet(path) if os.path.exists(path) else spark.createDataFrame([], schema) if schema else None

    cells, genes, expr = table("cells"), table("genes"), table("expr", "cell_id string, gene_id string, value double")
    if cells is None or genes is None:
        raise UnreadableAtlas(f"{folder}: a bundle has at least cells.parquet and genes.parquet")
    raw = table("raw_genes")
    return Bundle(name, family, cells, genes, expr, table("embed", EMBED), table("manifest", MANIFEST), raw is not None, raw)


def write_bundle(bundle: Bundle, folder: str) -> None:
    for t in ("cells", "genes", "expr", "embed", "manifest", "raw_genes"):
        if getattr(bundle, t) is not None:
            getattr(bundle, t).write.mode("overwrite").parquet(os.path.join(folder, f"{t}.parquet"))


def with_companions(spark: SparkSession, name: str, family: str, path: str, cells: DataFrame, genes: DataFrame, expr: DataFrame) -> Bundle:
    """Clusterings and projections beside a 10x matrix, attached."""
    beside, embed = tenx.companions(path), spark.createDataFrame([], EMBED)
    for column, file in beside.clusters.items():
        cells = tenx.attach_clusters(cells, tenx.read_indexed(spark, file), column)
    keys = []
    for key, file in beside.projections.items():
        found = tenx.attach_projection(cells, tenx.read_indexed(spark, file), key, key in beside.counted)
        if found is not None:
            embed, keys = embed.unionByName(found), [*keys, key]
    rows = [("obs", c, i) for i, c in enumerate(beside.clusters)] + [("obsm", k, i) for i, k in enumerate(keys)]
    return Bundle(name, family, cells, genes, expr, embed, spark.createDataFrame(rows, MANIFEST))


def read_old_tenx(spark: SparkSession, path: str, name: str) -> Bundle:
    cells, genes, expr = tenx.read_mtx(spark, os.path.dirname(path))
    return with_companions(spark, name, catalog.CELLRANGER_OLD, path, cells, genes, expr)
