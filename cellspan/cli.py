"""Commands: ``python -m cellspan.cli list_scanpy|list_cellranger|list_seurat|html_report PATH`` and ``... PROCESS ATLAS PATH``."""

from __future__ import annotations

import argparse
import logging
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellspan.operators import clean, describe, qc, registry, report, select, specificity, specificity_figures
from cellspan.sources import bundle, catalog
from cellspan.sources.options import load_options, read_markers

logger = logging.getLogger("cellspan")
VERSION = "0.1.0"
LISTS = {"list_scanpy": "scanpy", "list_cellranger": "cellranger", "list_seurat": "seurat"}
PROCESSES = ("summary", "qc", "metric_cluster", "metric_annot", "metric_dimred", "specificity")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellspan", description="Quality tables of single-cell atlases.")
    top.add_argument("process", choices=[*LISTS, "html_report", *PROCESSES])
    top.add_argument("where", nargs="+", help="PATH, or ATLAS and PATH")
    top.add_argument("-d", "--debug", action="store_true")
    top.add_argument("-v", "--version", action="version", version=f"cellspan {VERSION}")
    top.add_argument("--qc_display", nargs="+", default=list(select.QC_DISPLAY))
    top.add_argument("--plot_celllimit", type=int, default=0, help="cells in tables and figures at most; 0: all")
    top.add_argument("--obs_cluster", nargs="+", default=list(clean.OBS_CLUSTERS))
    top.add_argument("--options", help="YAML file of options that replace those given here")
    top.add_argument("--partition_key", help="annotation column of the cell types; the first viable one unless given")
    top.add_argument("--markers", help="CSV or TSV with columns celltype and gene")
    for family in ("cluster", "annot", "dimred"):
        top.add_argument(f"--metric_{family}", nargs="*", default=registry.DEFAULTS[family], help=f"of {', '.join(registry.names(family))}")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.options:
        args = load_options(args.options, args)
    logging.basicConfig(format="%(levelname)s %(message)s")
    logger.setLevel(logging.DEBUG if args.debug else logging.INFO)
    path = os.path.abspath(args.where[-1])
    if args.process == "html_report":
        for kind in ("qc", "reductions"):
            report.write_reports(path, kind)
        return
    spark = spark or SparkSession.builder.appName("cellspan").getOrCreate()
    if args.process in LISTS:
        found = catalog.list_atlases(spark, path, LISTS[args.process])
        logger.info("%d %s files found", found.count(), LISTS[args.process])
        return
    if len(args.where) < 2:
        raise SystemExit("an atlas name and a path are needed")
    run(spark, args, args.where[0], path)


def run(spark: SparkSession, args: argparse.Namespace, name: str, path: str) -> None:
    """One process for one atlas of the saved lists."""
    catalog.make_folders(path)
    record = catalog.find(catalog.read_lists(spark, path), name)
    atlas = bundle.read(spark, record)
    seurat = atlas.family == catalog.SEURAT
    if not seurat:
        atlas.genes = clean.clean_genes(atlas.genes)
        if atlas.raw_genes is not None:
            atlas.raw_genes = clean.clean_genes(atlas.raw_genes, raw=True)
        atlas.cells, _ = clean.categorical_clusters(atlas.cells)
    keys = [r.key for r in select.annotation_keys(atlas.cells, args.obs_cluster, atlas.categories, missing_drops=not seurat).collect()]
    embeddings = [r.key for r in atlas.manifest.where("slot = 'obsm'").orderBy("pos").collect()]
    if args.process == "summary":
        row = spark.createDataFrame([record], catalog.SCHEMA)
        flags = spark.createDataFrame([(name, atlas.has_raw, True)], "atlas string, has_raw boolean, has_x boolean")
        tagged = [t.select(F.lit(name).alias("atlas")) for t in (atlas.cells, atlas.genes)]
        report.write_tsv(describe.summary(row, *tagged, flags), catalog.file_path(path, "summary", name))
        shape = describe.structure(atlas.manifest.withColumn("atlas", F.lit(name)), ("var", "varm") if seurat else ())
        report.write_tsv(shape.drop("atlas"), catalog.file_path(path, "adata", name))
        for kind, pattern, ending in (("umap", select.UMAP, catalog.UMAP_FIGURE), ("tsne", select.TSNE, catalog.TSNE_FIGURE)):
            key = next((k for k in embeddings if re.match(pattern, k)), None)
            if key:
                points = atlas.points(key, *keys[:1])
                report.write_scatter(points, keys[0] if keys else None, catalog.file_path(path, kind, name, ending), f"{name} {key}", args.plot_celllimit)
    elif args.process == "qc":
        metrics, wanted = quality_table(atlas, args.qc_display, seurat)
        report.write_tsv(qc.ranked(metrics, wanted, args.plot_celllimit).drop("cell_id"), catalog.file_path(path, "qc", name))
        report.write_violin(metrics, catalog.file_path(path, "violin", name, catalog.QC_FIGURE))
    elif args.process == "specificity":
        _specificity(spark, atlas, args, args.partition_key or (keys[0] if keys else None), path)
    else:
        family = args.process.removeprefix("metric_")
        if family == "cluster":
            key = "umap" if seurat else select.representation_of(embeddings)
            table = registry.cluster_table(atlas.points(key, *keys), name, keys, "vec", args.metric_cluster)
        elif family == "annot":
            table = registry.annotation_table(atlas.cells, name, keys, args.metric_annot)
        else:
            wide = atlas.dense().withColumnRenamed("vec", "__x")
            for k in embeddings:
                wide = wide.join(atlas.embed.where(F.col("obsm_key") == k).select("cell_id", F.col("vec").alias(k)), "cell_id")
            table = registry.reduction_table(wide, name, "__x", embeddings, args.metric_dimred, seurat)
        if table is not None:
            report.write_tsv(table, catalog.file_path(path, {"annot": "annotation"}.get(family, family), name))


def quality_table(atlas: bundle.Bundle, display: list[str], seurat: bool):
    """Metrics of all cells and the keys to rank: computed, or (Seurat) the export's own columns under the common names."""
    if seurat:
        own = select.qc_keys_seurat(atlas.cells.columns, tuple(display))
        renamed = atlas.cells.select("cell_id", "cell_pos", *[F.col(f"`{c}`").alias(select.FROM_SEURAT.get(c, c)) for c in own])
        return renamed, [select.FROM_SEURAT.get(c, c) for c in own]
    genes = qc.gene_classes(atlas.genes)
    gates = qc.gates(genes)
    metrics = qc.cell_metrics(atlas.cells, genes, atlas.expr, tuple(c for c in qc.CLASSES if gates[c]))
    return metrics, select.qc_keys(metrics.columns, tuple(display))


def _specificity(spark: SparkSession, atlas: bundle.Bundle, args: argparse.Namespace, key: str | None, path: str) -> None:
    """The metrics of every gene, their distributions, and the summary of the markers that the atlas has."""
    if key is None:
        logger.warning("%s has no annotation to compare types by", atlas.name)
        return
    named = atlas.genes.select("gene_id", F.col("gene_name").alias("gene"))
    means = specificity.mean_expression_once(f"{path}/{atlas.name}/{key}", atlas.cells.withColumn("celltype", F.col(f"`{key}`")), atlas.expr.join(named, "gene_id"), named)
    table = named.select("gene")
    for name, metric in specificity.SPECIFICITY.items():
        table = table.join(metric(means).withColumnRenamed("value", name), "gene", "left")
    report.write_tsv(table, catalog.file_path(path, "specificity", atlas.name))
    for name in specificity.SPECIFICITY:
        with open(catalog.file_path(path, "specificity", atlas.name, f"_{name}.svg"), "w", encoding="utf-8") as f:
            f.write(specificity_figures.metric_distribution(means, name))
    if args.markers:
        markers = read_markers(spark, args.markers)
        known = specificity.marker_intersection(means, markers)
        if known.count() < markers.select("celltype", "gene").distinct().count():
            logger.warning("markers of types or genes that %s lacks are left out", atlas.name)
        report.marker_run(means, markers.join(known, ["celltype", "gene"], "left_semi"), spark, path, specificity.summary)


if __name__ == "__main__":
    main()
