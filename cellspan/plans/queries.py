"""The registered queries of the atlas operators over the driver's tables; numbers are rounded to 6 digits on both engines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspan import cli
from cellspan.functions.durable import scratch
from cellspan.operators import annotation_metrics as am
from cellspan.operators import clean, describe, qc, registry, select, specificity
from cellspan.operators import cluster_metrics as cm
from cellspan.operators import reduction_metrics as rm
from cellspan.plans import bindings as b
from cellspan.sources import catalog, tenx

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def qc_cell_metrics(spark, sf_dir):
    return rounded(qc.cell_metrics(b.cells(spark, sf_dir), b.genes(spark, sf_dir), b.expr(spark, sf_dir)).drop("cell_pos"))


def qc_gene_metrics(spark, sf_dir):
    return rounded(qc.gene_metrics(b.cells(spark, sf_dir), b.genes(spark, sf_dir), b.expr(spark, sf_dir)))


def qc_cellrank(spark, sf_dir):
    metrics = qc.cell_metrics(b.cells(spark, sf_dir), b.genes(spark, sf_dir), b.expr(spark, sf_dir), ("mt",))
    return rounded(qc.ranked(rounded(metrics), ["total_counts", "n_genes_by_counts", "pct_counts_mt"]))


def qc_gated_classes(spark, sf_dir):
    return qc.gate_table(b.genes(spark, sf_dir))


def summary_table(spark, sf_dir):
    customer = b.table(spark, sf_dir, "customer")
    names = customer.select("c_mktsegment").distinct()
    records = names.select(
        F.col("c_mktsegment").alias("Atlas_name"), F.lit(catalog.ANNDATA).alias("Atlas_type"), F.lit(".h5ad").alias("Atlas_extension"),
        F.concat(F.lit("/atlases/"), F.col("c_mktsegment"), F.lit(".h5ad")).alias("Atlas_path"),
    )
    cells = customer.select(F.col("c_mktsegment").alias("atlas"))
    genes = customer.join(b.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("atlas"), "o_orderpriority").distinct()
    flags = names.select(F.col("c_mktsegment").alias("atlas"), F.col("c_mktsegment").startswith("A").alias("has_raw"), F.lit(True).alias("has_x"))
    return describe.summary(records, cells, genes, flags)


def structure_table(spark, sf_dir):
    return describe.structure(b.manifest(spark, sf_dir))


def unique_names(spark, sf_dir):
    return clean.unique_names(b.genes(spark, sf_dir)).select("gene_pos", "gene_name", "unique_name")


def positional_names(spark, sf_dir):
    return clean.positional_names(b.genes(spark, sf_dir)).select("gene_pos", "gene_name")


def viable_annotation(spark, sf_dir):
    return select.annotation_keys(b.annotated(spark, sf_dir), clean.OBS_CLUSTERS)


def representation_choice(spark, sf_dir):
    return select.representation(b.embeddings_manifest(spark, sf_dir))


def catalog_classify(spark, sf_dir):
    return catalog.classify(b.paths(spark, sf_dir))


def catalog_upsert(spark, sf_dir):
    named = catalog.classify(b.paths(spark, sf_dir)).join(b.paths(spark, sf_dir).groupBy("path").agg(F.max("seq").alias("seq")), F.col("Atlas_path") == F.col("path"))
    return catalog.upsert(named.select(*catalog.HEADER, "seq").distinct()).select(*catalog.HEADER)


def barcode_attach(spark, sf_dir):
    customer = b.table(spark, sf_dir, "customer")
    clusters = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("Cluster"))
    return tenx.attach_clusters(customer.select(F.col("c_custkey").alias("cell_id")), clusters, "cluster")


def names_unique(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    found = [(n, clean.names_unique(part, n)) for n in ("p_brand", "p_partkey")]
    return spark.createDataFrame(found, "name string, is_unique boolean")


def clean_genes(spark, sf_dir):
    return clean.clean_genes(b.branded(spark, sf_dir)).select("gene_pos", "gene_name")


def clean_raw_genes(spark, sf_dir):
    return clean.clean_genes(b.branded(spark, sf_dir), raw=True).select("gene_pos", "gene_name")


def categorical_clusters(spark, sf_dir):
    supplier = b.table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("int")
    cells = supplier.select(F.col("s_suppkey").alias("cell_id"), nation.alias("louvain"), (nation % 3).alias("leiden_coarse"), nation.alias("batch"))
    return clean.categorical_clusters(cells)[0]


def embedding_keys(spark, sf_dir):
    return select.embedding_keys(b.manifest(spark, sf_dir))


def seurat_annotation(spark, sf_dir):
    return select.annotation_keys(b.annotated(spark, sf_dir), clean.OBS_CLUSTERS, missing_drops=False)


def seurat_summary(spark, sf_dir):
    """Flags that say otherwise don't count for this family."""
    nation, customer = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "customer")
    name = F.col("n_name")
    records = nation.select(
        name.alias("Atlas_name"), F.lit(catalog.SEURAT).alias("Atlas_type"), F.lit(".rds").alias("Atlas_extension"), F.concat(F.lit("/atlases/"), name, F.lit(".rds")).alias("Atlas_path")
    )
    cells = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(name.alias("atlas"))
    genes = b.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name.alias("atlas"))
    return describe.summary(records, cells, genes, nation.select(name.alias("atlas"), F.lit(True).alias("has_raw"), F.lit(False).alias("has_x")))


def seurat_structure(spark, sf_dir):
    return describe.structure(b.manifest(spark, sf_dir), ("var", "varm"))


def seurat_qc_cellrank(spark, sf_dir):
    """An export's own columns, found by their names and ranked under the common ones."""
    metrics = rounded(qc.cell_metrics(b.cells(spark, sf_dir), b.genes(spark, sf_dir), b.expr(spark, sf_dir), ("mt",)))
    exported = metrics.select("cell_id", "cell_pos", *[F.col(of).alias(name) for of, name in select.TO_SEURAT.items() if of in metrics.columns])
    renamed, keys = cli.quality_table(SimpleNamespace(cells=exported), list(select.QC_DISPLAY), True)
    return rounded(qc.ranked(renamed, keys))


def reduction_metrics(spark, sf_dir):
    """The table of both families; a Seurat atlas has no numbers."""
    points = b.points(spark, sf_dir)
    found = [registry.reduction_table(points, name, "vec", ["low"], ["kruskal_stress", "spearman_rho"], name == "seurat") for name in ("scanpy", "seurat")]
    return rounded(reduce(DataFrame.unionByName, found))


def projection_attach(spark, sf_dir):
    customer = b.table(spark, sf_dir, "customer")
    projection = customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("UMAP-1"), F.col("c_nationkey").alias("UMAP-2"))
    found = tenx.attach_projection(customer.select(F.col("c_custkey").alias("cell_id")), projection, "X_umap")
    return rounded(found.select("obsm_key", "cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")))


def projection_skipped(spark, sf_dir):
    """Whether a projection of all cells, and one of some, is taken where their numbers have to agree."""
    customer = b.table(spark, sf_dir, "customer")
    cells, projection = customer.select(F.col("c_custkey").alias("cell_id")), customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("PC-1"))
    found = [(n, tenx.attach_projection(cells, projection.where(kept), "X_pca", only_if_counted=True) is not None) for n, kept in (("all", "true"), ("some", "c_acctbal > 0"))]
    return spark.createDataFrame(found, "rows string, taken boolean")


def atlas_lookup(spark, sf_dir):
    """Every run's atlas, from lists in which several families have its name; the AnnData list lacks the even runs."""
    found = catalog.classify(b.paths(spark, sf_dir).groupBy("path").agg(F.max("seq").alias("seq")))
    run = F.regexp_extract("Atlas_path", r"/run(\d+)/", 1).cast("int")
    seqs = b.paths(spark, sf_dir).groupBy(F.col("path").alias("of")).agg(F.max("seq").alias("seq"))
    named = found.withColumn("Atlas_name", F.concat(F.lit("run"), run)).join(seqs, F.col("Atlas_path") == F.col("of"))
    kind, lists = F.col("Atlas_type"), []
    for family, of_family in (("scanpy", (kind == catalog.ANNDATA) & (run % 2 == 1)), ("cellranger", kind.startswith("Cellranger")), ("seurat", kind == catalog.SEURAT)):
        lists.append(catalog.upsert(named.where(of_family)).withColumn("family", F.lit(family)))
    saved = reduce(DataFrame.unionByName, lists)
    return spark.createDataFrame([catalog.find(saved, f"run{i}") for i in range(7)], catalog.SCHEMA)


def matrix_market(spark, sf_dir):
    """Entries by supplier and 20 genes, written as a folder of the 10x layout (a single file, as the format is) and read again."""
    cells, items, _ = b.typed_expr(spark, sf_dir)
    entries = items.groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
    order = Window.orderBy("cell_id")  # the list of barcodes is one file
    placed = cells.select("cell_id", F.row_number().over(order).alias("at"))
    lines = entries.join(placed, "cell_id").select(F.lit(1).alias("part"), F.concat_ws(" ", F.col("gene") + 1, F.col("at"), F.col("value").cast("double")).alias("value"))
    sizes = entries.agg(F.lit(0).alias("part"), F.concat_ws(" ", F.lit(20), F.lit(placed.count()), F.count("*")).alias("value"))
    folder = scratch(spark, "matrix")
    head = spark.createDataFrame([(-1, "%%MatrixMarket matrix coordinate real general")], "part int, value string")
    head.unionByName(sizes).unionByName(lines).repartition(1).sortWithinPartitions("part").select("value").write.text(f"{folder}/matrix.mtx")
    placed.repartition(1).sortWithinPartitions("at").select(F.col("cell_id").cast("string")).write.text(f"{folder}/barcodes.tsv")
    spark.range(20, numPartitions=1).select(F.concat_ws("\t", F.concat(F.lit("gene"), "id"), F.concat(F.lit("name"), "id"))).write.text(f"{folder}/genes.tsv")
    return rounded(tenx.read_mtx(spark, folder)[2])


def _types(spark, sf_dir):
    return am.contingency(b.table(spark, sf_dir, "part"), "p_type", "p_brand")


def contingency(spark, sf_dir):
    return _types(spark, sf_dir)


def encode_labels(spark, sf_dir):
    return am.encode_labels(b.table(spark, sf_dir, "part"), "p_type")


def adjusted_rand(spark, sf_dir):
    return rounded(am.adjusted_rand(_types(spark, sf_dir)))


def fowlkes_mallows(spark, sf_dir):
    return rounded(am.fowlkes_mallows(_types(spark, sf_dir)))


def mutual_information(spark, sf_dir):
    return rounded(am.mutual_information(_types(spark, sf_dir)))


def v_measure(spark, sf_dir):
    return rounded(am.v_measure(_types(spark, sf_dir)))


def adj_mutual_info(spark, sf_dir):
    return rounded(am.adj_mutual_info(_types(spark, sf_dir)))


def dunn_index(spark, sf_dir):
    return am.dunn_index(_types(spark, sf_dir))


def davies_bouldin(spark, sf_dir):
    return rounded(cm.davies_bouldin(b.points(spark, sf_dir), "label", "vec"))


def calinski_harabasz(spark, sf_dir):
    return rounded(cm.calinski_harabasz(b.points(spark, sf_dir), "label", "vec"))


def silhouette(spark, sf_dir):
    return rounded(cm.silhouette(b.points(spark, sf_dir), "label", "vec"))


def kruskal_stress(spark, sf_dir):
    return rounded(rm.kruskal_stress(b.points(spark, sf_dir), "vec", "low"))


def spearman_rho(spark, sf_dir):
    return rm.spearman_rho(b.points(spark, sf_dir), "vec", "low")


def metric_pivot(spark, sf_dir):
    return rounded(registry.cluster_table(b.points(spark, sf_dir), "atlas", ["label", "label_mod"], "vec", ["davies_bouldin", "calinski_harabasz", "no_such_metric"]))


def metric_annotation(spark, sf_dir):
    keys = ["celltype", "louvain", "seurat_clusters"]
    return rounded(registry.annotation_table(b.annotated(spark, sf_dir), "atlas", keys, ["rand_index", "vmeasure", "fowlkes_mallow", "dunn_index"]))


def _means(spark, sf_dir):
    return specificity.mean_expression(*b.typed_expr(spark, sf_dir))


def avg_expression(spark, sf_dir):
    return rounded(_means(spark, sf_dir))


def one_v_all(spark, sf_dir):
    return rounded(specificity.one_v_all(_means(spark, sf_dir)))


def one_v_max(spark, sf_dir):
    return rounded(specificity.one_v_max(_means(spark, sf_dir)))


def shannon(spark, sf_dir):
    return rounded(specificity.shannon(_means(spark, sf_dir)))


def tau(spark, sf_dir):
    return rounded(specificity.tau(_means(spark, sf_dir)))


def gini(spark, sf_dir):
    return rounded(specificity.gini(_means(spark, sf_dir)))


def gene_metric_lookup(spark, sf_dir):
    means = _means(spark, sf_dir)
    return rounded(reduce(DataFrame.unionByName, [specificity.gene_metric(means, n).withColumn("metric", F.lit(n)) for n in ("shannon", "tau", "gini")]))


def unpivot_gt1(spark, sf_dir):
    return rounded(specificity.above_one(specificity.one_v_max(_means(spark, sf_dir))))


def _markers(spark, sf_dir):
    """Nations mark genes: some are listed twice, some genes or types don't occur."""
    nation = b.table(spark, sf_dir, "nation")
    gene = F.explode(F.array(F.col("n_nationkey").cast("long") % 12, F.col("n_nationkey").cast("long") + 10))
    return nation.select(F.col("n_nationkey").alias("celltype"), gene.alias("gene"), F.col("n_nationkey").cast("long").alias("pos"))


def specificity_summary(spark, sf_dir):
    # Rounded before the largest is looked for, so that both engines see the same ties.
    return rounded(specificity.summary(_means(spark, sf_dir), _markers(spark, sf_dir)))


def marker_intersection(spark, sf_dir):
    return specificity.marker_intersection(_means(spark, sf_dir), _markers(spark, sf_dir))


def sampled_cells(spark, sf_dir):
    """A seeded sample of 50 cells; the operator is the limit."""
    return qc.sampled(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id")), 50, seed=7)


def violin_summary(spark, sf_dir):
    metrics = qc.cell_metrics(b.cells(spark, sf_dir), b.genes(spark, sf_dir), b.expr(spark, sf_dir))
    return rounded(qc.violin_summary(metrics, ["n_genes_by_counts", "total_counts", "pct_counts_mt", "pct_counts_ribo"]))


def queries() -> dict[str, Query]:
    names = (
        "qc_cell_metrics qc_gene_metrics qc_cellrank qc_gated_classes summary_table structure_table unique_names positional_names viable_annotation"
        " representation_choice catalog_classify catalog_upsert barcode_attach contingency encode_labels adjusted_rand fowlkes_mallows mutual_information"
        " v_measure adj_mutual_info dunn_index davies_bouldin calinski_harabasz silhouette kruskal_stress spearman_rho metric_pivot metric_annotation"
        " avg_expression one_v_all one_v_max shannon tau gini unpivot_gt1 specificity_summary marker_intersection sampled_cells violin_summary"
        " names_unique clean_genes clean_raw_genes categorical_clusters embedding_keys seurat_annotation seurat_summary seurat_structure seurat_qc_cellrank"
        " reduction_metrics projection_attach projection_skipped atlas_lookup matrix_market gene_metric_lookup"
    ).split()
    return {n: globals()[n] for n in names}
