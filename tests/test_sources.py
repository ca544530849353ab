import os

import pytest

from cellspan import cli
from cellspan.operators import clean, report
from cellspan.sources import bundle, catalog, tenx
from cellspan.streaming import arriving, read_catalog, upsert_batch


def put(path, text="x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


BARCODES = ["AA-1", "BB-1", "CC-1", "DD-1"]


@pytest.fixture
def old_layout(tmp_path):
    out = tmp_path / "pbmc" / "outs"
    m = out / "filtered_gene_bc_matrices" / "hg19"
    put(m / "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%\n4 4 6\n1 1 5\n2 1 1\n3 2 7\n4 2 2\n1 3 4\n2 3 3\n")
    put(m / "genes.tsv", "E1\tMT-A\nE2\tG\nE3\tG\nE4\tRPS1\n")
    put(m / "barcodes.tsv", "\n".join(BARCODES) + "\n")
    for k in (3, 7, 12, 20):
        put(out / "analysis_csv" / "kmeans" / f"{k}_clusters" / "clusters.csv", "Barcode,Cluster\nAA-1,1\nBB-1,2\nCC-1,1\n")
    put(out / "analysis_csv" / "graphclust" / "clusters.csv", "Barcode,Cluster\nAA-1,1\nBB-1,2\nCC-1,1\nDD-1,2\n")
    rows = "".join(f"{b},{i}.5,{-i}\n" for i, b in enumerate(BARCODES))
    put(out / "analysis_csv" / "umap" / "projection.csv", "Barcode,UMAP-1,UMAP-2\n" + rows)
    put(out / "analysis_csv" / "tsne" / "projection.csv", "Barcode,T-1,T-2\n" + rows.split("\n")[0] + "\n")
    return str(tmp_path)


def test_crawl_classify_and_lists(spark, old_layout, tmp_path):
    put(tmp_path / "a" / "x.h5ad"), put(tmp_path / "b" / "x.h5ad"), put(tmp_path / "c" / "y.z.rds"), put(tmp_path / "p" / "outs" / catalog.NEW_FILE)
    got = catalog.list_atlases(spark, old_layout, "scanpy").collect()
    assert [(r.Atlas_name, r.Atlas_path.split("/")[-2]) for r in got] == [("x", "b")]  # the last of a name wins
    tenx_list = {r.Atlas_name: r.Atlas_type for r in catalog.list_atlases(spark, old_layout, "cellranger").collect()}
    assert tenx_list == {"pbmc": catalog.CELLRANGER_OLD, "p": catalog.CELLRANGER_NEW}
    assert catalog.list_atlases(spark, old_layout, "seurat").first().Atlas_name == "y.z"
    lists = catalog.read_lists(spark, old_layout)
    assert lists.count() == 4 and catalog.find(lists, "pbmc")["Atlas_extension"] == ".mtx"
    with pytest.raises(catalog.UnknownAtlas):
        catalog.find(lists, "nobody")
    assert sorted(os.listdir(catalog.working_dir(old_layout)))[:3] == ["List_cellranger.csv", "List_scanpy.csv", "List_seurat.csv"]


def test_short_paths_are_dropped(spark):
    df = spark.createDataFrame([("x/" + catalog.NEW_FILE,), ("a/b/matrix.mtx",), ("n.h5ad",), ("note.txt",)], "path string")
    assert [r.Atlas_name for r in catalog.classify(df).collect()] == ["n"]


def test_precedence_of_families(spark):
    rows = [("x", catalog.SEURAT, ".rds", "r", "seurat"), ("x", catalog.ANNDATA, ".h5ad", "a", "scanpy"), ("x", catalog.CELLRANGER_NEW, ".h5", "c", "cellranger")]
    df = spark.createDataFrame(rows, "Atlas_name string, Atlas_type string, Atlas_extension string, Atlas_path string, family string")
    assert catalog.find(df, "x")["Atlas_path"] == "a"


def test_old_layout_is_read_with_its_companions(spark, old_layout):
    catalog.list_atlases(spark, old_layout, "cellranger")
    atlas = bundle.read(spark, catalog.find(catalog.read_lists(spark, old_layout), "pbmc"))
    assert [r.cell_id for r in atlas.cells.orderBy("cell_pos").collect()] == BARCODES
    entries = {(r.cell_id, r.gene_id): r.value for r in atlas.expr.collect()}
    assert entries == {("AA-1", "E1"): 5, ("AA-1", "E2"): 1, ("BB-1", "E3"): 7, ("BB-1", "E4"): 2, ("CC-1", "E1"): 4, ("CC-1", "E2"): 3}
    assert {"cellranger_graphclust", "cellranger_kmeans_12"} <= set(atlas.cells.columns)  # the highest of 3 to 15
    assert atlas.cells.where("cell_id = 'DD-1'").first().cellranger_kmeans_12 is None
    assert [r.obsm_key for r in atlas.embed.select("obsm_key").distinct().collect()] == ["X_umap"]  # the t-SNE has too few rows
    assert [r.vec for r in atlas.dense().where("cell_id = 'DD-1'").collect()] == [[0.0] * 4]
    assert [r.vec for r in atlas.dense().where("cell_id = 'BB-1'").collect()] == [[0.0, 0.0, 7.0, 2.0]]


def test_projection_of_other_barcodes(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    other = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "cell_id string, d double")
    with pytest.raises(tenx.BarcodeMismatch):
        tenx.attach_projection(cells, other, "X_umap")
    assert tenx.attach_projection(cells, other.limit(1), "X_pca", only_if_counted=True) is None


def test_current_layout_companions(tmp_path):
    out = tmp_path / "p" / "outs"
    m = put(out / catalog.NEW_FILE)
    put(out / "analysis" / "clustering" / "atac" / "graphclust" / "clusters.csv")
    g = put(out / "analysis" / "clustering" / "gex" / "graphclust" / "clusters.csv")
    k = put(out / "analysis" / "clustering" / "gex" / "kmeans_5_clusters" / "clusters.csv")
    u = put(out / "analysis" / "umap" / "gene_expression_2_components" / "projection.csv")
    found = tenx.companions(m)
    assert found.clusters == {"cellranger_graphclust": g, "cellranger_kmeans_5": k} and found.projections == {"X_umap": u}
    ten = put(out / "analysis" / "clustering" / "kmeans_10_clusters" / "clusters.csv")
    both = put(out / "analysis" / "dimensionality_reduction" / "gex" / "tsne_projection.csv")
    found = tenx.companions(m)
    assert found.clusters["cellranger_kmeans_10"] == ten and found.projections == {"X_tsne": both}


def test_bundle_round_trip_and_unreadable(spark, old_layout, tmp_path):
    catalog.list_atlases(spark, old_layout, "cellranger")
    atlas = bundle.read(spark, catalog.find(catalog.read_lists(spark, old_layout), "pbmc"))
    bundle.write_bundle(atlas, str(tmp_path / "s.bundle"))
    again = bundle.read(spark, {"Atlas_name": "s", "Atlas_type": catalog.SEURAT, "Atlas_path": str(tmp_path / "s.rds")})
    assert again.family == catalog.SEURAT and again.expr.count() == 6
    with pytest.raises(bundle.UnreadableAtlas):
        bundle.read(spark, {"Atlas_name": "n", "Atlas_type": catalog.SEURAT, "Atlas_path": str(tmp_path / "n.rds")})


@pytest.mark.parametrize("process, folder", [("summary", "summary"), ("qc", "qc"), ("metric_cluster", "cluster"), ("metric_annot", "annotation"), ("metric_dimred", "dimred")])
def test_command_line(spark, old_layout, process, folder):
    cli.main(["list_cellranger", old_layout], spark)
    cli.main([process, "pbmc", old_layout, "--metric_dimred", "kruskal_stress", "spearman_rho"], spark)
    file = catalog.file_path(old_layout, folder, "pbmc")
    if process == "metric_annot":  # the k-means column misses a cell, so only one key is viable
        assert not os.path.exists(file)
        return
    lines = open(file).read().splitlines()
    head = lines[0].split("\t")
    if process == "summary":
        assert head == ["AtlasFileType", "NbCells", "NbGenes", "AnnData.raw", "AnnData.X", "File_extension", "File_path"]
        assert lines[1].split("\t")[:6] == ["Cellranger < v3", "4", "4", "False", "True", "pbmc"]
        assert os.path.exists(catalog.file_path(old_layout, "umap", "pbmc", catalog.UMAP_FIGURE))
        assert report.read_summaries(spark, old_layout).first().Sample == "pbmc"
    if process == "qc":
        assert head[-1] == "cell_index" and len(lines) == 5
        cli.main(["html_report", old_layout], spark)
        assert "pbmc_qc" in open(catalog.report_path(old_layout, "qc")).read()
    if process == "metric_cluster":
        assert head == ["Clust_Sample", "obs", "davies_bouldin"] and lines[1].startswith("pbmc_cellranger_graphclust\t")
    if process == "metric_dimred":
        assert head == ["Dimred_Sample", "obsm", "kruskal_stress", "spearman_rho"]


def test_specificity_command(spark, old_layout, tmp_path):
    markers = put(tmp_path / "markers.tsv", "celltype\tgene\n1\tMT-A\n2\tRPS1\n9\tG\n")
    options = put(tmp_path / "o.yaml", "partition_key: cellranger_graphclust\n")
    cli.main(["list_cellranger", old_layout], spark)
    cli.main(["specificity", "pbmc", old_layout, "--markers", markers, "--options", options], spark)
    lines = open(catalog.file_path(old_layout, "specificity", "pbmc")).read().splitlines()
    assert lines[0].split("\t") == ["gene", "shannon", "tau", "gini"] and len(lines) == 5
    stamp = [d for d in os.listdir(catalog.folder(old_layout, "specificity")) if os.path.isdir(os.path.join(catalog.folder(old_layout, "specificity"), d))]
    rows = open(os.path.join(catalog.folder(old_layout, "specificity"), stamp[0], "spec_summary.tsv")).read().splitlines()
    assert len(rows) == 3 and rows[0].startswith("gene\texpected celltype\tmost expressed celltype\tone_v_max")


def test_options_round_trip(tmp_path):
    from argparse import Namespace

    from cellspan.sources.options import load_options, save_options

    save_options(Namespace(a=[1, "x"], b=None), str(tmp_path / "o.yaml"))
    assert vars(load_options(str(tmp_path / "o.yaml"), Namespace(a=0, c=1))) == {"a": [1, "x"], "b": None, "c": 1}


def test_specificity_figures(spark):
    from cellspan.operators import specificity_figures as figures

    means = spark.createDataFrame([(t, g, float(v)) for g, vs in {"g<1>": (5, 1, 0), "h": (1, 2, 3), "z": (0, 0, 0)}.items() for t, v in zip("abc", vs)], "celltype string, gene string, value double")
    bars = figures.histogram(means, bins=5).collect()
    assert sum(r.n for r in bars) == 9 and {r.bin for r in bars} == {0, 1, 2, 3, 4} - ({3} if not any(r.bin == 3 for r in bars) else set())
    page = figures.gene_distribution(means, "g<1>")
    assert "g&lt;1&gt;: shannon" in page and page.count("<line") == 3
    assert "<svg" in figures.ratio_distribution(means, "a", ["g<1>"]) and "<svg" in figures.metric_distribution(means, "tau")
    assert {r.gene: (r.celltype, r.value) for r in figures.marker_ratios(means, ["g<1>", "z"]).collect()} == {"g<1>": ("a", 5.0)}


def test_tabs_escape_names():
    page = report.tabbed_html("qc", {"a<b>": "violin/a.svg", "c": "violin/c.svg"})
    assert "a&lt;b&gt;" in page and page.count("display: block") == 1 and page.count("<img") == 2


def test_arriving_atlases(spark, tmp_path):
    put(tmp_path / "in" / "x.h5ad", "1"), put(tmp_path / "in" / "deep" / "y.rds", "1"), put(tmp_path / "in" / "z.txt", "1")
    into = str(tmp_path / "catalog")
    query = arriving(spark, str(tmp_path / "in")).writeStream.foreachBatch(upsert_batch(into)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.Atlas_name for r in spark.read.parquet(into).collect()) == ["x", "y"]


def test_unique_names_skip_taken_numbers(spark):
    names = ["g", "g", "g-1", "g", "h", "g-3", "h", "a-1", "a-1"]
    df = spark.createDataFrame(list(enumerate(names)), "gene_pos long, gene_name string")
    got = [r.unique_name for r in clean.unique_names(df).orderBy("gene_pos").collect()]
    assert got == ["g", "g-2", "g-1", "g-4", "h", "g-3", "h-1", "a-1", "a-1-1"]
    assert clean.names_unique(clean.clean_genes(df)) and not clean.names_unique(df)
    assert [r.gene_name for r in clean.clean_genes(df, raw=True).orderBy("gene_pos").collect()][:2] == ["g_0", "g_1"]


def test_an_entry_that_looks_like_the_sizes_stays(spark, tmp_path):
    put(tmp_path / "genes.tsv", "E1\tA\nE2\tB\n"), put(tmp_path / "barcodes.tsv", "AA\nBB\n")
    put(tmp_path / "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 1 5\n2 2 2\n")
    _, _, expr = tenx.read_mtx(spark, str(tmp_path))
    assert {(r.cell_id, r.gene_id): r.value for r in expr.collect()} == {("AA", "E1"): 5, ("BB", "E2"): 2}


@pytest.mark.parametrize("lines", ["2 2 3\n1 1 5\n2 2 2\n", "2 2 1\n3 1 5\n", "2 2 1\n1 3 5\n", ""])
def test_a_matrix_that_contradicts_its_sizes(spark, tmp_path, lines):
    put(tmp_path / "genes.tsv", "E1\tA\nE2\tB\n"), put(tmp_path / "barcodes.tsv", "AA\nBB\n")
    put(tmp_path / "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n" + lines)
    with pytest.raises(tenx.BrokenMatrix):
        tenx.read_mtx(spark, str(tmp_path))


def test_matrix_over_many_splits(spark, tmp_path):
    put(tmp_path / "genes.tsv", "".join(f"E{i}\tg\n" for i in range(50))), put(tmp_path / "barcodes.tsv", "".join(f"B{i}\n" for i in range(400)))
    put(tmp_path / "matrix.mtx", "%x\n50 400 20000\n" + "".join(f"{g + 1} {c + 1} {g + 1}\n" for c in range(400) for g in range(50)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        _, _, expr = tenx.read_mtx(spark, str(tmp_path))
        assert expr.count() == 20_000 and expr.agg({"value": "sum"}).first()[0] == 400 * 50 * 51 / 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_tables_and_figures_stay_off_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(report, "DRIVER_ROWS", 50), monkeypatch.setattr(report, "FIGURE_POINTS", 60)
    path = str(tmp_path / "t.tsv")
    report.write_tsv(spark.range(50), path)
    assert len(open(path).read().splitlines()) == 51
    report.write_tsv(spark.range(51), path)
    assert os.path.isdir(path) and spark.read.option("sep", "\t").option("header", True).csv(path).count() == 51
    report.write_tsv(spark.range(3), path)
    assert len(open(path).read().splitlines()) == 4
    points = spark.range(500).select(F.array(F.col("id").cast("double") % 10, F.col("id").cast("double") % 7).alias("vec"), (F.col("id") % 3).alias("k"))
    report.write_scatter(points, "k", str(tmp_path / "s.svg"), "t", limit=0)
    assert open(tmp_path / "s.svg").read().count("<circle") == 70
    cells = report.binned(points.select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.col("k").cast("string").alias("k")), grid=2).collect()
    assert len(cells) == 4 and sum(r.n for r in cells) == 500
    report.write_scatter(points, "k", str(tmp_path / "s.svg"), "t", limit=20)
    assert open(tmp_path / "s.svg").read().count("<circle") == 20


def test_replayed_and_broken_batches(spark, tmp_path):
    into, put_batch = str(tmp_path / "catalog"), upsert_batch(str(tmp_path / "catalog"))
    one = catalog.classify(spark.createDataFrame([("/a/x.h5ad",), ("/a/y.rds",)], "path string"))
    two = catalog.classify(spark.createDataFrame([("/b/x.h5ad",), ("/b/w.h5ad",), ("/c/w.h5ad",)], "path string"))
    put_batch(one, 0), put_batch(two, 1)
    want = {("x", "/b/x.h5ad", 0), ("y", "/a/y.rds", 0), ("w", "/c/w.h5ad", 1)}
    assert {(r.Atlas_name, r.Atlas_path, r.first_seq) for r in read_catalog(spark, into).collect()} == want
    put_batch(two, 1)  # replayed
    for f in os.listdir(os.path.join(into, "batch=1")):  # broken off: some files are gone
        os.remove(os.path.join(into, "batch=1", f))
    assert read_catalog(spark, into).count() == 2
    put_batch(two, 1)
    assert {(r.Atlas_name, r.Atlas_path, r.first_seq) for r in read_catalog(spark, into).collect()} == want
    assert read_catalog(spark, into).count() == 3


@pytest.fixture
def seurat(spark, tmp_path):
    from pyspark.sql import functions as F

    cells = spark.createDataFrame(
        [(f"c{i}", i, 100.0 * i, 10.0 + i, 2.5, "AB"[i % 2], ["T", "B", "NK"][i % 3]) for i in range(12)],
        "cell_id string, cell_pos long, nCount_RNA double, nFeature_RNA double, `percent.mito` double, louvain string, celltype string",
    )
    genes = spark.createDataFrame([(f"g{i}", i, f"g{i}") for i in range(4)], "gene_id string, gene_pos long, gene_name string")
    expr = cells.crossJoin(genes).select("cell_id", "gene_id", (F.col("cell_pos") % 3 + F.col("gene_pos")).cast("double").alias("value")).where("value <> 0")
    embed = cells.select(F.lit("umap").alias("obsm_key"), "cell_id", F.array((F.col("cell_pos") % 2).cast("double") * 5 + F.col("cell_pos") * 0.1, F.col("cell_pos").cast("double")).alias("vec"))
    rows = [("obs", c, i) for i, c in enumerate(cells.columns[2:])] + [("obsm", "umap", 0)]
    made = bundle.Bundle("s", catalog.SEURAT, cells, genes, expr, embed, spark.createDataFrame(rows, bundle.MANIFEST))
    put(tmp_path / "s.rds")
    bundle.write_bundle(made, str(tmp_path / "s.bundle"))
    cli.main(["list_seurat", str(tmp_path)], spark)
    return str(tmp_path)


@pytest.mark.parametrize("process, folder", [("summary", "summary"), ("qc", "qc"), ("metric_cluster", "cluster"), ("metric_annot", "annotation"), ("metric_dimred", "dimred"), ("specificity", "specificity")])
def test_seurat_bundle_through_every_command(spark, seurat, process, folder):
    cli.main([process, "s", seurat], spark)
    lines = open(catalog.file_path(seurat, folder, "s")).read().splitlines()
    head = lines[0].split("\t")
    if process == "summary":
        assert lines[1].split("\t")[:3] == ["Seurat", "12", "4"] and os.path.exists(catalog.file_path(seurat, "umap", "s", catalog.UMAP_FIGURE))
    if process == "qc":
        assert "cellrank_total_counts" in head and len(lines) == 13 and os.path.exists(catalog.file_path(seurat, "violin", "s", catalog.QC_FIGURE))
    if process == "metric_cluster":
        assert head[:2] == ["Clust_Sample", "obs"] and {x.split("\t")[1] for x in lines[1:]} <= {"louvain", "celltype"} and len(lines) > 1
    if process == "metric_annot":
        assert head[0] == "Annot_Sample" and len(lines) > 1
    if process == "metric_dimred":
        assert lines[1].split("\t")[1] == "umap"
    if process == "specificity":
        assert len(lines) == 5
