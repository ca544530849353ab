import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.operators import annotation_metrics as am
from cellspan.operators import clean, describe, qc, registry, select, specificity
from cellspan.operators import cluster_metrics as cm
from cellspan.operators import reduction_metrics as rm
from cellspan.plans import queries

SF01 = "/root/testdata/sf0.01"

# Values at sf0.01 that numpy, Spark and DuckDB formulations agree on.
GOLDEN = {
    "silhouette": -0.0127073144, "davies_bouldin": 10.9044157416, "calinski_harabasz": 1.0553169551, "kruskal_stress": 4.8832212203,
    "adjusted_rand": 0.0007482310, "fowlkes_mallows": 0.0825951884, "v_measure": 0.0142710495, "mutual_information": 0.0356961796, "adj_mutual_info": 0.0021041502,
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_values(name, spark):
    assert abs(queries.queries()[name](spark, SF01).first().value - GOLDEN[name]) < 2e-6


def test_golden_specificity(spark):
    for name, want in (("gini", 0.0752044677), ("tau", 0.1779481917), ("shannon", 3.2097550394)):
        assert abs(queries.queries()[name](spark, SF01).where("gene = 0").first().value - want) < 2e-6


def pairs(spark, rows):
    return am.contingency(spark.createDataFrame(rows, "a string, b string"), "a", "b")


def test_identical_partitions_agree(spark):
    table = pairs(spark, [(x, x + "!") for x in "aabbbcccc"])
    for f in (am.adjusted_rand, am.fowlkes_mallows, am.v_measure, am.adj_mutual_info):
        assert abs(f(table).first().value - 1) < 1e-9
    trivial = pairs(spark, [("a", "b")] * 5)
    assert am.adjusted_rand(trivial).first().value == am.v_measure(trivial).first().value == am.adj_mutual_info(trivial).first().value == 1
    assert am.dunn_index(trivial).first().value == 0
    none = pairs(spark, [(None, "x")])
    assert am.adjusted_rand(none).first().value is None and am.fowlkes_mallows(none).first().value is None


def test_labels_can_be_renamed(spark):
    rng = np.random.default_rng(0)
    rows = [(str(a), str(b)) for a, b in rng.integers(0, 4, (200, 2))]
    renamed = [({"0": "z", "1": "y", "2": "x", "3": "w"}[a], b) for a, b in rows]
    for f in (am.adjusted_rand, am.fowlkes_mallows, am.v_measure, am.adj_mutual_info):
        assert abs(f(pairs(spark, rows)).first().value - f(pairs(spark, renamed)).first().value) < 1e-9


def points(spark, vectors, labels):
    return spark.createDataFrame([(int(i), None if k is None else str(k), [float(x) for x in v]) for i, (v, k) in enumerate(zip(vectors, labels))], "id long, k string, v array<double>")


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == k].mean() for k in set(y) - {y[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_and_stress_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(700, 5)), rng.integers(0, 4, 700)
    y[0] = 9  # a singleton
    df = points(spark, x, y)
    assert abs(cm.silhouette(df, "k", "v").first().value - brute_silhouette(x, y)) < 1e-9
    low = df.withColumn("low", F.slice("v", 1, 2))
    high, flat = (np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) for z in (x, x[:, :2]))
    assert abs(rm.kruskal_stress(low, "v", "low").first().value - np.sqrt(((high - flat) ** 2).sum() / (flat**2).sum())) < 1e-6
    assert rm.kruskal_stress(df, "v", "v").first().value == 0
    assert rm.spearman_rho(df, "v", "v").first().value == 0


def test_cluster_metrics_need_two_labels(spark):
    one = points(spark, np.eye(4), [1, 1, 1, 1])
    each = points(spark, np.eye(4), [1, 2, 3, 4])
    none = points(spark, np.eye(2), [None, None])
    for f in (cm.silhouette, cm.davies_bouldin, cm.calinski_harabasz):
        for df in (one, each, none):
            assert f(df, "k", "v").first().value is None
    same = points(spark, np.ones((4, 2)), [1, 1, 2, 2])  # coincident centroids
    assert cm.davies_bouldin(same, "k", "v").first().value == 0 and cm.calinski_harabasz(same, "k", "v").first().value == 1


def test_registry(spark):
    df = points(spark, np.eye(4), ["a", "a", "b", "b"])
    table = registry.cluster_table(df, "x", ["k"], "v", ["davies_bouldin", "nothing"])
    assert table.columns == ["Clust_Sample", "obs", "davies_bouldin", "nothing"] and table.first().nothing == -1
    registry.register_metric("cluster", "rows", lambda p, k, v: p.agg(F.count("*").cast("double").alias("value")))
    assert registry.cluster_table(df, "x", ["k"], "v", ["rows"]).first().rows == 4
    assert registry.annotation_table(df, "x", ["k"]) is None and registry.cluster_table(df, "x", [], "v") is None
    empty = registry.reduction_table(df, "x", "v", ["umap"], ["kruskal_stress"], seurat=True).first()
    assert empty.Dimred_Sample == "x_umap" and empty.kruskal_stress is None


def qc_tables(spark):
    cells = spark.createDataFrame([("a", 0), ("b", 1), ("empty", 2)], "cell_id string, cell_pos long")
    genes = qc.gene_classes(spark.createDataFrame([(0, "MT-X"), (1, "RPS1"), (2, "mt-y"), (3, None)], "gene_id long, gene_name string"))
    expr = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 2, 4.0), ("b", 3, 0.0)], "cell_id string, gene_id long, value double")
    return cells, genes, expr


def test_cells_without_counts(spark):
    cells, genes, expr = qc_tables(spark)
    got = {r.cell_id: r for r in qc.cell_metrics(cells, genes, expr).collect()}
    assert (got["a"].n_genes_by_counts, got["a"].total_counts, got["a"].pct_counts_mt, got["a"].pct_counts_ribo) == (3, 4.0, 50.0, 25.0)
    assert (got["b"].n_genes_by_counts, got["empty"].total_counts, got["empty"].pct_counts_mt) == (1, 0.0, None)
    dropout = {r.gene_id: r.pct_dropout_by_counts for r in qc.gene_metrics(cells, genes, expr).collect()}
    assert abs(dropout[2] - 100 / 3) < 1e-9 and dropout[3] == 100


def test_gate_of_ribosomal_genes_looks_at_mitochondrial_ones(spark):
    _, genes, _ = qc_tables(spark)
    only_ribo = genes.where("NOT is_mt")
    assert qc.gates(genes) == {"mt": True, "ribo": True}
    assert qc.gates(only_ribo) == {"mt": False, "ribo": False} and qc.gates(only_ribo, strict=True) == {"mt": False, "ribo": True}
    assert [tuple(r) for r in qc.gate_table(only_ribo).orderBy("class").collect()] == [("mt", 0, False, False), ("ribo", 1, True, False)]


def test_ranks_and_samples(spark):
    rows = [(f"c{i}", i, v) for i, v in enumerate([3.0, None, float("nan"), 7.0, 3.0])]
    df = spark.createDataFrame(rows, "cell_id string, cell_pos long, q double")
    got = {r.cell_id: r.cellrank_q for r in qc.ranked(df, ["q"]).collect()}
    assert got == {"c3": 1, "c0": 2, "c4": 3, "c1": 4, "c2": 5}
    some = qc.ranked(df, ["q"], cell_limit=3, seed=1).collect()
    assert len(some) == 3 and sorted(r.cell_index for r in some) == [1, 2, 3]
    assert qc.sampled(df, 0).count() == 5 and qc.sampled(df, 9).count() == 5
    assert qc.ranked(df, []).count() == 0


def test_annotation_keys(spark):
    rows = [("x", "a", "a", None, "nan", "u", 1), ("y", "b", "a", "b", "b", "u", 2)]
    df = spark.createDataFrame(rows, "celltype_leiden string, louvain string, leiden string, cell_type string, CellType string, other string, leiden_int int")
    got = [tuple(r) for r in select.annotation_keys(df, ("celltype", "leiden", "louvain", "cell_type", "CellType")).collect()]
    assert got == [("celltype_leiden", 2), ("celltype_leiden", 2), ("louvain", 2)]
    assert [r.key for r in select.annotation_keys(df, ("celltype", "leiden"), dedupe=True).collect()] == ["celltype_leiden"]
    assert [r.key for r in select.annotation_keys(df, ("leiden",), {"leiden": ["a", "unused"]}).collect()] == ["celltype_leiden", "leiden"]
    assert "cell_type" not in [r.key for r in select.annotation_keys(df, ("cell_type",)).collect()]
    assert select.annotation_keys(df, ("none",)).count() == 0


def test_key_orders_of_both_families():
    assert select.qc_keys(["pct_counts_mt", "x", "total_counts"]) == ["pct_counts_mt", "total_counts"]
    assert select.qc_keys_seurat(["nFeature_RNA", "nCount_RNA"], ("total_counts", "unknown", "n_genes_by_counts")) == ["nCount_RNA", "nFeature_RNA"]


def test_representation(spark):
    rows = [("a", "obsm", "X_tsne", 0), ("a", "obsm", "X_umap", 1), ("b", "obsm", "X_tsne1", 0), ("c", "obsm", "X_pca", 0), ("d", "obs", "X_umap1", 0)]
    df = spark.createDataFrame(rows, "atlas string, slot string, key string, pos long")
    got = {r.atlas: r.obsm_key for r in select.representation(df).collect()}
    assert got == {"a": "X_umap", "b": "X_tsne1", "c": "", "d": ""}
    assert select.representation_of(["X_pca", "X_uma", "X_umax"]) == "X_umax" and select.representation_of([]) == ""
    assert [r.key for r in select.embedding_keys(df).collect()][:2] == ["X_tsne", "X_umap"]


def test_structure_of_empty_slots(spark):
    df = spark.createDataFrame([("a", "obs", "k2", 1), ("a", "obs", "k1", 0), ("a", "var", "v", 0)], "atlas string, slot string, key string, pos long")
    row = describe.structure(df).first()
    assert row.atlas_obs == "<code>k1</code><br><code>k2</code>" and row.obsm == "<code></code>" and row["var"] == "<code>v</code>"
    assert describe.structure(df, ("var", "varm")).first()["var"] == "<code></code>"


def test_summary_of_a_seurat_atlas(spark):
    record = spark.createDataFrame([("s", "Seurat", ".rds", "/s.rds")], "Atlas_name string, Atlas_type string, Atlas_extension string, Atlas_path string")
    n = spark.createDataFrame([("s",), ("s",)], "atlas string")
    flags = spark.createDataFrame([("s", True, False)], "atlas string, has_raw boolean, has_x boolean")
    row = describe.summary(record, n, n.limit(0), flags).first()
    assert (row.NbCells, row.NbGenes, row["AnnData.raw"], row["AnnData.X"], row.File_extension) == (2, 0, False, True, ".rds")


def test_integer_clusters_become_categories(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "leiden int, other int, louvain double")
    got, changed = clean.categorical_clusters(df)
    assert changed == ["leiden"] and dict(got.dtypes)["leiden"] == "string" and dict(got.dtypes)["other"] == "int"


def test_specificity_by_hand(spark):
    m = spark.createDataFrame([("t1", "g", 4.0), ("t2", "g", 1.0), ("t3", "g", 0.0), ("t1", "z", 0.0), ("t2", "z", 0.0), ("t3", "z", 0.0), ("t1", "h", 2.0), ("t2", "h", 2.0), ("t3", "h", 0.0)], "celltype string, gene string, value double")
    ratio = {(r.gene, r.celltype): r.value for r in specificity.one_v_max(m).collect()}
    assert ratio["g", "t1"] == 4 and ratio["g", "t2"] == 0.25 and ratio["h", "t1"] == 1 and ratio["z", "t1"] is None
    tau = {r.gene: r.value for r in specificity.tau(m).collect()}
    gini = {r.gene: r.value for r in specificity.gini(m).collect()}
    assert abs(tau["g"] - (0.75 + 1) / 2) < 1e-12 and abs(gini["g"] - (2 * 4 - 0) / 15) < 1e-12 and gini["z"] is None
    assert abs({r.gene: r.value for r in specificity.shannon(m).collect()}["h"] - np.log(2)) < 1e-12
    markers = specificity.marker_table(spark, {"t1": ["g", "missing"], "t9": ["h"], "t2": ["g"]})
    rows = {r.gene: r for r in specificity.summary(m, markers).collect()}
    assert set(rows) == {"g", "h"} and rows["g"]["expected celltype"] == "t2" and rows["g"]["most expressed celltype"] == "t1" and rows["g"].one_v_max == 4
    assert [tuple(r) for r in specificity.marker_intersection(m, markers).orderBy("celltype").collect()] == [("t1", "g"), ("t2", "g")]
    wide = spark.createDataFrame([("t1", 1.0, 2.0)], "celltype string, `a.b` double, c double")
    assert {r.gene: r.value for r in specificity.unpivoted(wide).collect()} == {"a.b": 1.0, "c": 2.0}
    assert specificity.gene_metric(m, "tau").count() == 3
    with pytest.raises(ValueError):
        specificity.gene_metric(m, "x")
    assert [r.celltype for r in specificity.above_one(specificity.one_v_max(m)).collect()] == ["t1"]


def test_means_count_cells_without_entries(spark):
    cells = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "cell_id string, celltype string")
    expr = spark.createDataFrame([("a", "g", 3.0), ("d", "g", 9.0)], "cell_id string, gene string, value double")
    genes = spark.createDataFrame([("g",), ("h",)], "gene string")
    got = {(r.celltype, r.gene): r.value for r in specificity.mean_expression(cells, expr, genes).collect()}
    assert got == {("x", "g"): 1.5, ("x", "h"): 0.0, ("y", "g"): 0.0, ("y", "h"): 0.0}
    again = specificity.mean_expression_once("k", cells, expr, genes)
    assert again is specificity.mean_expression_once("k", cells, expr, genes)
