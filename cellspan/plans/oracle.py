"""DuckDB SQL that gives the same rows as :mod:`cellspan.plans.queries`."""

from __future__ import annotations

_CELLS = "cells AS (SELECT s_suppkey AS cell_id, n_name AS celltype FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_GENES = """genes AS (SELECT p_partkey AS gene_id, p_name AS gene_name, starts_with(p_name, 'red') AS is_mt,
  starts_with(p_name, 'blue') OR starts_with(p_name, 'cold') AS is_ribo FROM part)"""
_EXPR = "expr AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_SUMS = f"""{_CELLS}, {_GENES}, {_EXPR}, sums AS (
  SELECT cell_id, count(*) FILTER (value <> 0) AS n_genes_by_counts, sum(value) AS total_counts,
    coalesce(sum(value) FILTER (is_mt), 0) AS total_counts_mt, coalesce(sum(value) FILTER (is_ribo), 0) AS total_counts_ribo
  FROM expr JOIN genes USING (gene_id) GROUP BY cell_id
), metrics AS (
  SELECT cell_id, coalesce(n_genes_by_counts, 0) AS n_genes_by_counts, coalesce(total_counts, 0.0) AS total_counts,
    coalesce(total_counts_mt, 0.0) AS total_counts_mt, round(100 * total_counts_mt / nullif(total_counts, 0), 6) AS pct_counts_mt,
    coalesce(total_counts_ribo, 0.0) AS total_counts_ribo, round(100 * total_counts_ribo / nullif(total_counts, 0), 6) AS pct_counts_ribo
  FROM cells LEFT JOIN sums USING (cell_id)
)"""

QC_CELL_METRICS = f"WITH {_SUMS} SELECT * FROM metrics"

QC_GENE_METRICS = f"""WITH {_CELLS}, {_GENES}, {_EXPR}, n AS (SELECT count(*) AS n FROM cells), g AS (
  SELECT gene_id, count(*) FILTER (value <> 0) AS c, sum(value) AS t FROM expr GROUP BY gene_id)
SELECT gene_id, coalesce(c, 0) AS n_cells_by_counts, round(coalesce(t, 0.0) / n, 6) AS mean_counts,
  round((1 - coalesce(c, 0) / n::DOUBLE) * 100, 6) AS pct_dropout_by_counts, round(coalesce(t, 0.0), 6) AS total_counts
FROM genes LEFT JOIN g USING (gene_id) CROSS JOIN n"""

QC_CELLRANK = f"""WITH {_SUMS}, r AS (
  SELECT cell_id, total_counts, n_genes_by_counts, pct_counts_mt,
    row_number() OVER (ORDER BY total_counts DESC NULLS LAST, cell_id) AS cellrank_total_counts,
    row_number() OVER (ORDER BY n_genes_by_counts DESC NULLS LAST, cell_id) AS cellrank_n_genes_by_counts,
    row_number() OVER (ORDER BY pct_counts_mt DESC NULLS LAST, cell_id) AS cellrank_pct_counts_mt
  FROM metrics)
SELECT *, cellrank_pct_counts_mt AS cell_index FROM r"""

QC_GATED_CLASSES = f"""WITH {_GENES}, c AS (SELECT count(*) FILTER (is_mt) AS mt, count(*) FILTER (is_ribo) AS ribo FROM genes)
SELECT 'mt' AS class, mt AS n_genes, mt > 0 AS enabled, mt > 0 AS enabled_reference FROM c
UNION ALL SELECT 'ribo', ribo, ribo > 0, mt > 0 FROM c"""

SUMMARY_TABLE = """SELECT 'AnnData' AS "AtlasFileType", count(DISTINCT c_custkey) AS "NbCells", count(DISTINCT o_orderpriority) AS "NbGenes",
  starts_with(c_mktsegment, 'A') AS "AnnData.raw", true AS "AnnData.X", c_mktsegment AS "File_extension", '/atlases/' || c_mktsegment || '.h5ad' AS "File_path"
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"""

_MANIFEST = "m AS (SELECT r_name AS atlas, n_nationkey % 5 AS slot, n_name AS key, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _slot(k: int, name: str) -> str:
    return f"'<code>' || coalesce(string_agg(key, '</code><br><code>' ORDER BY pos) FILTER (slot = {k}), '') || '</code>' AS {name}"


STRUCTURE_TABLE = f"WITH {_MANIFEST} SELECT atlas, {', '.join(_slot(k, n) for k, n in enumerate(('atlas_obs', 'obsm', 'var', 'varm', 'uns')))} FROM m GROUP BY atlas"

UNIQUE_NAMES = """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey AS gene_pos, p_name AS gene_name, CASE WHEN k = 0 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM r"""

POSITIONAL_NAMES = "SELECT p_partkey AS gene_pos, p_name || '_' || p_partkey AS gene_name FROM part"

VIABLE_ANNOTATION = """WITH k AS (
  SELECT 'celltype' AS key, count(DISTINCT p_type) AS n_categories, count(*) FILTER (p_type IS NULL) AS missing FROM part
  UNION ALL SELECT 'seurat_clusters', count(DISTINCT p_brand), count(*) FILTER (p_brand IS NULL) FROM part
  UNION ALL SELECT 'leiden', count(DISTINCT p_type) FILTER (p_size > 1), count(*) FILTER (NOT coalesce(p_size > 1, false) OR p_type IS NULL) FROM part
  UNION ALL SELECT 'louvain', 1, 0)
SELECT key, n_categories FROM k WHERE missing = 0 AND n_categories <> 1"""

REPRESENTATION_CHOICE = """WITH m AS (
  SELECT r_name AS atlas, n_nationkey AS pos, CASE n_nationkey % 4 WHEN 0 THEN 'X_pca' WHEN 1 THEN 'X_tsne' WHEN 2 THEN 'X_umap' ELSE 'X_scvi' END || '_' || n_nationkey AS key
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 > 2)
SELECT atlas, coalesce(min_by(key, pos) FILTER (regexp_matches(key, '^.*umap*.')), min_by(key, pos) FILTER (regexp_matches(key, '^.*tsne*.')), '') AS obsm_key
FROM m GROUP BY atlas"""

_PATHS = """p AS (SELECT page_id AS seq, '/data/run' || page_id % 7 || '/atlas' || page_id % 60 || CASE page_id % 5 WHEN 0 THEN '.h5ad'
  WHEN 1 THEN '/outs/filtered_feature_bc_matrix.h5' WHEN 2 THEN '/outs/filtered_gene_bc_matrices/hg19/matrix.mtx' WHEN 3 THEN '.rds' ELSE '/notes.txt' END AS path FROM pages),
c AS (SELECT 'atlas' || seq % 60 AS "Atlas_name", CASE seq % 5 WHEN 0 THEN 'AnnData' WHEN 1 THEN 'Cellranger >= v3' WHEN 2 THEN 'Cellranger < v3' ELSE 'Seurat' END AS "Atlas_type",
  CASE seq % 5 WHEN 0 THEN '.h5ad' WHEN 1 THEN '.h5' WHEN 2 THEN '.mtx' ELSE '.rds' END AS "Atlas_extension", path AS "Atlas_path", seq FROM p WHERE seq % 5 < 4)"""

CATALOG_CLASSIFY = f'WITH {_PATHS} SELECT "Atlas_name", "Atlas_type", "Atlas_extension", "Atlas_path" FROM c'

CATALOG_UPSERT = f"""WITH {_PATHS}
SELECT "Atlas_name", max_by("Atlas_type", seq) AS "Atlas_type", max_by("Atlas_extension", seq) AS "Atlas_extension", max_by("Atlas_path", seq) AS "Atlas_path"
FROM c GROUP BY "Atlas_name\""""

BARCODE_ATTACH = "SELECT c_custkey AS cell_id, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS cluster FROM customer"

CONTINGENCY = "SELECT p_type AS a, p_brand AS b, count(*) AS n_ij FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL"
ENCODE_LABELS = "SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT p_type AS label FROM part WHERE p_type IS NOT NULL)"


def _agreement(a: str, b: str, rows: str = "part") -> str:
    """CTEs ``s``: pairs within cells (t), rows (pa), columns (pb); entropies ha and hb, mutual information mi, and n."""
    return f"""ct AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n_ij FROM {rows} GROUP BY ALL),
ma AS (SELECT a, sum(n_ij) AS x FROM ct GROUP BY a), mb AS (SELECT b, sum(n_ij) AS y FROM ct GROUP BY b), n AS (SELECT sum(n_ij) AS n FROM ct),
s AS (SELECT (SELECT n FROM n) AS n, (SELECT sum(n_ij * (n_ij - 1) / 2) FROM ct) AS t, (SELECT sum(x * (x - 1) / 2) FROM ma) AS pa, (SELECT sum(y * (y - 1) / 2) FROM mb) AS pb,
  (SELECT -sum(x / n * ln(x / n)) FROM ma, n) AS ha, (SELECT -sum(y / n * ln(y / n)) FROM mb, n) AS hb,
  (SELECT sum(n_ij / n * ln(n * n_ij / (x * y))) FROM ct JOIN ma USING (a) JOIN mb USING (b), n) AS mi)"""


_ARI = "(t - pa * pb / (n * (n - 1) / 2)) / nullif((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2), 0)"
_FMI = "t / nullif(sqrt(pa * pb), 0)"
_V = "CASE WHEN ha + hb > 1e-14 THEN 2 * mi / (ha + hb) ELSE 1 END"
_PART = _agreement("p_type", "p_brand")
ADJUSTED_RAND = f"WITH {_PART} SELECT round(coalesce({_ARI}, 1), 6) AS value FROM s"
FOWLKES_MALLOWS = f"WITH {_PART} SELECT round(coalesce({_FMI}, 0), 6) AS value FROM s"
MUTUAL_INFORMATION = f"WITH {_PART} SELECT round(mi, 6) AS value FROM s"
V_MEASURE = f"WITH {_PART} SELECT round({_V}, 6) AS value FROM s"
ADJ_MUTUAL_INFO = f"""WITH {_PART}, k AS (SELECT unnest(range(0, (SELECT n::BIGINT FROM n) + 1)) AS i),
lf AS (SELECT i, sum(ln(greatest(i, 1)::DOUBLE)) OVER (ORDER BY i) AS l FROM k),
pr AS (SELECT x::BIGINT AS x, y::BIGINT AS y, n::BIGINT AS n FROM ma, mb, n),
tm AS (SELECT x, y, n, unnest(range(greatest(1, x + y - n), least(x, y) + 1)) AS m FROM pr),
e AS (SELECT sum(m / n::DOUBLE * ln(n * m / (x * y)::DOUBLE) * exp(a.l + b.l + c.l + d.l - f.l - g.l - h.l - i.l - j.l)) AS emi
  FROM tm JOIN lf a ON a.i = x JOIN lf b ON b.i = y JOIN lf c ON c.i = n - x JOIN lf d ON d.i = n - y JOIN lf f ON f.i = n
  JOIN lf g ON g.i = m JOIN lf h ON h.i = x - m JOIN lf i ON i.i = y - m JOIN lf j ON j.i = n - x - y + m)
SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS value FROM s, e"""
ZERO = "SELECT 0.0::DOUBLE AS value"

def _centres(label: str) -> str:
    return f"""p AS (SELECT vec_id, {label} AS label, embedding::DOUBLE[] AS vec FROM embeddings),
d AS (SELECT vec_id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM p),
c AS (SELECT label, i, avg(v) AS c FROM d GROUP BY ALL), z AS (SELECT label, count(*)::DOUBLE AS n FROM p GROUP BY label)"""


def _davies(label: str) -> str:
    return f"""{_centres(label)},
r AS (SELECT vec_id, label, sqrt(sum((v - c) * (v - c))) AS r FROM d JOIN c USING (label, i) GROUP BY ALL), s AS (SELECT label, avg(r) AS s FROM r GROUP BY label),
m AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
w AS (SELECT la, max(coalesce((sa.s + sb.s) / nullif(m, 0), 0)) AS w FROM m JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)"""


def _calinski(label: str) -> str:
    return f"""{_centres(label)},
o AS (SELECT i, avg(v) AS o FROM d GROUP BY i), wi AS (SELECT sum((v - c) * (v - c)) AS w FROM d JOIN c USING (label, i)),
be AS (SELECT sum(n * (c - o) * (c - o)) AS b FROM c JOIN o USING (i) JOIN z USING (label)), kn AS (SELECT count(*) AS k, sum(n) AS n FROM z)"""


DAVIES_BOULDIN = f"WITH {_davies('label')} SELECT round(avg(w), 6) AS value FROM w"
CALINSKI_HARABASZ = f"WITH {_calinski('label')} SELECT round(b * (n - k) / (w * (k - 1)), 6) AS value FROM wi, be, kn"
SILHOUETTE = """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings), z AS (SELECT label, count(*)::DOUBLE AS n FROM p GROUP BY label),
t AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.vec, b.vec)) AS t FROM p a, p b GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN t / n END) AS b
  FROM t JOIN z ON z.label = other GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM s"""
KRUSKAL_STRESS = """WITH p AS (SELECT embedding::DOUBLE[] AS h, embedding[1:2]::DOUBLE[] AS l FROM embeddings),
d AS (SELECT list_distance(a.h, b.h) AS h, list_distance(a.l, b.l) AS l FROM p a, p b)
SELECT round(sqrt(sum((h - l) * (h - l)) / sum(l * l)), 6) AS value FROM d"""


def _pivot(label: str) -> str:
    return f"""SELECT 'atlas_{label}' AS "Clust_Sample", '{label}' AS obs, (WITH {_davies('label' if label == 'label' else 'label % 3')} SELECT round(avg(w), 6) FROM w) AS davies_bouldin,
  (WITH {_calinski('label' if label == 'label' else 'label % 3')} SELECT round(b * (n - k) / (w * (k - 1)), 6) FROM wi, be, kn) AS calinski_harabasz, -1.0::DOUBLE AS no_such_metric"""


METRIC_PIVOT = f"{_pivot('label')} UNION ALL {_pivot('label_mod')}"


def _annotation(key: str, column: str) -> str:
    with_ = _agreement("p_type", column)
    each = [f"(WITH {with_} SELECT round({x}, 6) FROM s) AS {n}" for x, n in ((f"coalesce({_ARI}, 1)", "rand_index"), (_V, "vmeasure"), (f"coalesce({_FMI}, 0)", "fowlkes_mallow"))]
    return f"""SELECT 'atlas_{key}' AS "Annot_Sample", 'celltype' AS "Reference", '{key}' AS obs, {', '.join(each)}, 0.0::DOUBLE AS dunn_index"""


METRIC_ANNOTATION = f"{_annotation('louvain', chr(39) + 'one' + chr(39))} UNION ALL {_annotation('seurat_clusters', 'p_brand')}"

_MEANS = """ty AS (SELECT s_nationkey AS celltype, count(*) AS n FROM supplier GROUP BY 1), ge AS (SELECT DISTINCT p_partkey % 20 AS gene FROM part),
su AS (SELECT s_nationkey AS celltype, l_partkey % 20 AS gene, sum(l_quantity) AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
me AS (SELECT celltype, gene, coalesce(t, 0.0) / n AS value FROM ty CROSS JOIN ge LEFT JOIN su USING (celltype, gene)),
al AS (SELECT celltype, gene, value / nullif(sum(value) OVER (PARTITION BY gene), 0) AS value FROM me),
rk AS (SELECT celltype, gene, value, row_number() OVER (PARTITION BY gene ORDER BY value DESC, celltype) AS k, max(value) OVER (PARTITION BY gene) AS m FROM me),
tw AS (SELECT gene, value AS second FROM rk WHERE k = 2),
mx AS (SELECT celltype, gene, value / nullif(CASE WHEN k = 1 THEN second ELSE m END, 0) AS value FROM rk LEFT JOIN tw USING (gene)),
sh AS (SELECT gene, -sum(CASE WHEN value > 0 THEN value * ln(value) ELSE 0 END) AS value FROM al GROUP BY gene),
ta AS (SELECT gene, sum(1 - value / nullif(m, 0)) / nullif(count(*) - 1, 0) AS value FROM rk GROUP BY gene),
ri AS (SELECT gene, value, row_number() OVER (PARTITION BY gene ORDER BY value, celltype) AS i, count(*) OVER (PARTITION BY gene) AS n FROM me),
gi AS (SELECT gene, sum((2 * i - n - 1) * value) / nullif(max(n) * sum(value), 0) AS value FROM ri GROUP BY gene)"""


def _of(name: str, where: str = "") -> str:
    columns = "gene" if name in ("sh", "ta", "gi") else "celltype, gene"
    return f"WITH {_MEANS} SELECT {columns}, round(value, 6) AS value FROM {name} {where}"


_MARKERS = "mk AS (SELECT n_nationkey AS celltype, n_nationkey % 12 AS gene, n_nationkey AS pos FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 10, n_nationkey FROM nation)"
SPECIFICITY_SUMMARY = f"""WITH {_MEANS}, {_MARKERS}, la AS (SELECT gene, max_by(celltype, pos) AS expected FROM mk GROUP BY gene),
be AS (SELECT gene, celltype, value FROM mx QUALIFY row_number() OVER (PARTITION BY gene ORDER BY value DESC NULLS LAST, celltype DESC) = 1)
SELECT la.gene, expected AS "expected celltype", be.celltype AS "most expressed celltype", round(be.value, 6) AS one_v_max,
  round(sh.value, 6) AS shannon, round(ta.value, 6) AS tau, round(gi.value, 6) AS gini
FROM la JOIN be USING (gene) JOIN sh USING (gene) JOIN ta USING (gene) JOIN gi USING (gene)"""
MARKER_INTERSECTION = f"WITH {_MEANS}, {_MARKERS} SELECT DISTINCT celltype, gene FROM mk WHERE celltype IN (SELECT celltype FROM me) AND gene IN (SELECT gene FROM me)"


def _violin(key: str) -> str:
    q = ", ".join(f"round(quantile_disc({key}, {p})::DOUBLE, 6) AS {n}" for n, p in (("least", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("most", 1)))
    return f"SELECT '{key}' AS key, count({key}) AS n, {q} FROM metrics WHERE {key} IS NOT NULL"


VIOLIN_SUMMARY = f"WITH {_SUMS} " + " UNION ALL ".join(map(_violin, ("n_genes_by_counts", "total_counts", "pct_counts_mt", "pct_counts_ribo")))


SAMPLED_CELLS = """
SELECT c_custkey AS cell_id FROM customer ORDER BY md5('7|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50
"""

NAMES_UNIQUE = """SELECT 'p_brand' AS name, count(DISTINCT coalesce(p_brand, '')) = count(*) AS is_unique FROM part
UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) = count(*) FROM part"""
CLEAN_GENES = """SELECT p_partkey AS gene_pos, p_brand || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS gene_name
FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)"""
CLEAN_RAW_GENES = """SELECT p_partkey AS gene_pos, CASE WHEN (SELECT count(DISTINCT p_brand) < count(*) FROM part) THEN p_brand || '_' || p_partkey ELSE p_brand END AS gene_name FROM part"""
CATEGORICAL_CLUSTERS = """SELECT s_suppkey AS cell_id, CAST(s_nationkey AS VARCHAR) AS louvain, CAST(s_nationkey % 3 AS VARCHAR) AS leiden_coarse, CAST(s_nationkey AS INTEGER) AS batch FROM supplier"""
EMBEDDING_KEYS = f"WITH {_MANIFEST} SELECT atlas, key, pos FROM m WHERE slot = 1"
SEURAT_ANNOTATION = VIABLE_ANNOTATION.replace("missing = 0 AND ", "")
SEURAT_SUMMARY = """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'Seurat' AS "AtlasFileType", coalesce(c.n, 0) AS "NbCells", coalesce(g.n, 0) AS "NbGenes", false AS "AnnData.raw", true AS "AnnData.X", '.rds' AS "File_extension",
  '/atlases/' || n_name || '.rds' AS "File_path" FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN g ON g.k = n_nationkey"""
SEURAT_STRUCTURE = f"""WITH {_MANIFEST}
SELECT atlas, {', '.join(_slot(k, n) for k, n in ((0, 'atlas_obs'), (1, 'obsm'), (4, 'uns')))}, '<code></code>' AS var, '<code></code>' AS varm FROM m GROUP BY atlas"""
REDUCTION_METRICS = f"""SELECT 'scanpy_low' AS "Dimred_Sample", 'low' AS obsm, ({KRUSKAL_STRESS}) AS kruskal_stress, 0.0::DOUBLE AS spearman_rho
UNION ALL SELECT 'seurat_low', 'low', NULL, NULL"""
PROJECTION_ATTACH = "SELECT 'X_umap' AS obsm_key, c_custkey AS cell_id, round(c_acctbal::DOUBLE, 6) AS x, c_nationkey::DOUBLE AS y FROM customer"
PROJECTION_SKIPPED = "SELECT 'all' AS rows, true AS taken UNION ALL SELECT 'some', count(*) FILTER (c_acctbal > 0) = count(*) FROM customer"
ATLAS_LOOKUP = f"""WITH {_PATHS}, r AS (
  SELECT regexp_extract("Atlas_path", '/(run[0-9]+)/', 1) AS run, CASE "Atlas_type" WHEN 'AnnData' THEN 1 WHEN 'Seurat' THEN 3 ELSE 2 END AS family, * FROM c)
SELECT run AS "Atlas_name", "Atlas_type", "Atlas_extension", "Atlas_path" FROM r WHERE family > 1 OR CAST(run[4:] AS INTEGER) % 2 = 1
QUALIFY row_number() OVER (PARTITION BY run ORDER BY family, seq DESC) = 1"""
MATRIX_MARKET = """SELECT CAST(l_suppkey AS VARCHAR) AS cell_id, 'gene' || l_partkey % 20 AS gene_id, round(sum(l_quantity)::DOUBLE, 6) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
GENE_METRIC_LOOKUP = f"WITH {_MEANS} " + " UNION ALL ".join(f"SELECT gene, round(value, 6) AS value, '{m}' AS metric FROM {t}" for m, t in (("shannon", "sh"), ("tau", "ta"), ("gini", "gi")))


def oracle_sql() -> dict[str, str]:
    return {
        "qc_cell_metrics": QC_CELL_METRICS,
        "qc_gene_metrics": QC_GENE_METRICS,
        "qc_cellrank": QC_CELLRANK,
        "qc_gated_classes": QC_GATED_CLASSES,
        "summary_table": SUMMARY_TABLE,
        "structure_table": STRUCTURE_TABLE,
        "unique_names": UNIQUE_NAMES,
        "positional_names": POSITIONAL_NAMES,
        "viable_annotation": VIABLE_ANNOTATION,
        "representation_choice": REPRESENTATION_CHOICE,
        "catalog_classify": CATALOG_CLASSIFY,
        "catalog_upsert": CATALOG_UPSERT,
        "barcode_attach": BARCODE_ATTACH,
        "contingency": CONTINGENCY,
        "encode_labels": ENCODE_LABELS,
        "adjusted_rand": ADJUSTED_RAND,
        "fowlkes_mallows": FOWLKES_MALLOWS,
        "mutual_information": MUTUAL_INFORMATION,
        "v_measure": V_MEASURE,
        "adj_mutual_info": ADJ_MUTUAL_INFO,
        "dunn_index": ZERO,
        "davies_bouldin": DAVIES_BOULDIN,
        "calinski_harabasz": CALINSKI_HARABASZ,
        "silhouette": SILHOUETTE,
        "kruskal_stress": KRUSKAL_STRESS,
        "spearman_rho": ZERO,
        "metric_pivot": METRIC_PIVOT,
        "metric_annotation": METRIC_ANNOTATION,
        "avg_expression": _of("me"),
        "one_v_all": _of("al"),
        "one_v_max": _of("mx"),
        "shannon": _of("sh"),
        "tau": _of("ta"),
        "gini": _of("gi"),
        "unpivot_gt1": _of("mx", "WHERE value > 1"),
        "specificity_summary": SPECIFICITY_SUMMARY,
        "marker_intersection": MARKER_INTERSECTION,
        "violin_summary": VIOLIN_SUMMARY,
        "sampled_cells": SAMPLED_CELLS,
        "names_unique": NAMES_UNIQUE,
        "clean_genes": CLEAN_GENES,
        "clean_raw_genes": CLEAN_RAW_GENES,
        "categorical_clusters": CATEGORICAL_CLUSTERS,
        "embedding_keys": EMBEDDING_KEYS,
        "seurat_annotation": SEURAT_ANNOTATION,
        "seurat_summary": SEURAT_SUMMARY,
        "seurat_structure": SEURAT_STRUCTURE,
        "reduction_metrics": REDUCTION_METRICS,
        "projection_attach": PROJECTION_ATTACH,
        "projection_skipped": PROJECTION_SKIPPED,
        "atlas_lookup": ATLAS_LOOKUP,
        "matrix_market": MATRIX_MARKET,
        "gene_metric_lookup": GENE_METRIC_LOOKUP,
        "seurat_qc_cellrank": QC_CELLRANK,
    }
