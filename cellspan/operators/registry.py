"""Metrics by family and name, and the tables that hold a column for each requested one.

A metric is a function to a DataFrame of one row and one column ``value``.  An unknown name gives -1 and a warning.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import annotation_metrics, cluster_metrics, reduction_metrics

logger = logging.getLogger(__name__)

_METRICS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "cluster": {
        "silhouette": cluster_metrics.silhouette,
        "davies_bouldin": cluster_metrics.davies_bouldin,
        "calinski_harabasz": cluster_metrics.calinski_harabasz,
    },
    "annot": {
        "rand_index": annotation_metrics.adjusted_rand,
        "fowlkes_mallow": annotation_metrics.fowlkes_mallows,
        "adj_mutual_info": annotation_metrics.adj_mutual_info,
        "vmeasure": annotation_metrics.v_measure,
        "dunn_index": annotation_metrics.dunn_index,
    },
    "dimred": {"kruskal_stress": reduction_metrics.kruskal_stress, "spearman_rho": reduction_metrics.spearman_rho},
}
#: What the command line asks for unless told otherwise.
DEFAULTS = {"cluster": ["davies_bouldin"], "annot": ["rand_index"], "dimred": []}


def register_metric(family: str, name: str, function: Callable[..., DataFrame]) -> None:
    _METRICS.setdefault(family, {})[name] = function


def names(family: str) -> list[str]:
    return list(_METRICS[family])


def measure(spark: SparkSession, family: str, name: str, *args) -> DataFrame:
    function = _METRICS.get(family, {}).get(name)
    if function is None:
        logger.warning("%s is not a metric of the family %s", name, family)
        return spark.range(1).select(F.lit(-1.0).alias("value"))
    return function(*args)


def _row(spark: SparkSession, identifiers: dict[str, str], family: str, metrics: list[str], args: tuple) -> DataFrame:
    found = spark.range(1).select(*[F.lit(v).alias(k) for k, v in identifiers.items()])
    for name in metrics:  # tables of one row
        found = found.crossJoin(measure(spark, family, name, *args).select(F.col("value").alias(name)))
    return found


def _together(rows: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None


def cluster_table(points: DataFrame, atlas: str, keys: list[str], vec_col: str, metrics: list[str] | None = None) -> DataFrame | None:
    """``(Clust_Sample, obs, <metric>...)``, a row for each annotation key; None without keys."""
    spark, metrics = points.sparkSession, DEFAULTS["cluster"] if metrics is None else metrics
    return _together([_row(spark, {"Clust_Sample": f"{atlas}_{k}", "obs": k}, "cluster", metrics, (points, k, vec_col)) for k in keys])


def annotation_table(cells: DataFrame, atlas: str, keys: list[str], metrics: list[str] | None = None) -> DataFrame | None:
    """``(Annot_Sample, Reference, obs, <metric>...)``: each later key against the first; None with less than two keys."""
    spark, metrics = cells.sparkSession, DEFAULTS["annot"] if metrics is None else metrics
    reference, rows = (keys or [""])[0], []
    for k in keys[1:]:
        table = annotation_metrics.contingency(cells, reference, k)
        rows.append(_row(spark, {"Annot_Sample": f"{atlas}_{k}", "Reference": reference, "obs": k}, "annot", metrics, (table,)))
    return _together(rows)


def reduction_table(points: DataFrame, atlas: str, high_col: str, keys: list[str], metrics: list[str] | None = None, seurat: bool = False) -> DataFrame | None:
    """``(Dimred_Sample, obsm, <metric>...)``, a row for each embedding; metric columns of Seurat atlases are NULL."""
    spark, metrics = points.sparkSession, DEFAULTS["dimred"] if metrics is None else metrics
    rows = []
    for k in keys:
        identifiers = {"Dimred_Sample": f"{atlas}_{k}", "obsm": k}
        if seurat:
            logger.warning("no reduction metrics for Seurat atlases")
            rows.append(spark.range(1).select(*[F.lit(v).alias(n) for n, v in identifiers.items()], *[F.lit(None).cast("double").alias(m) for m in metrics]))
        else:
            rows.append(_row(spark, identifiers, "dimred", metrics, (points, high_col, k)))
    return _together(rows)
