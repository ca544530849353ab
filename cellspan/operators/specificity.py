"""Cell-type specificity of genes, in long form: ``(celltype, gene, value)``.

A division by zero gives NULL.  Genes that no cell of any type expresses have NULL shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions.durable import written
from cellspan.functions.numeric import plogp, without_nan

def _of_gene():
    return Window.partitionBy("gene")


def mean_expression(cells: DataFrame, expr: DataFrame, genes: DataFrame, type_col: str = "celltype") -> DataFrame:
    """Mean of every gene in every type that has cells, cells without an entry counting as 0.

    ``cells(cell_id, celltype)``, ``expr(cell_id, gene, value)``, ``genes(gene)``.  The entries are summed by type and gene; only the
    sums meet the full grid of types and genes.
    """
    known = cells.where(F.col(type_col).isNotNull()).select("cell_id", F.col(type_col).alias("celltype"))
    sizes = known.groupBy("celltype").agg(F.count("*").alias("n"))
    sums = expr.join(known, "cell_id").groupBy("celltype", "gene").agg(F.sum("value").alias("total"))
    grid = sizes.crossJoin(genes.select("gene").distinct())  # the result's own rows
    return grid.join(sums, ["celltype", "gene"], "left").select("celltype", "gene", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("value"))


_means: dict = {}


def mean_expression_once(key: str, cells: DataFrame, expr: DataFrame, genes: DataFrame, type_col: str = "celltype") -> DataFrame:
    """The same, written once for a key (an atlas and its annotation) and read again on later calls."""
    at = (cells.sparkSession.sparkContext.applicationId, key, type_col)
    if at not in _means:
        _means[at] = written(mean_expression(cells, expr, genes, type_col), "means")
    return _means[at]


def one_v_all(means: DataFrame) -> DataFrame:
    return means.withColumn("value", F.try_divide("value", F.sum("value").over(_of_gene())))


def one_v_max(means: DataFrame) -> DataFrame:
    """Mean over the largest mean of the other types (the whole matrix, not only the best type)."""
    order = _of_gene().orderBy(F.desc("value"), "celltype")
    rank, first = F.row_number().over(order), F.max("value").over(_of_gene())
    second = F.nth_value("value", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return means.withColumn("value", F.try_divide(F.col("value"), F.when(rank == 1, second).otherwise(first)))


def shannon(means: DataFrame) -> DataFrame:
    """``(gene, value)``: entropy of the shares of the types, natural logarithm."""
    return one_v_all(means).groupBy("gene").agg((-F.sum(plogp(F.col("value")))).alias("value"))


def tau(means: DataFrame) -> DataFrame:
    part = means.withColumn("x", F.lit(1.0) - F.try_divide("value", F.max("value").over(_of_gene())))
    return part.groupBy("gene").agg(F.try_divide(F.sum("x"), F.count("*") - 1).alias("value"))


def gini(means: DataFrame) -> DataFrame:
    i = F.row_number().over(_of_gene().orderBy("value", "celltype"))
    part = means.withColumn("n", F.count("*").over(_of_gene())).withColumn("x", (2 * i - F.col("n") - 1) * F.col("value"))
    return part.groupBy("gene").agg(F.try_divide(F.sum("x"), F.max("n") * F.sum("value")).alias("value"))


SPECIFICITY = {"shannon": shannon, "tau": tau, "gini": gini}


def gene_metric(means: DataFrame, name: str) -> DataFrame:
    if name not in SPECIFICITY:
        raise ValueError(f"{name} is not one of {', '.join(SPECIFICITY)}")
    return SPECIFICITY[name](means)


def marker_table(spark, markers: dict[str, list[str]]) -> DataFrame:
    """``(celltype, gene, pos)`` of a marker dictionary, in its order."""
    rows = [(t, g) for t, genes in markers.items() for g in genes]
    return spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], "celltype string, gene string, pos long")


def _best() -> Column:
    return without_nan(F.col("value"))


def summary(means: DataFrame, markers: DataFrame) -> DataFrame:
    """For each marker gene that the atlas has: expected and most expressed type, best ratio and the three metrics.

    ``markers(celltype, gene, pos)``; a gene that is listed several times keeps the last type.
    """
    last = markers.groupBy("gene").agg(F.max_by("celltype", "pos").alias("expected celltype"))
    # Only the markers' rows, and written: the four metrics look at single genes, and none of them works out the means again.
    means = written(means.join(last.select("gene"), "gene", "left_semi"), "marker-means")
    ratio = one_v_max(means)
    best = ratio.groupBy("gene").agg(
        F.max_by("celltype", F.when(_best().isNotNull(), F.struct(_best(), F.col("celltype")))).alias("most expressed celltype"), F.max(_best()).alias("one_v_max")
    )
    found = last.join(best, "gene")
    for name, metric in SPECIFICITY.items():
        found = found.join(metric(means).withColumnRenamed("value", name), "gene")
    return found.select("gene", "expected celltype", "most expressed celltype", "one_v_max", *SPECIFICITY)


def marker_intersection(means: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers whose type and gene both occur in the atlas: ``(celltype, gene)``."""
    types, genes = means.select("celltype").distinct(), means.select("gene").distinct()
    return markers.join(types, "celltype", "left_semi").join(genes, "gene", "left_semi").select("celltype", "gene").distinct()


def above_one(ratios: DataFrame) -> DataFrame:
    """The ratios above 1, as figures show them."""
    return ratios.where(F.col("value") > 1)


def unpivoted(wide: DataFrame, id_col: str = "celltype") -> DataFrame:
    """A wide matrix (a column for each gene) in long form."""
    genes = [c for c in wide.columns if c != id_col]
    return wide.unpivot([id_col], [f"`{g}`" for g in genes], "gene", "value")
