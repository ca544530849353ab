"""Quality metrics of cells and genes, their gating by gene classes, ranks and sampling.

Inputs: ``cells(cell_id, cell_pos, ...)``, ``genes(gene_id, is_mt, is_ribo, ...)`` and the nonzero entries ``expr(cell_id, gene_id, value)``.
Cells and genes come from their own tables, so those without any nonzero entry count too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.functions.durable import numbered
from cellspan.functions.numeric import without_nan

CLASSES = ("mt", "ribo")


def gene_classes(genes: DataFrame, name_col: str = "gene_name", mt: tuple[str, ...] = ("MT-",), ribo: tuple[str, ...] = ("RPS", "RPL")) -> DataFrame:
    """``genes`` with ``is_mt`` and ``is_ribo`` by case-sensitive prefixes; a null name is in no class."""

    def starts(prefixes: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | F.col(name_col).startswith(p)
        return F.coalesce(found, F.lit(False))

    return genes.withColumn("is_mt", starts(mt)).withColumn("is_ribo", starts(ribo))


def gates(genes: DataFrame, strict: bool = False) -> dict[str, bool]:
    """Which classes are computed: both if any mitochondrial gene exists; each by its own genes if ``strict``."""
    found = genes.agg(F.coalesce(F.bool_or("is_mt"), F.lit(False)).alias("mt"), F.coalesce(F.bool_or("is_ribo"), F.lit(False)).alias("ribo")).first()
    return {"mt": found.mt, "ribo": found.ribo if strict else found.mt}


def gate_table(genes: DataFrame) -> DataFrame:
    """``(class, n_genes, enabled, enabled_reference)``: own gate, and the gate that tests mitochondrial genes for both."""
    n = genes.agg(*[F.count_if(F.col(f"is_{c}")).alias(c) for c in CLASSES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n_genes"), F.col("mt").alias("n_mt")) for c in CLASSES]))
    found = n.select(rows.alias("r"))
    return found.select("r.class", "r.n_genes", (F.col("r.n_genes") > 0).alias("enabled"), (F.col("r.n_mt") > 0).alias("enabled_reference"))


def cell_metrics(cells: DataFrame, genes: DataFrame, expr: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Per cell ``n_genes_by_counts``, ``total_counts`` and for each class ``total_counts_*`` and ``pct_counts_*``.

    The share of a cell without counts is NULL.  Only genes that are in a class are joined, and entries are summed by cell
    before cells are.
    """
    sums = [F.count_if(F.col("value") != 0).alias("n_genes_by_counts"), F.sum("value").alias("total_counts")]
    if classes:
        flags = genes.select("gene_id", *[f"is_{c}" for c in classes]).where(" OR ".join(f"is_{c}" for c in classes))
        expr = expr.join(flags, "gene_id", "left")
        sums += [F.sum(F.when(F.col(f"is_{c}"), F.col("value")).otherwise(0.0)).alias(f"total_counts_{c}") for c in classes]
    summed = expr.groupBy("cell_id").agg(*sums)
    zero = {"n_genes_by_counts": 0, "total_counts": 0.0} | {f"total_counts_{c}": 0.0 for c in classes}
    found = cells.select("cell_id", "cell_pos").join(summed, "cell_id", "left").fillna(zero)
    for c in classes:
        found = found.withColumn(f"pct_counts_{c}", F.try_divide(F.col(f"total_counts_{c}") * 100, F.col("total_counts")))
    return found


def gene_metrics(cells: DataFrame, genes: DataFrame, expr: DataFrame) -> DataFrame:
    """Per gene ``n_cells_by_counts``, ``mean_counts`` and ``pct_dropout_by_counts`` over all cells, and ``total_counts``."""
    n = cells.agg(F.count("*").alias("n_cells"))  # one row
    summed = expr.groupBy("gene_id").agg(F.count_if(F.col("value") != 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    found = genes.select("gene_id").join(summed, "gene_id", "left").fillna({"n_cells_by_counts": 0, "total_counts": 0.0}).join(F.broadcast(n))
    return found.select(
        "gene_id",
        "n_cells_by_counts",
        F.try_divide("total_counts", "n_cells").alias("mean_counts"),
        ((F.lit(1) - F.try_divide("n_cells_by_counts", "n_cells")) * 100).alias("pct_dropout_by_counts"),
        "total_counts",
    )


def ranked(metrics: DataFrame, keys: list[str], cell_limit: int = 0, seed: int = 0) -> DataFrame:
    """The QC table: ``keys``, ``cellrank_<key>`` from 1 at the highest value, a sample if limited, then ``cell_index``.

    NaN and NULL rank last, ties in the order of ``cell_pos``; rows are in the order of the last key.
    """
    if not keys:
        return metrics.limit(0).withColumn("cell_index", F.lit(None).cast("long"))
    found = metrics.select("cell_id", "cell_pos", *keys)
    for key in keys:
        found = numbered(found, without_nan(F.col(key)).desc_nulls_last(), F.col("cell_pos"), name=f"cellrank_{key}")
    last = f"cellrank_{keys[-1]}"
    if cell_limit:
        found = sampled(found, cell_limit, seed)
        found = numbered(found, F.col(last), name="cell_index")
    else:
        found = found.withColumn("cell_index", F.col(last))
    return found.select("cell_id", *keys, *[f"cellrank_{k}" for k in keys], "cell_index")


def sampled(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """``limit`` rows without replacement if there are more (in the order of the MD5 of seed and values), all otherwise or if the limit is 0."""
    if not limit:
        return df
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *values)), *df.columns).limit(limit)


def violin_summary(metrics: DataFrame, keys: list[str], bins: int = 30) -> DataFrame:
    """What a violin figure shows of each key: ``(key, n, least, q1, median, q3, most)``; computed without regard to gates."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys])).alias("x"))
    q = F.percentile_approx("x.v", [0.0, 0.25, 0.5, 0.75, 1.0], 10_000)
    return long.where(F.col("x.v").isNotNull()).groupBy("x.key").agg(F.count("*").alias("n"), q.alias("q")).select(
        "key", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))]
    )
