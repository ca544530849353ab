"""Agreement of two annotations, all from one contingency table.

Every metric is a function of sums over the contingency's cells, so the table is built once for all metrics.  Rows where either
label is missing don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions.numeric import log_factorial, pairs_of


#: Of the expected mutual information: how far from the mean terms count, and counts of a span.
FAR, SPAN = 40.0, 4_096


def encode_labels(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, code)``: codes from 0 in the order of the labels; only the distinct labels meet in one window."""
    labels = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label")).distinct()
    return labels.withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("long"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n_ij)`` of the pairs that occur."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n_ij"))


def sums(table: DataFrame) -> DataFrame:
    """One row of sums: pairs within cells, rows and columns, and n ln n of each, and the number of labels."""
    n, of_a, of_b = F.col("n_ij").cast("double"), F.col("n_a").cast("double"), F.col("n_b").cast("double")
    wide = table.withColumn("n_a", F.sum("n_ij").over(Window.partitionBy("a"))).withColumn("n_b", F.sum("n_ij").over(Window.partitionBy("b")))
    return wide.agg(
        F.coalesce(F.sum("n_ij"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(pairs_of(F.col("n_ij"))), F.lit(0.0)).alias("t"),
        F.coalesce(F.sum(n * (of_a - 1) / 2), F.lit(0.0)).alias("pa"),
        F.coalesce(F.sum(n * (of_b - 1) / 2), F.lit(0.0)).alias("pb"),
        F.coalesce(F.sum(n * F.ln(n)), F.lit(0.0)).alias("nl"),
        F.coalesce(F.sum(n * F.ln(of_a)), F.lit(0.0)).alias("al"),
        F.coalesce(F.sum(n * F.ln(of_b)), F.lit(0.0)).alias("bl"),
        F.count_distinct("a").alias("ka"),
        F.count_distinct("b").alias("kb"),
    )


def _mi() -> Column:
    return F.try_divide(F.col("nl") - F.col("al") - F.col("bl"), F.col("n").cast("double")) + F.ln(F.greatest(F.col("n"), F.lit(1)).cast("double"))


def _entropy(side: str) -> Column:
    return F.ln(F.greatest(F.col("n"), F.lit(1)).cast("double")) - F.try_divide(F.col(f"{side}l"), F.col("n").cast("double"))


def _adjusted_rand() -> Column:
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs_of(F.col("n")))
    return F.when(F.col("n") > 0, F.coalesce(F.try_divide(F.col("t") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)))


def _fowlkes_mallows() -> Column:
    return F.when(F.col("n") > 0, F.coalesce(F.try_divide(F.col("t"), F.sqrt(F.col("pa") * F.col("pb"))), F.lit(0.0)))


def _v_measure() -> Column:
    both = _entropy("a") + _entropy("b")
    return F.when(F.col("n") > 0, F.when(both > 1e-14, F.lit(2.0) * _mi() / both).otherwise(F.lit(1.0)))


def expected_mi(table: DataFrame) -> DataFrame:
    """One row ``emi``: the expected mutual information of two random partitions with the same label sizes.

    Label sizes are grouped with their multiplicity, so that equal ones are worked out once; ln(n!) is a closed expression.
    Terms farther than ``FAR`` standard deviations (and as many counts) from the mean are below a double's precision and left out; the others go out in
    spans of ``SPAN`` counts, so no row holds more, and large labels are worked out by many tasks.
    """
    size_a = table.groupBy("a").agg(F.sum("n_ij").alias("x")).groupBy("x").agg(F.count("*").alias("mx"))
    size_b = table.groupBy("b").agg(F.sum("n_ij").alias("y")).groupBy("y").agg(F.count("*").alias("my"))
    n = table.agg(F.sum("n_ij").alias("n"))
    pairs = size_a.crossJoin(size_b).crossJoin(n)  # distinct sizes: at most the square root of 2n on each side
    xd, yd, nd = (F.col(c).cast("double") for c in ("x", "y", "n"))
    mean = xd * yd / nd
    far = FAR * (F.sqrt(F.greatest(F.lit(0.0), mean * (1 - xd / nd) * (nd - yd) / F.greatest(nd - 1, F.lit(1.0)))) + 1)
    low = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - F.col("n"), F.floor(mean - far))
    ends = pairs.select("*", low.alias("low"), F.least(F.col("x"), F.col("y"), F.ceil(mean + far)).alias("high"))
    spans = ends.withColumn("from", F.explode(F.sequence("low", F.greatest("low", "high"), F.lit(SPAN).cast("long")))).repartition("x", "y", "from")
    until = F.least(F.col("high"), F.col("from") + SPAN - 1)
    terms = spans.where(F.col("from") <= F.col("high")).select("x", "y", "n", "mx", "my", F.explode(F.sequence("from", until)).alias("m"))
    x, y, n_, m = (F.col(c) for c in ("x", "y", "n", "m"))
    log = (
        log_factorial(x) + log_factorial(y) + log_factorial(n_ - x) + log_factorial(n_ - y)
        - log_factorial(n_) - log_factorial(m) - log_factorial(x - m) - log_factorial(y - m) - log_factorial(n_ - x - y + m)
    )
    d = [c.cast("double") for c in (x, y, n_, m)]
    term = d[3] / d[2] * F.ln(d[2] * d[3] / (d[0] * d[1])) * F.exp(log) * F.col("mx") * F.col("my")
    return terms.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    return sums(table).select(_adjusted_rand().alias("value"))


def fowlkes_mallows(table: DataFrame) -> DataFrame:
    return sums(table).select(_fowlkes_mallows().alias("value"))


def mutual_information(table: DataFrame) -> DataFrame:
    return sums(table).select(F.when(F.col("n") > 0, F.greatest(_mi(), F.lit(0.0))).alias("value"))


def v_measure(table: DataFrame) -> DataFrame:
    return sums(table).select(_v_measure().alias("value"))


def adj_mutual_info(table: DataFrame) -> DataFrame:
    """Arithmetic mean of the entropies as normaliser; two partitions of one label each (or none) agree perfectly."""
    found = sums(table).crossJoin(expected_mi(table))
    mean = (_entropy("a") + _entropy("b")) / 2
    value = F.try_divide(_mi() - F.col("emi"), mean - F.col("emi"))
    trivial = (F.col("ka") == F.col("kb")) & (F.col("ka") <= 1)
    return found.select(F.when(trivial, F.lit(1.0)).otherwise(F.coalesce(value, F.lit(1.0))).alias("value"))


def dunn_index(table: DataFrame) -> DataFrame:
    """Always 0, as the metric of this name is defined for annotations."""
    return table.agg(F.lit(0.0).alias("value"))
