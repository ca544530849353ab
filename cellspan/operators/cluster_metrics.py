"""Separation of labelled points: silhouette, Davies-Bouldin and Calinski-Harabasz.

``points`` has an id, a label and an array of doubles.  Rows with a missing label or vector don't take part.  Fewer than two labels, or as
many as points, give NULL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.functions.durable import written
from cellspan.operators.pairwise import block_sums, distances


def labelled(points: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """``(label, vec)`` with double vectors."""
    rows = points.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    return rows.select(F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(_squared(a, b))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _dimensions(rows: DataFrame) -> int:
    first = rows.select(F.size("vec").alias("d")).first()
    return first.d if first else 0


def centroids(rows: DataFrame) -> DataFrame:
    """``(label, n, centre)``: one aggregation with a mean for each dimension, combined before the shuffle."""
    d = _dimensions(rows)
    means = [F.avg(F.get("vec", F.lit(i))) for i in range(d)]
    return rows.groupBy("label").agg(F.count("*").alias("n"), (F.array(*means) if means else F.array().cast("array<double>")).alias("centre"))


def _with_centre(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Written: a few rows whose size Spark then knows, so it broadcasts them only if they are small.
    centres = written(centroids(rows), "centroids")
    return rows.join(centres, "label"), centres


def davies_bouldin(points: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    rows, centres = _with_centre(labelled(points, label_col, vec_col))
    scatter = rows.groupBy("label").agg(F.avg(_distance(F.col("vec"), F.col("centre"))).alias("s"))
    own = centres.join(scatter, "label").select("label", "n", "s", "centre")
    other = own.select(F.col("label").alias("label_j"), F.col("s").alias("s_j"), F.col("centre").alias("centre_j"))
    apart = _distance(F.col("centre"), F.col("centre_j"))
    ratio = F.when(apart > 0, F.try_divide(F.col("s") + F.col("s_j"), apart)).otherwise(F.lit(0.0))
    worst = own.join(other, F.col("label") != F.col("label_j")).groupBy("label").agg(F.max(ratio).alias("r"), F.max("n").alias("n"))
    return worst.agg(F.when((F.count("*") >= 2) & (F.count("*") < F.sum("n")), F.avg("r")).alias("value"))


def calinski_harabasz(points: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    rows, centres = _with_centre(labelled(points, label_col, vec_col))
    within = rows.agg(F.sum(_squared(F.col("vec"), F.col("centre"))).alias("w"))
    d = _dimensions(centres.withColumnRenamed("centre", "vec"))
    total = F.sum("n").cast("double")
    mean = F.array(*[F.try_divide(F.sum(F.get("centre", F.lit(i)) * F.col("n")), total) for i in range(d)]) if d else F.array().cast("array<double>")
    overall = centres.agg(F.count("*").alias("k"), F.sum("n").alias("total"), mean.alias("mean"))
    between = centres.crossJoin(overall).agg(  # one row on the right
        F.sum(F.col("n") * _squared(F.col("centre"), F.col("mean"))).alias("b"), F.max("k").alias("k"), F.max("total").alias("total")
    )
    k, n = F.col("k").cast("double"), F.col("total").cast("double")
    value = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("b") * (n - k), F.col("w") * (k - 1)))
    return between.crossJoin(within).select(F.when((k >= 2) & (k < n), value).alias("value"))


def silhouette(points: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """Mean Euclidean silhouette over all points, exact, from sums of distances by point and label.

    A task holds one block of points and their sums, an array of labels each, and lets a share of all blocks pass by; so what it hands over is a row of sums for
    each point, whatever the number of blocks, and these meet by block.
    """
    rows = labelled(points, label_col, vec_col)
    sizes = {r.label: r["size"] for r in rows.groupBy("label").agg(F.count("*").alias("size")).collect()}  # one for each label
    labels = sorted(sizes)
    codes = points.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, code int")
    table = written(rows.join(F.broadcast(codes), "label").select(F.monotonically_increasing_id().alias("row"), "code", "vec"), "points")
    size = np.array([sizes[x] for x in labels], float)

    def sums(left, rights):
        total = np.zeros((len(left["row"]), len(size)))
        order = np.argsort(left["row"])
        for right in rights:
            d = distances(left["vec"], right["vec"])
            at = np.searchsorted(left["row"], right["row"], sorter=order)
            mine = order[np.minimum(at, len(order) - 1)]
            same = np.flatnonzero(left["row"][mine] == right["row"])
            d[mine[same], same] = 0.0
            one = np.zeros((len(right["row"]), len(size)))
            one[np.arange(len(one)), right["code"]] = 1.0
            total += d @ one
        return total

    def score(left, total):
        each, own = np.arange(len(total)), left["code"]
        alone = size[own] <= 1
        a = total[each, own] / np.maximum(size[own] - 1, 1)
        others = total / size
        others[each, own] = np.inf
        b = others.min(axis=1) if len(size) > 1 else np.zeros(len(total))
        most = np.maximum(a, b)
        s = np.where(alone | (most == 0), 0.0, (b - a) / np.where(most == 0, 1.0, most))
        return float(s.sum()), len(s)

    found = block_sums(table, "vec", len(labels), sums, score)
    k = len(labels)
    value = F.when(F.lit(k >= 2) & (F.sum("n") > k), F.sum("total") / F.sum("n").cast("double"))
    return found.agg(value.alias("value"))
