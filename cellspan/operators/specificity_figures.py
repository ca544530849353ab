"""Distributions of specificity values: histograms that Spark counts, drawn as SVG from at most a few hundred bars."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators import specificity

BINS = 40


def histogram(values: DataFrame, column: str = "value", bins: int = BINS, by: str | None = None) -> DataFrame:
    """``([by,] bin, start, stop, n)`` of equal bins over the range of all values; NULL and NaN don't count."""
    known = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    span = known.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    counted = known.crossJoin(F.broadcast(span)).groupBy(*keys, at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("start"), (F.col("lo") + (F.col("bin") + 1) * width).alias("stop"), "n")


def histogram_svg(rows: list, title: str, marks: list[tuple[str, float]] = ()) -> str:
    """Bars of :func:`histogram` with labelled marks."""
    out = [f'<text x="10" y="15">{html.escape(title)}</text>']
    if rows:
        lo, hi, most = min(r.start for r in rows), max(r.stop for r in rows), max(r.n for r in rows)
        span = (hi - lo) or 1.0
        for r in rows:
            h = 200 * r.n / most
            out.append(f'<rect x="{20 + 560 * (r.start - lo) / span:.1f}" y="{230 - h:.1f}" width="{max(1.0, 560 * (r.stop - r.start) / span - 1):.1f}" height="{h:.1f}" fill="#4477aa"/>')
        for name, v in marks:
            x = 20 + 560 * (v - lo) / span
            out.append(f'<line x1="{x:.1f}" x2="{x:.1f}" y1="25" y2="230" stroke="#ee6677"/><text x="{x:.1f}" y="245" text-anchor="middle">{html.escape(name)}</text>')
        out.append(f'<text x="20" y="260">{lo:.4g}</text><text x="580" y="260" text-anchor="end">{hi:.4g}</text>')
    return '<svg xmlns="http://www.w3.org/2000/svg" width="600" height="270" font-family="sans-serif" font-size="11">' + "".join(out) + "</svg>"


def gene_distribution(means: DataFrame, gene: str) -> str:
    """A gene's means over the types, each marked, with its three metrics (2 digits, half to even) in the title."""
    own = means.where(F.col("gene") == gene)
    values = {n: f(own).select(F.bround("value", 2).alias("v")).first() for n, f in specificity.SPECIFICITY.items()}
    title = f"{gene}: " + ", ".join(f"{n} {r.v}" for n, r in values.items() if r is not None)
    marks = [(str(r.celltype), r.value) for r in own.orderBy("celltype").collect()]  # a row for each type
    return histogram_svg(histogram(own).collect(), title, marks)


def ratio_distribution(means: DataFrame, celltype: str, highlighted: list[str] = ()) -> str:
    """A type's ratios to the largest other mean above 1; highlighted genes are marked instead of counted."""
    mine = specificity.above_one(specificity.one_v_max(means)).where(F.col("celltype") == celltype)
    marked = F.col("gene").isin(list(highlighted)) if highlighted else F.lit(False)
    marks = [(str(r.gene), r.value) for r in mine.where(marked).collect()] if highlighted else []
    return histogram_svg(histogram(mine.where(~marked)).collect(), f"ratios above 1 in {celltype}", marks)


def marker_ratios(means: DataFrame, genes: list[str]) -> DataFrame:
    """``(gene, celltype, value)``: for each listed gene the type of its largest ratio, and that ratio."""
    mine = specificity.one_v_max(means.where(F.col("gene").isin(list(genes))))
    best = mine.where("value IS NOT NULL").groupBy("gene").agg(F.max(F.struct("value", "celltype")).alias("b"))
    return best.select("gene", "b.celltype", "b.value")


def metric_distribution(means: DataFrame, name: str) -> str:
    """All genes' values of one metric."""
    return histogram_svg(histogram(specificity.gene_metric(means, name)).collect(), name)
