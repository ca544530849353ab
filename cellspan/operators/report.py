"""Tables as TSV files, figures as SVG, and tabbed HTML reports.

The driver sees ``DRIVER_ROWS`` rows of a table and ``FIGURE_POINTS`` points of a figure at most: a larger table is written by the executors, as a folder of
parts in place of the file, and a larger scatter is drawn as a grid of ``GRID`` x ``GRID`` counted cells.
"""

from __future__ import annotations

import html
import logging
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import qc, select
from cellspan.sources import catalog

logger = logging.getLogger(__name__)

DRIVER_ROWS, FIGURE_POINTS, GRID = 100_000, 10_000, 160

_COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb", "#222255", "#dd7700", "#117733")


def write_tsv(df: DataFrame, path: str) -> None:
    """A table as one file with a header, tab separated; of more than ``DRIVER_ROWS`` rows, as a folder of such files."""
    first = df.limit(DRIVER_ROWS + 1).toPandas()
    if len(first) > DRIVER_ROWS:
        if os.path.isfile(path):
            os.remove(path)
        write_tsv_folder(df, path)
        return
    if os.path.isdir(path):  # of an earlier, larger table
        shutil.rmtree(path)
    first.to_csv(path, sep="\t", index=False)


def write_tsv_folder(df: DataFrame, path: str) -> None:
    """A table of any size as a folder of TSV parts, written by the executors."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All summary tables below a working folder in one, with a column ``Sample`` from the file's name."""
    found = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(catalog.folder(path, "summary"), "*" + catalog.TSV))
    return found.withColumn("Sample", F.regexp_extract(F.input_file_name(), r"([^/]+)\.tsv$", 1))


def _svg(body: list[str], width: int, height: int) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">' + "".join(body) + "</svg>"


def violin_svg(summary: list) -> str:
    """A panel for each row of :func:`qc.violin_summary`: whiskers over the range, a box over the quartiles, a line at the median."""
    out = []
    for i, r in enumerate(summary):
        span = (r.most - r.least) or 1.0
        y = {k: 180 - 150 * (getattr(r, k) - r.least) / span for k in ("least", "q1", "median", "q3", "most")}
        x = 60 + 120 * i
        out.append(f'<line x1="{x}" x2="{x}" y1="{y["least"]:.1f}" y2="{y["most"]:.1f}" stroke="#555"/>')
        out.append(f'<rect x="{x - 20}" width="40" y="{y["q3"]:.1f}" height="{max(1.0, y["q1"] - y["q3"]):.1f}" fill="{_COLOURS[i % len(_COLOURS)]}" opacity="0.7"/>')
        out.append(f'<line x1="{x - 20}" x2="{x + 20}" y1="{y["median"]:.1f}" y2="{y["median"]:.1f}" stroke="#000"/>')
        out.append(f'<text x="{x}" y="200" text-anchor="middle">{html.escape(r.key)}</text><text x="{x}" y="20" text-anchor="middle">{r.most:.4g}</text>')
    return _svg(out, 120 * max(1, len(summary)), 210)


def scatter_svg(rows: list[tuple[float, float, str | None]], title: str) -> str:
    """Points of a plane (at most ``FIGURE_POINTS``, or a grid's cells), coloured by label."""
    out = [f'<text x="10" y="15">{html.escape(title)}</text>']
    if rows:
        xs, ys = [r[0] for r in rows], [r[1] for r in rows]
        w, h = (max(xs) - min(xs)) or 1.0, (max(ys) - min(ys)) or 1.0
        labels = sorted({r[2] for r in rows if r[2] is not None})
        colour = {k: _COLOURS[i % len(_COLOURS)] for i, k in enumerate(labels)}
        out += [f'<circle cx="{20 + 460 * (x - min(xs)) / w:.1f}" cy="{480 - 450 * (y - min(ys)) / h:.1f}" r="2" fill="{colour.get(k, "#4477aa")}"/>' for x, y, k in rows]
        out += [f'<text x="505" y="{30 + 15 * i}" fill="{colour[k]}">{html.escape(k)}</text>' for i, k in enumerate(labels)]
    return _svg(out, 640, 500)


def write_violin(metrics: DataFrame, path: str, keys: tuple[str, ...] = ("n_genes_by_counts", "total_counts", "pct_counts_mt", "pct_counts_ribo")) -> None:
    keys = [k for k in keys if k in metrics.columns]
    found = {r.key: r for r in qc.violin_summary(metrics, keys).collect()} if keys else {}  # a row for each key
    _write(path, violin_svg([found[k] for k in keys if k in found]))


def binned(rows: DataFrame, grid: int = GRID) -> DataFrame:
    """``(x, y, k, n)`` of a grid's cells that hold points ``rows(x, y, k)``: their middle, most frequent label (the first in a tie) and number."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "least"), (F.max, "most"))])  # one row
    at = {c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"least_{c}"), F.col(f"most_{c}") - F.col(f"least_{c}")), F.lit(0.0)) * grid), F.lit(grid - 1)) for c in ("x", "y")}
    place = rows.join(F.broadcast(ends)).select(*[at[c].alias(f"at_{c}") for c in at], *[F.col(f"least_{c}") for c in at], *[(F.col(f"most_{c}") - F.col(f"least_{c}")).alias(f"span_{c}") for c in at], "k")
    counted = place.groupBy("at_x", "at_y", "least_x", "least_y", "span_x", "span_y", "k").agg(F.count("*").alias("n"))
    best = counted.groupBy("at_x", "at_y", "least_x", "least_y", "span_x", "span_y").agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("k"), F.sum("n").alias("n"))
    return best.select(*[(F.col(f"least_{c}") + F.col(f"span_{c}") * (F.col(f"at_{c}") + 0.5) / grid).alias(c) for c in ("x", "y")], "k", "n")


def write_scatter(points: DataFrame, label_col: str | None, path: str, title: str, limit: int = 10_000) -> None:
    """The first two dimensions of ``points.vec``; ``limit`` points at most (0: all), as a grid of cells if there are more than ``FIGURE_POINTS``."""
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")
    rows = points.where(F.size("vec") >= 2).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), label.alias("k"))
    rows = qc.sampled(rows, limit)
    shown = rows.limit(FIGURE_POINTS + 1).collect()
    if len(shown) > FIGURE_POINTS:
        shown = binned(rows).select("x", "y", "k").collect()
    _write(path, scatter_svg([tuple(r) for r in shown], title))


def _write(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def tabbed_html(kind: str, figures: dict[str, str]) -> str:
    """A page with a tab for each figure, the first one open; an element's id is ``<kind>_<name>``."""
    tabs, parts = [], []
    for i, (name, path) in enumerate(figures.items()):
        at, shown = html.escape(f"{kind}_{name}", quote=True), html.escape(name)
        tabs.append(f'<button class="{kind}_tab{" active" if i == 0 else ""}" data-for="{at}">{shown}</button>')
        parts.append(f'<div id="{at}" class="{kind}_figure" style="display: {"block" if i == 0 else "none"};"><img src="{html.escape(path, quote=True)}" alt="{shown}"></div>')
    script = (
        f"document.querySelectorAll('.{kind}_tab').forEach(tab => tab.onclick = () => {{"
        f"document.querySelectorAll('.{kind}_figure').forEach(f => f.style.display = f.id === tab.dataset.for ? 'block' : 'none');"
        f"document.querySelectorAll('.{kind}_tab').forEach(t => t.classList.toggle('active', t === tab)); }});"
    )
    return "\n".join(["<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8">', f"<title>{kind}</title></head><body>", *tabs, *parts, f"<script>{script}</script>", "</body></html>", ""])


def write_reports(path: str, kind: str) -> list[str]:
    """The pages of a kind (``qc``, or ``reductions`` for UMAP and t-SNE) that have figures; their paths."""
    folders: dict[str, list[tuple[str, str]]] = {"qc": [("qc", "violin")], "reductions": [("umap", "umap"), ("tsne", "tsne")]}
    if kind not in folders:
        logger.error("no report of the kind %s", kind)
        return []
    made = []
    for name, sub in folders[kind]:
        here = catalog.folder(path, sub)
        figures = {os.path.splitext(f)[0]: os.path.join(sub, f) for f in sorted(os.listdir(here)) if f.endswith(".svg")} if os.path.isdir(here) else {}
        if figures:
            _write(catalog.report_path(path, name), tabbed_html(name, figures))
            made.append(catalog.report_path(path, name))
    return made


def marker_run(means: DataFrame, markers: DataFrame, spark: SparkSession, path: str, summarise: Callable[..., DataFrame]) -> str:
    """Specificity summary of the markers that an atlas has, as ``spec_summary.tsv`` in a folder named by the time; its path."""
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyMMdd_HHmm").alias("t")).first().t
    into = os.path.join(catalog.folder(path, "specificity"), stamp)
    os.makedirs(into, exist_ok=True)
    write_tsv(summarise(means, markers), os.path.join(into, "spec_summary.tsv"))
    return os.path.join(into, "spec_summary.tsv")


def default_keys(columns: list[str]) -> list[str]:
    return select.qc_keys(columns)
