"""HDF5 atlases (``.h5ad`` and 10x ``.h5``), where ``h5py`` is installed.

The driver reads names of columns, kinds and categories; cells, entries and embeddings are read in slices of ``SLICE`` on the executors, which need the file at the
same path.  Matrices are dense, or compressed by cells (CSR) or by genes (CSC), as their ``encoding-type`` says (``h5sparse_format`` in older files).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.sources import catalog
from cellspan.sources.bundle import EMBED, MANIFEST, Bundle, with_companions

#: Rows of the longer way (cells, or genes of a matrix that is compressed by genes) of a slice.
SLICE = 4_096


class UnknownEncoding(ValueError):
    """A matrix that is neither dense nor compressed by cells or genes."""


def _text(values) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def _sliced(spark: SparkSession, path: str, rows: int, schema: str, part: Callable) -> DataFrame:
    """The frames that ``part(file, start, end)`` makes of each slice of ``rows`` rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        with h5py.File(path, "r") as f:
            for batch in batches:
                for k in batch["id"]:
                    yield part(f, int(k) * SLICE, min((int(k) + 1) * SLICE, rows))

    slices = -(-rows // SLICE)
    return spark.range(0, slices, 1, max(1, slices)).mapInPandas(read, schema)


def _encoding(matrix) -> str:
    """``dense``, ``csr`` or ``csc``."""
    kind = matrix.attrs.get("encoding-type", None) or matrix.attrs.get("h5sparse_format", None)
    kind = kind.decode() if isinstance(kind, bytes) else kind
    if hasattr(matrix, "dtype") and kind in (None, "array"):
        return "dense"
    if kind in ("csr_matrix", "csr", "csc_matrix", "csc"):
        return kind[:3]
    raise UnknownEncoding(f"a matrix of the kind {kind}")


def _entries(spark: SparkSession, path: str, group: str, kind: str, cells: int, genes: int) -> DataFrame:
    """``(cell_pos, gene_pos, value)`` of a matrix's nonzero entries."""

    def compressed(f, start: int, end: int) -> pd.DataFrame:
        import numpy as np

        g = f[group]
        ends = np.asarray(g["indptr"][start : end + 1])
        a, b = int(ends[0]), int(ends[-1])
        found = {"long": np.repeat(np.arange(len(ends) - 1), np.diff(ends)) + start, "short": np.asarray(g["indices"][a:b]).astype("int64")}
        cell, gene = ("long", "short") if kind == "csr" else ("short", "long")
        return pd.DataFrame({"cell_pos": found[cell], "gene_pos": found[gene], "value": np.asarray(g["data"][a:b]).astype("float64")})

    def dense(f, start: int, end: int) -> pd.DataFrame:
        import numpy as np

        x = np.asarray(f[group][start:end]).astype("float64")
        cell, gene = np.nonzero(x)
        return pd.DataFrame({"cell_pos": cell + start, "gene_pos": gene, "value": x[cell, gene]})

    schema = "cell_pos long, gene_pos long, value double"
    return _sliced(spark, path, genes if kind == "csc" else cells, schema, dense if kind == "dense" else compressed).where("value <> 0")


def _named(entries: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    return entries.join(cells.select("cell_pos", "cell_id"), "cell_pos").join(genes.select("gene_pos", "gene_id"), "gene_pos").select("cell_id", "gene_id", "value")


def _names(spark: SparkSession, path: str, rows: int, name: str, *columns: tuple[str, str]) -> DataFrame:
    """A table of text datasets ``(column, place in the file)`` and the position ``<name>_pos``."""

    def part(f, start: int, end: int) -> pd.DataFrame:
        return pd.DataFrame({**{c: _text(f[at][start:end]) for c, at in columns}, f"{name}_pos": range(start, end)})

    return _sliced(spark, path, rows, ", ".join(f"{c} string" for c, _ in columns) + f", {name}_pos long", part)


def read_tenx_h5(spark: SparkSession, path: str, name: str) -> Bundle:
    import h5py

    with h5py.File(path, "r") as f:
        n_cells, n_genes = len(f["matrix"]["barcodes"]), len(f["matrix"]["features"]["id"])
    cells = _names(spark, path, n_cells, "cell", ("cell_id", "matrix/barcodes"))
    genes = _names(spark, path, n_genes, "gene", ("gene_id", "matrix/features/id"), ("gene_name", "matrix/features/name"))
    # Genes by cells, compressed by columns: that is by cells.
    expr = _named(_entries(spark, path, "matrix", "csr", n_cells, n_genes), cells, genes)
    return with_companions(spark, name, catalog.CELLRANGER_NEW, path, cells, genes, expr)


#: Spark types of an HDF5 column by the kind of its numbers.
_KINDS = {"b": "boolean", "i": "long", "u": "long", "f": "double"}


def _column(obs, key: str) -> tuple[str, list[str] | None]:
    """Spark type of a column of a table, and its categories if it has any (as a group, or beside the table in older files)."""
    held = obs[key]
    if not hasattr(held, "dtype"):
        if "categories" in held:
            return "string", _text(held["categories"][:])
        return _KINDS.get(held["values"].dtype.kind, "string"), None  # nullable: values and a mask
    if "__categories" in obs and key in obs["__categories"]:
        return "string", _text(obs["__categories"][key][:])
    return _KINDS.get(held.dtype.kind, "string"), None


def _values(held, kind: str, known: list[str] | None, start: int, end: int) -> list:
    if known is not None:
        return [known[c] if c >= 0 else None for c in (held if hasattr(held, "dtype") else held["codes"])[start:end]]
    if not hasattr(held, "dtype"):
        return [None if m else v.item() for v, m in zip(held["values"][start:end], held["mask"][start:end], strict=True)]
    return _text(held[start:end]) if kind == "string" else [v.item() for v in held[start:end]]


def _table(spark: SparkSession, path: str, group: str, rows: int, index: str, columns: dict[str, tuple[str, list[str] | None]]) -> DataFrame:
    """``(cell_id, columns..., cell_pos)`` of the table of cells."""

    def part(f, start: int, end: int) -> pd.DataFrame:
        obs = f[group]
        made = {"cell_id": _text(obs[index][start:end])}
        for key, (kind, known) in columns.items():
            values = _values(obs[key], kind, known, start, end)
            made[key] = pd.array(values, dtype="Int64" if kind == "long" else "boolean" if kind == "boolean" else "object") if kind != "double" else pd.array(values, dtype="Float64")
        return pd.DataFrame(made | {"cell_pos": range(start, end)})

    schema = "cell_id string, " + "".join(f"`{c}` {kind}, " for c, (kind, _) in columns.items()) + "cell_pos long"
    return _sliced(spark, path, rows, schema, part)


def _embedding(spark: SparkSession, path: str, key: str, rows: int) -> DataFrame:
    def part(f, start: int, end: int) -> pd.DataFrame:
        return pd.DataFrame({"obsm_key": key, "cell_pos": range(start, end), "vec": [[float(x) for x in v] for v in f["obsm"][key][start:end]]})

    return _sliced(spark, path, rows, "obsm_key string, cell_pos long, vec array<double>", part)


def read_h5ad(spark: SparkSession, path: str, name: str) -> Bundle:
    import h5py

    manifest = []
    with h5py.File(path, "r") as f:
        obs, var = f["obs"], f["var"]
        index, var_index = obs.attrs.get("_index", "_index"), var.attrs.get("_index", "_index")
        keys = [k for k in obs.attrs.get("column-order", [k for k in obs if k not in (index, "__categories")])]
        columns = {k: _column(obs, k) for k in keys}
        n_cells, n_genes = len(obs[index]), len(var[var_index])
        manifest += [("obs", k, i) for i, k in enumerate(keys)]
        for slot in ("obsm", "varm", "uns", "layers"):
            manifest += [(slot, k, i) for i, k in enumerate(f[slot])] if slot in f else []
        manifest += [("var", k, i) for i, k in enumerate(var.attrs.get("column-order", []))]
        embeddings = [k for k in (f["obsm"] if "obsm" in f else ()) if hasattr(f["obsm"][k], "dtype")]
        raw = (f["raw/var"].attrs.get("_index", "_index"), len(f["raw/var"][f["raw/var"].attrs.get("_index", "_index")])) if "raw" in f else None
        kind = _encoding(f["X"])
    cells = _table(spark, path, "obs", n_cells, index, columns)
    genes = _names(spark, path, n_genes, "gene", ("gene_id", f"var/{var_index}")).withColumn("gene_name", F.col("gene_id"))
    embed = spark.createDataFrame([], EMBED)
    for key in embeddings:
        embed = embed.unionByName(_embedding(spark, path, key, n_cells).join(cells.select("cell_pos", "cell_id"), "cell_pos").select("obsm_key", "cell_id", "vec"))
    expr = _named(_entries(spark, path, "X", kind, n_cells, n_genes), cells, genes)
    raw_genes = _names(spark, path, raw[1], "gene", ("gene_id", f"raw/var/{raw[0]}")).withColumn("gene_name", F.col("gene_id")) if raw else None
    categories = {k: known for k, (_, known) in columns.items() if known is not None}
    return Bundle(name, catalog.ANNDATA, cells, genes, expr, embed, spark.createDataFrame(manifest, MANIFEST), raw is not None, raw_genes, categories)
