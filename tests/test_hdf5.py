"""HDF5 atlases, read through a stand-in for ``h5py`` whose files are pickled dictionaries."""

import pickle

import numpy as np
import pytest

from cellspan.sources import bundle, catalog

STAND_IN = '''
import pickle


class Dataset:
    def __init__(self, values, attrs=None):
        self.values, self.attrs, self.dtype = values, attrs or {}, values.dtype

    def __getitem__(self, at):
        return self.values[at]

    def __len__(self):
        return len(self.values)


class Group:
    def __init__(self, parts, attrs=None):
        self.parts, self.attrs = parts, attrs or {}

    def __getitem__(self, path):
        first, _, rest = path.partition("/")
        return self.parts[first][rest] if rest else self.parts[first]

    def __contains__(self, key):
        return key in self.parts

    def __iter__(self):
        return iter(self.parts)


def made(x):
    if isinstance(x, dict):
        return Group({k: made(v) for k, v in x.items() if k != "@"}, x.get("@"))
    return Dataset(x)


class File(Group):
    def __init__(self, path, mode):
        with open(path, "rb") as f:
            whole = made(pickle.load(f))
        super().__init__(whole.parts, whole.attrs)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False
'''


@pytest.fixture(scope="module")
def stand_in(spark, tmp_path_factory):
    import sys

    folder = tmp_path_factory.mktemp("standin")
    (folder / "h5py.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(folder / "h5py.py"))
    sys.path.insert(0, str(folder))
    yield
    sys.path.remove(str(folder))
    sys.modules.pop("h5py", None)


X = np.array([[5.0, 0, 2], [0, 0, 1], [3, 4, 0], [0, 0, 0]])


def compressed(x, kind):
    rows = x if kind == "csr" else x.T
    at = [np.flatnonzero(r) for r in rows]
    return {"@": {"encoding-type": f"{kind}_matrix"}, "indptr": np.cumsum([0, *map(len, at)]), "indices": np.concatenate(at), "data": np.concatenate([r[i] for r, i in zip(rows, at)])}


def texts(*values):
    return np.array([v.encode() for v in values], object)


def atlas(x):
    obs = {
        "@": {"_index": "names", "column-order": ["louvain", "depth", "known", "part"]},
        "names": texts("c1", "c2", "c3", "c4"),
        "louvain": {"categories": texts("T", "B"), "codes": np.array([0, 1, -1, 0])},
        "depth": np.array([1.5, 2.0, np.nan, 0.0]),
        "known": np.array([True, False, True, True]),
        "part": {"values": np.array([7, 8, 9, 10]), "mask": np.array([False, True, False, False])},
    }
    var = {"@": {"_index": "_index", "column-order": []}, "_index": texts("MT-A", "G", "H")}
    return {"X": x, "obs": obs, "var": var, "obsm": {"X_umap": np.arange(8.0).reshape(4, 2)}, "layers": {"counts": X}, "raw": {"var": var}}


def put(path, tree):
    with open(path, "wb") as f:
        pickle.dump(tree, f)


@pytest.mark.parametrize("kind", ["csr", "csc", "dense"])
def test_h5ad_of_each_encoding(spark, stand_in, tmp_path, monkeypatch, kind):
    put(tmp_path / "a.h5ad", atlas(X if kind == "dense" else compressed(X, kind)))
    found = bundle.read(spark, {"Atlas_name": "a", "Atlas_type": catalog.ANNDATA, "Atlas_path": str(tmp_path / "a.h5ad")})
    assert {(r.cell_id, r.gene_id): r.value for r in found.expr.collect()} == {
        ("c1", "MT-A"): 5, ("c1", "H"): 2, ("c2", "H"): 1, ("c3", "MT-A"): 3, ("c3", "G"): 4,
    }
    rows = found.cells.orderBy("cell_pos").collect()
    assert [r.louvain for r in rows] == ["T", "B", None, "T"] and [r.part for r in rows] == [7, None, 9, 10] and [r.known for r in rows] == [True, False, True, True]
    assert [r.vec for r in found.embed.orderBy("cell_id").collect()] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert found.has_raw and found.raw_genes.count() == 3 and found.categories == {"louvain": ["T", "B"]}
    assert {r.key for r in found.manifest.where("slot = 'layers'").collect()} == {"counts"}


def test_old_categories_and_unknown_kinds(spark, stand_in, tmp_path):
    tree = atlas(compressed(X, "csr"))
    tree["X"]["@"] = {"h5sparse_format": "csr"}
    tree["obs"]["louvain"] = np.array([1, 0, 0, -1])
    tree["obs"]["__categories"] = {"louvain": texts("T", "B")}
    put(tmp_path / "b.h5ad", tree)
    record = {"Atlas_name": "b", "Atlas_type": catalog.ANNDATA, "Atlas_path": str(tmp_path / "b.h5ad")}
    assert [r.louvain for r in bundle.read(spark, record).cells.orderBy("cell_pos").collect()] == ["B", "T", "T", None]
    tree["X"]["@"] = {"encoding-type": "coo_matrix"}
    put(tmp_path / "b.h5ad", tree)
    with pytest.raises(ValueError, match="coo_matrix"):
        bundle.read(spark, record)


def test_tenx_h5(spark, stand_in, tmp_path):
    path = tmp_path / "p" / "outs" / catalog.NEW_FILE
    path.parent.mkdir(parents=True)
    matrix = compressed(X, "csr") | {"barcodes": texts("c1", "c2", "c3", "c4"), "features": {"id": texts("E1", "E2", "E3"), "name": texts("MT-A", "G", "H")}}
    put(path, {"matrix": matrix})
    found = bundle.read(spark, {"Atlas_name": "p", "Atlas_type": catalog.CELLRANGER_NEW, "Atlas_path": str(path)})
    assert {(r.cell_id, r.gene_id): r.value for r in found.expr.collect()}[("c3", "E2")] == 4 and found.expr.count() == 5
    assert [r.gene_name for r in found.genes.orderBy("gene_pos").collect()] == ["MT-A", "G", "H"]
