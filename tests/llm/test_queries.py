import os

import pytest
from oracle_compare import connect, differences

import __spark_entry__
from cellspan.llm import common, oracle, queries

CONTRACT = {
    "op1": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2": {"doc_id": "bigint", "toxic": "boolean"},
    "op3": {"doc_id": "bigint", "score": "double", "kept": "boolean"},
    "op4": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == list(CONTRACT) and "pipeline" in names
    assert set(oracle.oracle_sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_rows(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name.split("_")[0]]} == CONTRACT[name.split("_")[0]]
    table = "pages" if name.startswith("op6") else "documents"
    key = df.columns[0]
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows_as_sql(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), oracle.oracle_sql()[name]) == []


def test_forget(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    (tmp_path / "cellspan" / "another-application").mkdir(parents=True)
    assert common.materialise(spark.range(3), "x").count() == 3 and len(os.listdir(tmp_path / "cellspan")) == 2
    common.forget(spark)
    assert os.listdir(tmp_path / "cellspan") == ["another-application"]
