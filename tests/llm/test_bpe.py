import hashlib
import struct

import numpy as np
import pytest

from cellspan.llm import bpe, pretokens, queries


@pytest.mark.parametrize("table", ["docs", "edge"])
@pytest.mark.parametrize("block, bucket", [(bpe.BLOCK, bpe.BUCKET), (5000, bpe.BUCKET), (20_000, 3_000)])
def test_ids_match_the_library_and_decode(table, block, bucket, request, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "BUCKET", bucket)
    df = request.getfixturevalue(table)
    encoder = pretokens.rank_encoder()
    want = []
    for r in df.collect():
        ids = encoder.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), struct.pack(f"<{len(ids)}I", *ids), (r.text or "").encode()))
    found = bpe.decode(bpe.encode(df)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found) == sorted(want)


def test_query_digests(spark, sf_dir, doc_rows):
    encoder = pretokens.rank_encoder()
    found = queries.op1_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(doc_rows)
    for r in found:
        ids = encoder.encode_ordinary(doc_rows[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(doc_rows[r.doc_id].text.encode()).hexdigest()


def test_unknown_ids_raise(spark):
    df = spark.createDataFrame([(struct.pack("<I", 60_000),)], "ids binary")
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe.decode(df).collect()


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_packets():
    for n in (0, 1, 70_000):
        x = np.arange(n, dtype=np.uint32) * 7
        assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()
    for words in ([], [""], ["a", "é", "", "日本"]):
        assert bpe.unpack_strings(bpe.pack_strings(words)) == [w.encode() for w in words]


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r.decoded for r in bpe.decode(df).collect()] == [None, b""]


def test_same_ids_as_the_json_vocabulary(doc_rows):
    words = sorted({w for r in list(doc_rows.values()) for w in pretokens.split(r.text)})
    encoder = pretokens.rank_encoder()
    assert list(map(pretokens.word_encoder(), words)) == [encoder.encode_ordinary(w) for w in words]
