import hashlib
import re

import numpy as np
import pytest

from cellspan.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    return groups


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_groups_match_brute_force(table, request):
    df = request.getfixturevalue(table)
    rows, found = df.collect(), exact_dedup.groups(df).collect()
    groups = brute(rows)
    sha = {hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(): ids for t, ids in groups.items()}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    for r in found:
        ids = sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    for digest in sha:
        assert sum(r.kept for r in found if r.text_sha256 == digest) == 1


def test_deduplicate_keeps_whole_rows(edge):
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    groups = brute(edge.collect())
    assert kept.count() == len(groups)
    assert {norm(r.text) for r in kept.collect()} == set(groups)


def test_empty(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def test_filter_has_no_false_negatives(spark):
    df = spark.range(0, 5000).selectExpr("xxhash64(id % 4000) AS h")
    plane = exact_dedup.repeated_filter(df.repartition(7), "h", exact_dedup.filter_size(5000))
    values = np.array([r.h for r in df.distinct().collect()])
    again = np.array([r.h for r in df.groupBy("h").count().where("count > 1").collect()])

    def test(h):
        at = exact_dedup.cells_of(h, exact_dedup.filter_size(5000))
        return (plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)

    assert test(again).all()
    assert test(values).sum() < len(again) + 200


def test_many_ranges_give_the_same_and_only_possibly_repeated_rows_shuffle(spark, monkeypatch):
    from cellspan.llm import exact_dedup

    rows = [(i, f"text {i if i % 10 else i % 100}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    least, size = {}, {}
    for i, t in rows:
        least[t], size[t] = min(least.get(t, i), i), size.get(t, 0) + 1
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 16)
    assert exact_dedup.ranges_of(20_000) > 4
    written = {}
    plain = exact_dedup.materialise

    def counted(table, name, by=None):
        made = plain(table, name, by)
        written[name] = written.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(exact_dedup, "materialise", counted)
    for r in exact_dedup.groups(df).collect():
        t = rows[r.doc_id][1]
        assert (r.keep_id, r.group_size, r.kept) == (least[t], size[t], least[t] == r.doc_id)
    repeated = sum(n for n in size.values() if n > 1)
    assert repeated <= written["maybe-repeated"] <= repeated + 0.05 * len(rows)
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect()) == sorted(least.values())


def test_map_columns_and_names_that_clash(spark):
    from cellspan.llm import exact_dedup, simhash

    rows = [(1, "a b c d e f", {"x": 1}, "k1", b"h", 1.0), (2, "a b  c d e f", {"y": 2}, "k2", b"h", 2.0), (3, "other words are in this text", {}, None, None, None), (3, "other words are in this text", {}, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, cellspan_key string, CELLSPAN_HASH binary, __cellspan_key double")
    for keep in (exact_dedup.deduplicate, simhash.one_of_each, lambda d: simhash.one_of_each(d, share=0.8)):
        found = sorted(keep(df).collect())
        assert found == sorted(df.where("doc_id <> 2").collect())[:2] and keep(df).columns == df.columns
