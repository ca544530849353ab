import struct
import zlib

import pytest

from cellspan.llm import packing, pretokens


def ids_of(text):
    return pretokens.json_tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def check(df, found):
    want = []
    for r in df.collect():
        ids = ids_of(r.text)
        for k, (start, length) in enumerate(packing.cut(len(ids))):
            part = ids[start : start + length]
            want.append((str(r.doc_id), k, start, length, zlib.crc32(struct.pack(f"<{length}I", *part))))
        assert packing.cut(len(ids))[-1][0] + packing.cut(len(ids))[-1][1] == len(ids)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    return len(bins), -(-sum(w[3] for w in want) // 1024)


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_pack_is_a_gapless_packing_of_all_pieces(table, request):
    df = request.getfixturevalue(table)
    bins, least = check(df, packing.pack(df).collect())
    assert bins <= 1.03 * least + 1


def test_many_equal_lengths(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a b c', repeat('x ', cast(id % 700 as int))) AS text").repartition(13)
    bins, least = check(df, packing.pack(df).collect())
    assert bins <= least + 2


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_fullest_finds_the_best_sum():
    import itertools
    import random

    random.seed(5)
    for _ in range(200):
        items = [random.randint(1, 30) for _ in range(random.randint(1, 9))]
        counts = [0] * 41
        for x in items:
            counts[x] += 1
        largest = max(items)
        rest = sorted(items)
        rest.remove(largest)
        best = max(sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if sum(c) <= 40 - largest)
        chosen = packing.fullest(counts, largest, 40)
        assert sum(k * n for k, n in chosen.items()) == largest + best
        assert all(n <= counts[k] for k, n in chosen.items())
