import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.llm import multiset_hash, queries


def vec(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in rows.select("i", multiset_hash.vector(F.col("text")).alias("v")).orderBy("i").collect()]


def test_order_does_not_matter_and_multiplicity_does(spark):
    a, b, c, d, e = vec(spark, "x\ny\nz", "z\nx\ny", "x\ny\nz\nz", None, "")
    assert a == b and a != c and d == e
    assert len(a) == multiset_hash.WIDTH


def test_insert_and_delete(spark):
    whole, part, rest = vec(spark, "a\nb\nc\nd", "a\nc", "b\nd")
    row = spark.createDataFrame([(whole, part, rest)], "w array<long>, p array<long>, r array<long>")
    added, taken = row.select(
        multiset_hash.combine(F.col("p"), F.col("r")), multiset_hash.combine(F.col("w"), F.col("r"), delete=True)
    ).first()
    assert added == whole and taken == part


def test_likeness_follows_the_shared_lines(spark):
    lines = [f"line {i}" for i in range(400)]
    texts = ["\n".join(lines[:200]), "\n".join(lines[:150] + lines[200:250]), "\n".join(lines[:100] + lines[200:300]), "\n".join(lines[200:])]
    v = vec(spark, *texts)
    df = spark.createDataFrame([(v[0], x) for x in v], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(multiset_hash.likeness(F.col("a"), F.col("b"))).collect()]
    for x, want in zip(got, [1.0, 0.75, 0.5, 0.0]):
        assert abs(x - want) < 0.25
    assert got[0] == 1.0


def counted(rng, n):
    """The packed counters of n different lines, as whole numbers."""
    lanes = [int(x) for x in rng.binomial(n, 0.5, multiset_hash.LANES)]
    k = multiset_hash.LANES_A_PACK
    return [sum(c << (multiset_hash.LANE_BITS * j) for j, c in enumerate(lanes[i : i + k])) for i in range(0, len(lanes), k)]


@pytest.mark.parametrize("n", [1_000, 3_000_000, 40_000_000])
def test_likeness_outlives_the_counters(spark, n):
    rng = np.random.default_rng(1)
    shared, own, other = (counted(rng, n) for _ in range(3))

    def vector(*parts):
        packs = [sum(p) & multiset_hash.PACK_MASK for p in zip(*parts, strict=True)]
        return [id(parts)] * multiset_hash.STRONG + packs + [n * len(parts)]

    pairs = [(vector(shared, own), vector(shared, other)), (vector(own), vector(other)), (vector(shared, own), vector(shared))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<long>, b array<long>")
    got = [r[0] for r in df.select("i", multiset_hash.likeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").select("x").collect()]
    for x, want in zip(got, [0.5, 0.0, 1 - 1 / 3], strict=True):
        assert abs(x - want) < 0.2


def brute(rows):
    def order(r):
        return (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())

    rows = sorted(rows, key=order, reverse=True)
    out = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, other = r.text or "", after.text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out.append((str(r.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("rows_a_bucket", [1000, 7, 1])
def test_edited_texts_match_brute_force(docs, rows_a_bucket, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BUCKET_ROWS", rows_a_bucket)
    found = multiset_hash.edited_neighbours(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("s")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.s) for r in found) == brute(docs.collect())


@pytest.mark.parametrize("rows_a_bucket", [1000, 3])
def test_edges(edge, empty, rows_a_bucket, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BUCKET_ROWS", rows_a_bucket)
    found = multiset_hash.edited_neighbours(edge).select("doc_id", "n_chars", F.sha2("edited", 256).alias("s")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.s) for r in found) == brute(edge.collect())
    assert multiset_hash.edited_neighbours(empty).count() == 0


def test_query_has_no_python_node(spark, sf_dir):
    df = queries.op4_document_fingerprints(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = df.collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows)
    same = [r for r in rows if r.fingerprint == r.edited_fingerprint]
    assert all(r.near_edited == 1 for r in same)


def brute_vector(text):
    """The vector by plain Python: 64-bit hashes of each line and each seed, summed position by position."""
    import struct

    import xxhash

    m = multiset_hash
    sums = [0] * m.WIDTH
    for line in (text or "").split("\n"):
        first = xxhash.xxh64_intdigest(line.encode(), 42)
        h = [xxhash.xxh64_intdigest(struct.pack("<i", i), first) for i in range(max(m.STRONG, m.HASHES))]
        for i in range(m.STRONG):
            sums[i] = (sums[i] + h[i]) % (1 << 62)
        for i in range(m.PACKS):
            sums[m.STRONG + i] = (sums[m.STRONG + i] + (h[i // m.PACKS_A_HASH] >> (i % m.PACKS_A_HASH) & m.UNITS)) % (1 << 60)
        sums[-1] += 1
    return sums


def brute_likeness(a, b):
    m = multiset_hash

    def lanes(v):
        return [2 * (v[m.STRONG + i] >> m.LANE_BITS * k & (1 << m.LANE_BITS) - 1) - v[-1] for i in range(m.PACKS) for k in range(m.LANES_A_PACK)]

    if a == b:
        return 1.0
    x, y = lanes(a), lanes(b)
    whole = sum(i * i for i in x) + sum(i * i for i in y)
    return min(1.0, max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y)) / whole)) if whole else 0.0


def test_query_matches_brute_force(spark, sf_dir, docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after.text[:half]
        own, changed, other = brute_vector(r.text), brute_vector(edited), brute_vector(after.text)
        got = found[r.doc_id]
        assert got.fingerprint == "".join(f"{x:016x}" for x in own) and got.edited_fingerprint == "".join(f"{x:016x}" for x in changed)
        assert abs(got.near_edited - brute_likeness(own, changed)) < 1e-9 and abs(got.near_next - brute_likeness(own, other)) < 1e-9
