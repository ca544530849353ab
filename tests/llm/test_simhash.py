import re

import numpy as np
import pytest
import xxhash

from cellspan.llm import simhash
from cellspan.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_planes(text):
    """The four fingerprints of five-word shingles, by plain Python."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return (0, 0, 0, 0)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))]
    out, full = [], (1 << 64) - 1
    for k in range(4):
        if k:
            for i, x in enumerate(h):
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
                x = (x ^ x >> 27) * 0x94D049BB133111EB & full
                h[i] = x ^ x >> 31
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return tuple(out)


def near_copies(a, b):
    return (a[0] ^ b[0]).bit_count() <= 20 and sum((x ^ y).bit_count() for x, y in zip(a, b)) <= 42


def brute(prints, ids, near=lambda a, b: (a ^ b).bit_count() <= 3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_near_duplicates_match_brute_force(table, request):
    df = request.getfixturevalue(table)
    rows = df.collect()
    prints = [brute_print(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], [f"{p:016x}" for p in prints], map(str, brute(prints, [r.doc_id for r in rows]))))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_linked_fingerprints_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_GROUP", 60)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 400, dtype=np.uint64)}
    for s in seeds:  # chains of steps of up to three bits
        for _ in range(15):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                s ^= np.uint64(1) << np.uint64(b)
            prints.add(int(s))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p, p, None) for p in signed], "fingerprint long, node long, more binary").repartition(5)
    found = {r.node: r.component for r in simhash.link_components(df, 3, group=60).collect()}
    want = brute(prints, signed)
    assert [found.get(p, p) for p in signed] == want


def test_tiles_find_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    nodes, local = simhash.local_groups(simhash.Side(prints), None, 3, tile=32)
    close = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    assert set(nodes.view(np.uint64).tolist()) == set(prints[close.sum(axis=1) > 1].tolist())
    a, b = prints[::2].copy(), prints[1::2].copy()
    nodes, _ = simhash.local_groups(simhash.Side(a), simhash.Side(b), 3, tile=32)
    close = np.bitwise_count(a[:, None] ^ b[None]) <= 3
    assert set(nodes.view(np.uint64).tolist()) == set(a[close.any(axis=1)].tolist()) | set(b[close.any(axis=0)].tolist())


def test_components_of_a_long_chain(spark):
    rows = [(k, i, i) for i in range(60) for k in (i, i + 1)]
    found = components(spark.createDataFrame(rows, "node long, local long, least long")).collect()
    assert {r.component for r in found} == {0} and len(found) == 61


def test_long_text_in_parts(monkeypatch):
    text = "some words to hash " * 50 + "end"
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == want == brute_print(text)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def edited(text, share, rng):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"new{rng.integers(0, 10**9)}"
    return " ".join(words)


def test_one_of_each_catches_near_copies_and_leaves_others(spark, docs):
    rng = np.random.default_rng(8)
    base = [r for r in docs.collect() if len(r.text.split()) > 100][:60]
    rows = [(r.doc_id, r.text) for r in base] + [(10_000 + i, edited(r.text, 0.012, rng)) for i, r in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    planes = [brute_planes(t) for _, t in rows]
    assert got == set(brute(planes, [i for i, _ in rows], near_copies))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    alike = [(i, len(a & b) / len(a | b)) for i, (a, b) in enumerate((shingles(rows[i][1]), shingles(rows[60 + i][1])) for i in range(60))]
    close = [i for i, j in alike if j >= 0.85]
    assert len(close) > 30 and sum(10_000 + i not in got for i in close) >= 0.95 * len(close)
    assert sum(r.doc_id in got for r in base) >= len({r.text for r in base}) - 3


def test_groups_hold_neighbouring_classes():
    ranges, first, parts = simhash.group_classes({1: 5, 2: 3, 5: 30, 6: 4, 9: 4}, 10)
    assert ranges == [(1, 2), (5, 5), (5, 5), (5, 5), (6, 9)]
    assert first == {1: 0, 2: 0, 5: 1, 6: 4, 9: 4} and parts == {1: 1, 2: 1, 5: 3, 6: 1, 9: 1}
    assert simhash.group_classes({}, 10) == ([], {}, {})


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("block", [512, 3])
def test_share_of_shingles_decides(spark, docs, edge, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = [r for r in docs.collect() if len(r.text.split()) > 100][:60]
    rows = [(r.doc_id, r.text) for r in base] + [(10_000 + i, edited(r.text, (0.012, 0.02)[i % 2], rng)) for i, r in enumerate(base)]
    rows += [(20_000 + i, edited(base[0].text, 0.012, rng)) for i in range(12)]  # a group of several blocks
    # A repeated line fills both sketches but is few distinct shingles.
    rows += [(30_000 + i, "one and the same line again " * 300 + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(2)]
    sets = [shingle_set(t) for _, t in rows]
    want = set(brute(sets, [i for i, _ in rows], alike))
    assert want != set(brute([brute_planes(t) for _, t in rows], [i for i, _ in rows], near_copies))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.one_of_each(df, share=0.8).collect()}
    assert {30_000, 30_001} <= got and got == want
    assert simhash.one_of_each(edge, share=0.8).count() == len(set(brute([shingle_set(r.text) for r in edge.collect()], list(range(edge.count())), alike)))


@pytest.mark.parametrize("block", [512, 2])
def test_chains_are_followed_over_blocks(spark, monkeypatch, block):
    """Only texts that are close in the chain link, so the first block alone doesn't unite it."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = []
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(300)]
        for k in range(18):
            rows.append((100 * c + k, " ".join(words)))
            words[15 * k : 15 * (k + 1)] = [f"c{c}k{k}i{i}" for i in range(15)]
        if c == 2:
            del rows[-10]  # a gap: two chains
    sets = [shingle_set(t) for _, t in rows]
    want = set(brute(sets, [i for i, _ in rows], alike))
    assert len(want) == 4 and not alike(sets[0], sets[3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.one_of_each(df, share=0.8).collect()} == want
