"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each bit that is 1 in more than half of the XXH64 hashes (seed 42) of its word
shingles.  Fingerprints link when they differ in ``radius`` bits at most.

Every distinct fingerprint is compared, exactly, with every other that can link with it.  Fingerprints are classed by their
population count and dealt into groups of about ``GROUP`` with neighbouring counts; groups whose counts differ by more than the
radius can't link and never meet.  A pair of groups is one task's work: there both are sorted by the population counts of
their four 16-bit quarters and cut into tiles of ``TILE``; a tile pair whose ranges of these counts are farther apart than
the radius is skipped; the others are compared by numpy's exclusive-or and bit counts.  A task does not emit links but
contracts them at once (union of the linked fingerprints) and emits each linked fingerprint with its local group,
so a group of copies costs as many rows as it has fingerprints, not their square.  :mod:`components` joins the local groups.

Copies at a given share of common shingles need more bits than 64 to be told apart from others: :func:`one_of_each` takes
``PLANES`` fingerprints of different bits of the same shingle hashes.  Two texts link if the first fingerprints differ in
``PLANE_RADIUS`` bits at most, which the tiles find, and all together in ``WITHIN`` of 256, which is looked at for those
pairs only.  A share (Jaccard) of 0.8 of five-word shingles makes 39 of 256 bits differ on average, with a deviation of 6; unrelated texts differ in 128.

Where a ``share`` is asked for, the fingerprints (then of a text's distinct shingles) only search: they link at the wider ``CANDIDATES`` bits, and candidate pairs
are compared again by the shingles themselves, each that nothing else has united yet.  Components of candidates are cut into blocks of about ``BLOCK`` texts: first each block is compared
with itself and with the first block, which unites a large group of copies with three copies of each text; then only pairs that are still apart are compared, block by block, within the local
groups that hold them.  No task holds more than two blocks of texts.  Texts with equal sets of shingles are one node.

The driver sees 65 class sizes and no fingerprint.  Comparisons grow with the square of the number of distinct fingerprints, as
the method does; the shuffle grows with its power 1.5 at most.

Defined results: null text and texts without words have fingerprint 0 and link like any other; null ids take part, and
``component_id`` is the smallest id that isn't null; repeated ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.llm.common import materialise, row_hash, text_or_empty, unused
from cellspan.llm.components import components

RADIUS, WORDS, SEED = 3, 3, 42
GROUP, TILE = 1 << 15, 1 << 10
#: A group isn't made smaller than this for the sake of parallel work.
LEAST_GROUP = 1 << 12
#: Groups beyond which they get larger instead of more, so that the driver's list of pairs stays below about a million.
GROUPS = 2_000
#: For near copies: words of a shingle, fingerprints, and the bits that may differ in the first one and in all.
COPY_WORDS, PLANES, PLANE_RADIUS, WITHIN = 5, 4, 20, 42
#: The share of common shingles of near copies, the bits of all fingerprints that may differ for their shingles to be compared, and texts of a block.
SHARE, CANDIDATES, BLOCK = 0.8, 60, 512
#: Shingles that are hashed in one go, and links of a tile pair that are looked at in one go.
CHUNK, LINKS = 1 << 17, 1 << 16


def fingerprints_of(text: str, words: int = WORDS, planes: int = 1) -> np.ndarray:
    """``planes`` 64-bit SimHashes of the shingles of a whole text, repeats included; the first is of the hashes themselves."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(planes, np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    n, ones = max(1, len(parts) - words + 1), np.zeros((planes, 64), np.int64)
    for start in range(0, n, CHUNK):
        take = min(CHUNK, n - start)
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED, take)), np.uint64, take) if n <= CHUNK else _some(shingles, take)
        _count_ones(ones, h)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def _count_ones(ones: np.ndarray, h: np.ndarray) -> None:
    """Add to each row of ``ones`` how many of the hashes have each bit."""
    for k in range(len(ones)):
        if k:  # other bits of the same hash: a mixing step that is one to one
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        ones[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints_of_set(h: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """``planes`` 64-bit SimHashes of distinct shingle hashes."""
    ones = np.zeros((planes, 64), np.int64)
    for start in range(0, len(h), CHUNK):
        _count_ones(ones, h[start : start + CHUNK])
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<u8").ravel()


def shingles_of(text: str, words: int = COPY_WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of the shingles of a text, ascending."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(parts) - words + 1))


def fingerprint(text: str, words: int = WORDS) -> int:
    return int(fingerprints_of(text, words)[0])


def _some(shingles, take: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(take)), np.uint64, take)


def fingerprint_column(words: int = WORDS):
    """Function of a text column: the fingerprint as a long with the same bits."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or "", words) for t in texts], np.uint64).view(np.int64), pa.int64())

    return fingerprints


def planes_column(words: int = COPY_WORDS, planes: int = PLANES):
    """Function of a text column: ``struct<fingerprint, more>``, the first fingerprint and the bytes of the others."""

    @F.arrow_udf("fingerprint long, more binary")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = [fingerprints_of(t.as_py() or "", words, planes) for t in texts]
        first = pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64), pa.int64())
        return pa.StructArray.from_arrays([first, pa.array([f[1:].tobytes() for f in found], pa.binary())], names=["fingerprint", "more"])

    return fingerprints


def set_column(words: int = COPY_WORDS, planes: int = PLANES):
    """Function of a text column: ``struct<fingerprint, more, node>`` of its distinct shingles; the node is a hash of all of them."""

    @F.arrow_udf("fingerprint long, more binary, node long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        first, more, nodes = [], [], []
        for t in texts:
            h = shingles_of(t.as_py() or "", words)
            f = fingerprints_of_set(h, planes)
            first.append(f[0]), more.append(f[1:].tobytes()), nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (first, nodes)]
        return pa.StructArray.from_arrays([longs[0], pa.array(more, pa.binary()), longs[1]], names=["fingerprint", "more", "node"])

    return fingerprints


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Unions:
    """Union of positions, with numpy: ``link`` takes arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, at: np.ndarray) -> np.ndarray:
        up = self.root[at]
        while True:
            further = self.root[up]
            if (further == up).all():
                return up
            up = further

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._find(a), self._find(b)
            apart = a != b
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.root, high, low)
            a, b = low, high

    def roots(self) -> np.ndarray:
        return self._find(np.arange(len(self.root)))


class Side:
    """One group of fingerprints: the first ones, their nodes' names, and the others (or none), row by row."""

    def __init__(self, prints: np.ndarray, nodes: np.ndarray | None = None, more: np.ndarray | None = None):
        order = np.lexsort(_quarters(prints).T)
        self.prints = prints[order]
        self.nodes = self.prints.view(np.int64) if nodes is None else nodes[order]
        self.more = np.zeros((len(prints), 0), np.uint64) if more is None else more[order]


def local_groups(left: Side, right: Side | None, radius: int = RADIUS, within: int | None = None, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes of two groups (or within one) and, for each, the smallest node of its local group."""
    sides = [left] if right is None else [left, right]
    prints, nodes, more = (np.concatenate([getattr(s, k) for s in sides]) for k in ("prints", "nodes", "more"))
    first = 0 if right is None else len(left.prints)
    unions, linked = Unions(len(prints)), np.zeros(len(prints), bool)
    counts = _quarters(prints)
    rows = [(i, min(i + tile, len(left.prints))) for i in range(0, len(left.prints), tile)]
    columns = rows if right is None else [(i, min(i + tile, len(prints))) for i in range(first, len(prints), tile)]
    low = np.array([counts[a:b].min(axis=0) for a, b in columns]).reshape(-1, 4)
    high = np.array([counts[a:b].max(axis=0) for a, b in columns]).reshape(-1, 4)
    for k, (a, b) in enumerate(rows):
        mine = counts[a:b]
        gap = np.maximum(0, np.maximum(low - mine.max(axis=0), mine.min(axis=0) - high)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        for j in near[near >= k] if right is None else near:
            c, d = columns[j]
            found = np.flatnonzero(np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= radius)
            # A tile pair of near copies links as a whole, so its links are taken in parts.
            for start in range(0, len(found), LINKS):
                x, y = np.divmod(found[start : start + LINKS], d - c)
                x, y = x + a, y + c
                if right is None:
                    x, y = x[x < y], y[x < y]
                if within is not None and len(x):
                    apart = np.bitwise_count(prints[x] ^ prints[y]) + np.bitwise_count(more[x] ^ more[y]).sum(axis=1, dtype=np.int64)
                    x, y = x[apart <= within], y[apart <= within]
                if len(x):
                    linked[x] = linked[y] = True
                    unions.link(x, y)
    at = np.flatnonzero(linked)
    roots = unions.roots()[at]
    least = np.full(len(prints), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, roots, nodes[at])
    return nodes[at], least[roots]


def group_classes(sizes: dict[int, int], group: int) -> tuple[list[tuple[int, int]], dict[int, int], dict[int, int]]:
    """Groups of about ``group`` rows from class sizes: neighbouring small classes together, a large class split.

    Returns each group's lowest and highest class, and for each class its first group and how many it is split into.
    """
    ranges: list[tuple[int, int]] = []
    first_of, parts_of = {}, {}
    held = 0
    for k in sorted(sizes):
        if sizes[k] >= group:
            parts_of[k], first_of[k], held = -(-sizes[k] // group), len(ranges), 0
            ranges += [(k, k)] * parts_of[k]
            continue
        if not held or held + sizes[k] > group:
            ranges.append((k, k))
            held = 0
        ranges[-1] = (ranges[-1][0], k)
        first_of[k], parts_of[k] = len(ranges) - 1, 1
        held += sizes[k]
    return ranges, first_of, parts_of


def link_components(
    prints: DataFrame, radius: int = RADIUS, within: int | None = None, group: int = GROUP, texts: DataFrame | None = None, words: int = COPY_WORDS, share: float = SHARE
) -> DataFrame:
    """``(node, component)`` of the rows of ``prints(fingerprint, node, more)`` that link with any other; nodes are unique longs.

    Given ``texts(key, text)``, and a ``key`` in ``prints``, only pairs that have ``share`` of their shingles in common link.
    """
    spark = prints.sparkSession
    classed = prints.select("fingerprint", "node", "more", F.bit_count("fingerprint").alias("ones"))
    sizes = {r.ones: r["count"] for r in classed.groupBy("ones").count().collect()}  # 65 rows at most
    # At least a dozen groups, for parallel work on small data too.
    total = sum(sizes.values())
    group = max(min(group, max(LEAST_GROUP, total // 12)), total // GROUPS)
    ranges, first_of, parts_of = group_classes(sizes, group)
    pairs = [(i, j) for i, (_, high) in enumerate(ranges) for j in range(i, len(ranges)) if ranges[j][0] - high <= radius]
    start_of, per_class = (F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, of[k])]) if sizes else F.create_map(F.lit(0), F.lit(1)) for of in (first_of, parts_of))
    spread = F.pmod(F.xxhash64("node"), F.element_at(per_class, F.col("ones")))
    grouped = classed.select("fingerprint", "node", "more", (F.element_at(start_of, F.col("ones")) + spread).cast("int").alias("grp"))
    meets: dict[int, list[int]] = {}
    for p, (a, b) in enumerate(pairs):
        meets.setdefault(a, []).append(2 * p)
        if a != b:
            meets.setdefault(b, []).append(2 * p + 1)
    met = _compared(grouped, spark.sparkContext.broadcast((pairs, meets)), len(pairs), radius, within)
    if texts is not None:
        return _verified(prints, materialise(met, "candidates"), texts, words, radius, within, share)
    return components(met.select("node", F.struct("pair", "least").alias("local"), "least"))


def _verified(prints: DataFrame, met: DataFrame, texts: DataFrame, words: int, radius: int, within: int, share: float) -> DataFrame:
    """``(node, component)`` of the candidates in ``met(node, least, pair)``, as the shingles of their texts link them."""
    of = components(met.select("node", F.struct("pair", "least").alias("local"), "least"))
    wanted = prints.join(of, "node").select("node", "fingerprint", "more", "key").join(texts, "key")
    found = materialise(wanted.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fingerprint", "more", "text")]), "candidate-texts")

    def verified(dealt: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """Links of ``dealt(node, label, block, other, a, b)``: a unit is a block, or a block and another."""
        unit = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        # Where two blocks meet, pairs within either are left to the unit of that block alone.
        dealt = dealt.select("node", "label", unit.alias("local"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
        held = dealt.join(found, "node").select("local", "side", "label", "fingerprint", "more", "text", F.xxhash64("local").alias("name"))
        made = held.repartition("local").sortWithinPartitions("local").mapInArrow(_verify_units(words, radius, within, share), "node long, least long, name long")
        return materialise(made.select("node", F.struct("name", "least").alias("local"), "least"), name)

    # Round one: each block by itself and with the first block of its component; three copies of a text, whatever the size.
    sizes = materialise(of.groupBy("component").agg(F.count("*").alias("size")), "candidate-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = of.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    dealt = dealt.select("node", F.col("node").alias("label"), "block", F.explode(others).alias("other"), "component", F.lit(-1).cast("long").alias("none"))
    links = verified(dealt, "component", "none", "links")
    # With one or two blocks that was every pair.
    large = of.join(sizes.where(F.col("size") > 2 * BLOCK), "component", "left_semi").select("node")
    if large.isEmpty():
        return components(links)
    # Round two: of each local group the pairs with different labels, which takes what isn't in the group's commonest label, against all of it.
    labels = components(links).select("node", F.col("component").alias("label"))
    labelled = materialise(met.join(large, "node", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-candidates")
    commonest = labelled.groupBy("pair", "least", "label").agg(F.count("*").alias("n")).groupBy("pair", "least")
    undone = commonest.agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size")).where("most.n < size")
    # A local group has the fingerprints of two groups at most, so the window is bounded.
    place = F.row_number().over(Window.partitionBy("pair", "least").orderBy(F.col("label") == F.col("most.label"), "node")) - 1
    dealt = labelled.join(undone, ["pair", "least"]).withColumn("block", F.floor(place / BLOCK).cast("int"))
    rest, last = (F.floor((n - 1) / BLOCK).cast("int") for n in (F.col("size") - F.col("most.n"), F.col("size")))
    others = F.sequence(F.lit(0), F.when(F.col("block") <= rest, last).otherwise(rest))
    more = verified(dealt.select("node", "label", "block", F.explode(others).alias("other"), "pair", "least"), "pair", "least", "further-links")
    return components(links.unionByName(more))


def _verify_units(words: int, radius: int, within: int, share: float):
    """Compare the texts of each unit (sorted by unit) and give the labels that links unite, with the smallest of them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for local, side, label, fingerprint, more, text, name in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if local != now:
                    yield from finished(rows)
                    now, rows = local, []
                rows.append((name, local["low"] == local["high"], side, label, fingerprint, more, shingles_of(text, words)))
        yield from finished(rows)

    def finished(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        prints = np.array([np.frombuffer(np.int64(r[4]).tobytes() + r[5], np.uint64) for r in rows])
        side = None if rows[0][1] else np.array([r[2] for r in rows])
        labels, at = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
        group = shared_shingles(prints, [r[6] for r in rows], side, radius, within, share, at)
        of_label = np.zeros(len(labels), np.int64)
        of_label[at] = group
        united = np.flatnonzero(np.bincount(of_label, minlength=len(labels))[of_label] > 1)
        least = np.full(len(labels), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, of_label, labels)
        if len(united):
            yield pa.RecordBatch.from_arrays([pa.array(labels[united]), pa.array(least[of_label][united]), pa.array(np.full(len(united), rows[0][0], np.int64))], names=["node", "least", "name"])

    return verify


def shared_shingles(
    prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, radius: int, within: int, share: float, group: np.ndarray | None = None
) -> np.ndarray:
    """A group number for each text: united are those that a chain of candidate pairs with ``share`` of common shingles joins.

    ``prints`` are rows of fingerprints; with ``side`` only pairs of different sides are looked at; texts of one number in ``group`` are united from the start.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    group = np.arange(n) if group is None else group.copy()
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        apart = np.bitwise_count(prints[i + 1 :] ^ prints[i])
        near = (apart[:, 0] <= radius) & (apart.sum(axis=1, dtype=np.int64) <= within)
        near &= (group[later] != group[i]) & (np.minimum(sizes[later], sizes[i]) >= share * np.maximum(sizes[later], sizes[i]) - 1e-9)
        if side is not None:
            near &= side[later] != side[i]
        for j in later[near]:
            if group[j] == group[i]:  # by one of those before
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= share * (sizes[i] + sizes[j] - common) - 1e-9:
                group[group == group[j]] = group[i]
    return group


def _compared(grouped: DataFrame, shared, n_pairs: int, radius: int, within: int | None) -> DataFrame:
    """``(node, least, pair)``: groups meet by pair, and each pair of groups is compared in one task."""
    kinds = [("pair", pa.int64()), ("side", pa.int64()), ("prints", pa.binary()), ("nodes", pa.binary()), ("more", pa.binary())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, groups = (batch.column(i).to_numpy() for i in (0, 1, 3))
            more = np.array(batch.column(2).to_pylist(), object)
            for g in np.unique(groups):
                mine = groups == g
                data = [prints[mine].tobytes(), nodes[mine].tobytes(), b"".join(x or b"" for x in more[mine])]
                at = np.array(shared.value[1][int(g)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // 2), pa.array(at % 2), *[pa.array([d] * len(at), pa.binary()) for d in data]], schema=pa.schema(kinds))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            for pair, side, *data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if pair != now:
                    yield from finished(now, sides)
                    now, sides = pair, ([], [])
                sides[side].append(data)
        yield from finished(now, sides)

    def side_of(parts: list) -> Side:
        prints, nodes, more = (b"".join(p[i] for p in parts) for i in range(3))
        n = len(prints) // 8
        return Side(np.frombuffer(prints, np.uint64), np.frombuffer(nodes, np.int64), np.frombuffer(more, np.uint64).reshape(n, -1))

    def finished(pair, sides) -> Iterator[pa.RecordBatch]:
        if pair is None:
            return
        same = shared.value[0][pair][0] == shared.value[0][pair][1]
        if not sides[0] or not same and not sides[1]:
            return
        nodes, least = local_groups(side_of(sides[0]), None if same else side_of(sides[1]), radius, within)
        for i in range(0, len(nodes), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(least[part]), pa.array(np.full(len(nodes[part]), pair, np.int64))], names=["node", "least", "pair"])

    wide = "pair long, side long, prints binary, nodes binary, more binary"
    tasks = max(1, min(n_pairs, 100_000))
    dealt = grouped.mapInArrow(deal, wide).repartition(tasks, "pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(compare, "node long, least long, pair long")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _component_of_node(table: DataFrame, radius: int, within: int | None = None, **verified) -> DataFrame:
    """``(node, component)`` of each distinct node of ``table(node, fingerprint, more)`` (and ``key``, to verify links); written, so that joins with it are dealt afresh."""
    # One row for each distinct node; copies meet it only by partial aggregates.
    firsts = [F.first(c).alias(c) for c in ("fingerprint", "more", *(["key"] if verified else []))]
    distinct = materialise(table.groupBy("node").agg(*firsts), "distinct-fingerprints")
    linked = link_components(distinct, radius, within, **verified).withColumnRenamed("node", "of")
    found = distinct.join(linked, distinct.node == linked.of, "left")
    return materialise(found.select("node", F.coalesce("component", "node").alias("component")), "fingerprint-components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row."""
    made = df.select(F.col(id_col).alias("id"), fingerprint_column(words)(text_or_empty(text_col)).alias("fingerprint"))
    table = materialise(made, "fingerprints")
    of_print = _component_of_node(table.select("fingerprint", F.col("fingerprint").alias("node"), F.lit(None).cast("binary").alias("more")), radius)
    of_print = of_print.withColumnRenamed("node", "fingerprint")
    least_of_print = materialise(table.groupBy("fingerprint").agg(F.min("id").alias("least")), "print-ids")
    met = materialise(of_print.join(least_of_print, "fingerprint"), "print-components")
    least = materialise(met.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = materialise(met.join(least, "component").select("fingerprint", "component_id"), "fingerprint-names")
    return table.join(named, "fingerprint").select(F.col("id").alias(id_col), hex_digits("fingerprint").alias("fingerprint"), "component_id")


def one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = COPY_WORDS,
    planes: int = PLANES,
    radius: int = PLANE_RADIUS,
    within: int | None = None,
    share: float | None = None,
) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with all its columns; all rows without near copies stay.

    Near copies have ``share`` of their distinct shingles in common; without a share, fingerprints that differ in ``within`` bits at most.
    """
    own, of_id, of_key = unused(df, "cellspan_key", "cellspan_id", "cellspan_same")
    keyed = df.withColumn(own, row_hash(df))
    prints = set_column if share else planes_column
    table = materialise(
        keyed.select(F.col(id_col).alias("id"), F.col(own).alias("key"), prints(words, planes)(text_or_empty(text_col)).alias("f")).select("id", "key", "f.*"), "fingerprints"
    )
    if share:
        texts = keyed.select(F.col(own).alias("key"), text_or_empty(text_col).alias("text"))
        of_node = _component_of_node(table, radius, CANDIDATES if within is None else within, texts=texts, words=words, share=share)
    else:
        table = table.withColumn("node", F.xxhash64("fingerprint", "more"))
        of_node = _component_of_node(table, radius, WITHIN if within is None else within)
    # The best row of each node first, then that of each component: only one row a node is shuffled.
    best = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "key")).alias("best")
    of_each = materialise(table.groupBy("node").agg(best), "best-of-node").join(of_node, "node")
    chosen = of_each.groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.key")
    # Rows that are equal in every column have one key; how many there are says whether one has to be picked.
    same = table.groupBy("id", "key").agg(F.count("*").alias("n"))
    chosen = materialise(chosen.join(same, chosen.id.eqNullSafe(same.id) & (chosen.key == same.key)).select(chosen.id.alias(of_id), chosen.key.alias(of_key), "n"), "chosen")

    def rows(which: DataFrame) -> DataFrame:
        return keyed.join(which, (F.col(own) == F.col(of_key)) & F.col(id_col).eqNullSafe(F.col(of_id)), "left_semi")

    alone = rows(chosen.where("n = 1")).drop(own)
    several = chosen.where("n > 1")
    if several.isEmpty():
        return alone
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return alone.unionByName(rows(several).groupBy(own, F.col(id_col).alias(of_id)).agg(F.first(whole).alias(of_key)).select(f"{of_key}.*"))
