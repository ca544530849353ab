"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Texts are equal when they are identical after each run of white space ``[\\x20\\x09-\\x0D]`` has become one space.

Pass 1 marks, for each text, four cells of a filter that has two bits a cell: seen, and seen again.  Tasks mark
their own rows, hand over the marked cells in compressed segments, and segments are merged where they meet (a cell
that two tasks have seen was seen again).  Pass 2 tests each row: if one of its cells was not seen again, its
text is unique for certain and the row passes straight through.  Only the rest shuffles, by text hash, with partial
aggregation before; so false positives cost some shuffling and never a wrong result.

The filter has 16 cells a row.  Where that is more than ``MAX_CELLS`` (a broadcast of 32 MB), rows are put into folders by ranges of another hash, without a shuffle, and
each range has a filter of its own, one range after the other; so at any size a task holds one bounded filter, and the same share of unique rows passes straight through.

Defined results: null text equals the empty one; the row with the smallest id stays, null ids come last; of rows with
equal id and text exactly one stays; an empty table gives an empty result; :func:`deduplicate` returns the rows with all
their columns whatever they are called, :func:`groups` ignores other columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import materialise, row_hash, shuffle_partitions, text_or_empty, unused

#: Cells a row, cells of a filter at most, marks a row, cells a segment.
CELLS_A_ROW, MAX_CELLS, MARKS, SEGMENT = 16, 1 << 28, 4, 1 << 16


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text_col), 256)


def _hash(key: str) -> Column:
    return F.xxhash64(key)


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cells (rows x MARKS) of 64-bit hashes, by double hashing; ``cells`` is a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(MARKS, dtype=np.uint64)) & np.uint64(cells - 1)).astype(np.int64)


_PLANES = pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("again", pa.binary())])


def _bits(at: np.ndarray) -> bytes:
    plane = np.zeros(SEGMENT, bool)
    plane[at] = True
    return zlib.compress(np.packbits(plane).tobytes(), 1)


def _plane(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def repeated_filter(hashes: DataFrame, column: str, cells: int) -> np.ndarray:
    """The ``again`` plane (bits) of all 64-bit hashes in ``column``; ``cells / 8`` bytes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = cells_of(batch.column(0).to_numpy(), cells)
            at.sort(axis=1)
            flat = at.ravel()[np.concatenate([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]], axis=1).ravel()]
            found, n = np.unique(flat, return_counts=True)
            edges = np.flatnonzero(np.diff(found // SEGMENT)) + 1
            for some, many in zip(np.split(found, edges), np.split(n, edges), strict=True):
                k = int(some[0]) // SEGMENT
                a, b = once.get(k), again.get(k)
                if a is None:
                    a, b = once[k], again[k] = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                some = some % SEGMENT
                b[some] |= a[some] | (many > 1)
                a[some] = True
            if len(once) > 512:  # 64 MB
                yield from _handed(once, again)
                once, again = {}, {}
        yield from _handed(once, again)

    def _handed(once, again):
        for k in once:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), pa.array([_bits(once[k])], pa.binary()), pa.array([_bits(again[k])], pa.binary())], schema=_PLANES
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = _plane(a), _plane(b)
                if k in planes:
                    once, again = planes[k]
                    again |= b | once & a
                    once |= a
                else:
                    planes[k] = [a.copy(), b.copy()]
        for k, (once, again) in planes.items():
            if again.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([b""], pa.binary()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], schema=_PLANES
                )

    schema = "segment long, once binary, again binary"
    tasks = shuffle_partitions(hashes.sparkSession)
    merged = hashes.select(column).mapInArrow(mark, schema).repartition(tasks, "segment").mapInArrow(merge, schema)
    plane = np.zeros(cells // 8, np.uint8)
    for row in merged.select("segment", "again").collect():  # compressed; less than the plane
        plane[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = _plane(bytes(row.again))
    return plane


def filter_size(rows: int) -> int:
    """Cells of a filter for so many rows: a power of two."""
    cells = SEGMENT
    while cells < CELLS_A_ROW * rows:
        cells *= 2
    return cells


def ranges_of(rows: int) -> int:
    """How many ranges of hashes it takes that the filter of each has ``MAX_CELLS`` at most, with some room for uneven ranges."""
    return 1 if filter_size(rows) <= MAX_CELLS else -(-rows * CELLS_A_ROW * 5 // (MAX_CELLS * 4))


def _range(hash_col: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(hash_col, F.lit(1)), F.lit(ranges)).cast("int")


def possibly_repeated(df: DataFrame, key: str):
    """Function of a 64-bit hash column: may a row with this hash have an equal one?  ``key`` holds the hashes of ``df``."""
    cells = filter_size(df.count())
    plane = df.sparkSession.sparkContext.broadcast(repeated_filter(df, key, cells))

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        at = cells_of(hashes.to_numpy(zero_copy_only=False), cells)
        bits = plane.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return pa.array(bits.all(axis=1))

    return test


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row, dropped ones too."""
    ranges = ranges_of(df.count())
    hashed = df.select(F.col(id_col).alias("id"), F.unhex(digest(text_col)).alias("key"))
    hashed = hashed.select("id", "key", F.monotonically_increasing_id().alias("row"))
    if ranges > 1:
        hashed = hashed.withColumn("range", _range("key", ranges))
    table = materialise(hashed, "text-hashes", "range" if ranges > 1 else None).withColumn("hash", _hash("key"))
    alone = maybe = None
    for k in range(ranges):
        part = table.where(F.col("range") == k) if ranges > 1 else table
        tested = part.select("id", "key", "row", possibly_repeated(part.select("hash"), "hash")("hash").alias("maybe"))
        if ranges > 1:  # so that the filter of one range at a time is held
            tested = materialise(tested, "tested-hashes")
        mine = tested.where(~F.col("maybe"))
        alone = mine if alone is None else alone.unionByName(mine)
        mine = materialise(tested.where("maybe").select("id", "key", "row"), "maybe-repeated")
        maybe = mine if maybe is None else maybe.unionByName(mine)
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "key")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    # Written and read again, so that both sides of the join are dealt afresh and a hot group can be split.
    of_key = materialise(maybe.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "text-groups")
    met = maybe.join(of_key, "key").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "key"
    )
    return alone.unionByName(met).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256")
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; unique rows pass straight through."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    key, hash_, maybe, range_ = unused(df, "cellspan_key", "cellspan_hash", "cellspan_maybe", "cellspan_range")
    ranges = ranges_of(df.count())
    keyed = df.withColumn(key, F.unhex(digest(text_col))).withColumn(hash_, _hash(key))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), row_hash(df))
    if ranges > 1:
        keyed = materialise(keyed.withColumn(range_, _range(hash_, ranges)), "texts-by-range", range_)
        hashes = keyed.select(hash_, range_)
    else:
        hashes = materialise(keyed.select(hash_), "text-hashes")
    found = None
    for k in range(ranges):
        part, of_part = (keyed.where(F.col(range_) == k), hashes.where(F.col(range_) == k).select(hash_)) if ranges > 1 else (keyed, hashes)
        tested = part.withColumn(maybe, possibly_repeated(of_part, hash_)(hash_))
        first = tested.where(maybe).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias(maybe))
        kept = tested.where(~F.col(maybe)).select(*columns).unionByName(first.select(f"{maybe}.*"))
        if ranges > 1:
            kept = materialise(kept, "texts-that-stay")
        found = kept if found is None else found.unionByName(kept)
    return found
