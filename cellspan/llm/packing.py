"""Best-fit packing of token sequences by minimum bin slack.

A document's ids are cut, if longer than a sequence, into full pieces with the remainder in front; a full piece fills a
sequence alone.  What is left are lengths below the capacity, so the whole packing problem is a histogram of at most
``capacity`` numbers.  On it the driver runs minimum bin slack: a bitset subset-sum program over the available lengths
(a Python integer whose bit ``s`` says that sum ``s`` can be reached) finds the fullest feasible combination that
holds the largest remaining length; the combination is taken out as often as the histogram has it, and so on until
nothing is left.  The plan that results is a few rows for each length (runs of ranks), bounded by the capacity, not by the data.

Pieces find their place by their rank among the pieces of the same length.  Ranks are spread: pieces are dealt into
buckets by a hash, counted for each bucket and length, and a bucket's ranks start where the buckets before it end; so a
length that a third of all pieces have is split over all buckets.

Defined results: null text is an empty document (its closing id alone); null and repeated ids are packed as they are, one
row each; equal ids are told apart by a hidden row number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.llm import pretokens
from cellspan.llm.common import materialise, shuffle_partitions, text_or_empty

CAPACITY, END_ID = 1024, 2

_cache: dict = {}
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("checksums are of little-endian 32-bit ids")


def _word_bytes(path: str | None):
    encode = pretokens.word_encoder(path)
    return lambda word: array("I", encode(word)).tobytes()


def encode_text(text: str, path: str | None = None) -> bytes:
    """A text's ids as little-endian unsigned 32-bit integers."""
    if path not in _cache:
        _cache[path] = pretokens.WordCache(_word_bytes(path))
    get = _cache[path].__getitem__
    return b"".join(
        array("I", [pretokens.special_pattern(path)[1][part]]).tobytes() if special else b"".join(map(get, pretokens.split(part)))
        for special, part in pretokens.segments(text, path)
    )


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first can be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of all documents, cut."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encode_text(text.as_py(), path) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(row)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(each, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], largest: int, capacity: int) -> dict[int, int]:
    """Lengths, with how many of each, that fill a bin of ``capacity`` best besides one of ``largest``.

    ``reach[i]`` is the bitset of the sums that the lengths tried so far give; walking back over it finds the parts.
    Larger lengths are tried first, and the search ends as soon as the bin can be full.
    """
    room = capacity - largest
    mask, full = (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []  # length, how many at once, sums before
    sums = 1
    for length in range(min(largest, room), 0, -1):
        left = min(counts[length] - (length == largest), room // length)
        share = 1
        while left > 0 and not sums & full:
            now = min(share, left)
            grown = (sums | sums << now * length) & mask
            if grown != sums:
                steps.append((length, now, sums))
                sums = grown
            left -= now
            share *= 2
        if sums & full:
            break
    target = sums.bit_length() - 1
    chosen = {largest: 1}
    for length, n, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + n
            target -= n * length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first_rank, last_rank + 1, first_bin, in_each_bin, offset)`` that place every piece of the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    ranks, runs, bins = [0] * (capacity + 1), [], 0
    largest = capacity
    while True:
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            return runs
        chosen = fullest(counts, largest, capacity)
        times = min(counts[length] // n for length, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            runs.append((length, ranks[length], ranks[length] + times * n, bins, n, offset))
            ranks[length] += times * n
            counts[length] -= times * n
            offset += n * length
        bins += times


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: each piece and its place."""
    spark = df.sparkSession
    buckets = shuffle_partitions(spark)
    cut_up = pieces(df, id_col, text_col, capacity, end_id, path)
    table = materialise(
        cut_up.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")), "pieces"
    )
    per_bucket = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # At most capacity x buckets rows; each length's are few, one for each bucket.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(per_bucket.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    by_length: dict[int, list] = {}
    for length, first, last, first_bin, n, offset in plan(histogram, capacity):
        by_length.setdefault(length, []).append((first, last, first_bin, n, offset))
    runs = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for each in np.unique(length):
                at = np.flatnonzero(length == each)
                run = runs.value[int(each)]
                k = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                past = rank[at] - k[:, 0]
                sequence[at], offset[at] = k[:, 2] + past // k[:, 3], k[:, 4] + past % k[:, 3] * each
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    within = Window.partitionBy("bucket", "length").orderBy("row")
    ranked = (
        table.withColumn("in_bucket", F.row_number().over(within) - 1)
        .join(starts.select("bucket", "length", "first"), ["bucket", "length"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("in_bucket")).alias("rank"))
    )
    kind = dict(ranked.dtypes)["id"]
    placed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
