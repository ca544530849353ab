"""All pairs of points in blocks: distances live in one task's memory, and only sums leave it.

Points are dealt into blocks by a hash; a pair of blocks is one task's work.  Work is the square of the number of points, as the
metrics demand; a task holds two blocks, and shuffled data is the points times the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4_096


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squared, 0))


def block_pairs(points: DataFrame, vectors: list[str], kernel: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Apply ``kernel(same, left, right)`` to every pair of blocks, each pair once.

    ``points`` has ``row`` (long, unique), ``code`` (int) and array columns ``vectors``.  A side is a dict of numpy arrays: ``row``, ``code``
    and one matrix for each vector column.  The kernel yields Arrow batches of ``schema``.
    """
    spark = points.sparkSession
    n = points.count()
    blocks = max(1, -(-n // block))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    if blocks == 1 and n > 256:  # small data: still as many pairs as there are tasks
        blocks = max(1, min(int((2 * tasks) ** 0.5), n // 128))
    packed = points.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "code", *vectors)
    names = ["row", "code", *vectors]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of_row = batch.column("block").to_numpy()
            for b in np.unique(of_row):
                mine = batch.take(pa.array(np.flatnonzero(of_row == b)))
                data = [mine.column("row").to_numpy().astype(np.int64).tobytes(), mine.column("code").to_numpy().astype(np.int32).tobytes()]
                data += [mine.column(v).flatten().to_numpy().astype(np.float64).tobytes() for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["block", *names])

    binary = ", ".join(f"{x} binary" for x in names)
    sides = packed.mapInArrow(pack, f"block int, {binary}")
    low, high = F.lit(0), F.lit(blocks - 1)
    partner = F.explode(F.sequence(low, high))
    dealt = sides.select("*", partner.alias("other")).select(
        (F.least("block", "other") * F.lit(blocks).cast("long") + F.greatest("block", "other")).alias("pair"), (F.col("block") > F.col("other")).alias("right"), "block", "other", *names
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.column("pair")[i].as_py()
                if pair != now:
                    yield from finished(now, held)
                    now, held = pair, ([], [])
                held[batch.column("right")[i].as_py()].append([batch.column(c)[i].as_py() for c in names])
        yield from finished(now, held)

    def finished(pair, held) -> Iterator[pa.RecordBatch]:
        same = pair is not None and pair // blocks == pair % blocks
        if pair is None or not held[0] or not same and not held[1]:
            return
        left = _side(held[0])
        yield from kernel(same, left, left if same else _side(held[1]))

    def _side(parts: list) -> dict:
        side = {"row": np.frombuffer(b"".join(p[0] for p in parts), np.int64), "code": np.frombuffer(b"".join(p[1] for p in parts), np.int32)}
        for i, v in enumerate(vectors):
            side[v] = np.frombuffer(b"".join(p[2 + i] for p in parts), np.float64).reshape(len(side["row"]), -1)
        return side

    pairs = blocks * (blocks + 1) // 2
    return dealt.repartition(max(1, min(pairs, 20_000)), "pair").sortWithinPartitions("pair").mapInArrow(run, schema)


#: Bytes of the points and sums that a task of :func:`block_sums` holds, and rows of a block at least and at most.
HELD, LEAST, MOST = 64 << 20, 256, 1 << 16


def block_sums(points: DataFrame, vec_col: str, columns: int, sums: Callable, score: Callable) -> DataFrame:
    """``(total, n)`` for each block of ``points(row, code, vec)``: ``score(block, sums of the block against all points)``.

    ``sums(left, rights)`` gives ``columns`` numbers for each point of a block, summed over an iterator of other points; sides are as in :func:`block_pairs`.  A block
    meets the others in a few shares, each a task that holds the block and streams through the share.
    """
    spark = points.sparkSession
    shape = points.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    size = max(LEAST, min(MOST, HELD // (8 * ((shape.d or 0) + columns + 2))))
    blocks = max(1, -(-shape.n // size))
    if blocks * blocks < tasks:  # small data: still as many pairs as there are tasks
        blocks = max(blocks, min(int((2 * tasks) ** 0.5), shape.n // 128))
    shares = max(1, min(blocks, -(-tasks // blocks)))
    packed = points.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "code", F.col(vec_col).alias("vec"))
    names = ["row", "code", "vec"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row = batch.column("block").to_numpy()
            for b in np.unique(of_row):
                mine = batch.take(pa.array(np.flatnonzero(of_row == b)))
                data = [mine.column("row").to_numpy().astype(np.int64).tobytes(), mine.column("code").to_numpy().astype(np.int32).tobytes()]
                data.append(mine.column("vec").flatten().to_numpy().astype(np.float64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], names=["block", *names])

    binary = "row binary, code binary, vec binary"
    sides = packed.mapInArrow(pack, f"block int, {binary}")
    as_left = sides.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("right", F.lit(False))
    as_right = sides.withColumn("share", F.pmod("block", F.lit(shares))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("right", F.lit(True))
    met = as_left.unionByName(as_right).repartition(max(1, min(blocks * shares, 20_000)), "block", "share").sortWithinPartitions("block", "share", "right")

    def side(parts: list) -> dict:
        made = {"row": np.frombuffer(b"".join(p[0] for p in parts), np.int64), "code": np.frombuffer(b"".join(p[1] for p in parts), np.int32)}
        made["vec"] = np.frombuffer(b"".join(p[2] for p in parts), np.float64).reshape(len(made["row"]), -1)
        return made

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(c)[i].as_py() for c in ("block", "share", "right", *names)) for batch in batches for i in range(batch.num_rows))
        for (block, _), mine in groupby(rows, key=lambda r: r[:2]):
            parts, first = [], None
            for r in mine:
                if r[2]:
                    first = r
                    break
                parts.append(r[3:])
            if not parts:
                continue
            left = side(parts)
            rights = (side([r[3:]]) for r in chain([first], mine)) if first else iter(())
            total = sums(left, rights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (left["row"], left["code"], total)]], names=["block", "row", "code", "sums"]
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(c)[i].as_py() for c in ("block", "row", "code", "sums")) for batch in batches for i in range(batch.num_rows))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            left, total = None, 0.0
            for _, row, code, data in mine:
                order = np.argsort(np.frombuffer(row, np.int64))  # a block's points may come in another order in each share
                left = {"row": np.frombuffer(row, np.int64)[order], "code": np.frombuffer(code, np.int32)[order]}
                total = total + np.frombuffer(data, np.float64).reshape(len(order), -1)[order]
            value, n = score(left, total)
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.float64()), pa.array([n], pa.int64())], names=["total", "n"])

    partial = met.mapInArrow(summed, "block int, row binary, code binary, sums binary").repartition(max(1, min(blocks, 20_000)), "block").sortWithinPartitions("block")
    return partial.mapInArrow(scored, "total double, n long")
