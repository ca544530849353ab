"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its lines (paragraphs).  Each line is hashed to a wide vector, and a text's fingerprint is the sum of
its lines' vectors, component by component, modulo a power of two.  So the order of lines doesn't matter, equal multisets
have equal fingerprints, and a line is inserted or deleted by adding or subtracting its vector (:func:`combine`).

The vector has two parts:

* ``STRONG`` sums of independent 62-bit hashes modulo 2**62.  They decide equality.
* ``LANES`` small counters, three to a long of 60 bits (each modulo 2**20): a counter grows by one bit of a hash of the line.  With the
  number of lines, also summed, a counter gives a sum of random signs, so the mean square of the counters' differences
  estimates how many lines two texts don't share.  :func:`likeness` is ``1 - apart / (lines + lines)``, cut to 0..1.
  The sum of signs is read modulo 2**21 as the number next to zero, so counters may overflow: it is right as long as it lies within
  2**20, which takes one line some million times over to leave, not a million different ones.

Its error is about ``sqrt(2 / LANES)`` (0.13) for texts that share nothing and falls to 0 as they come to share all.

Defined results: null text is the empty text (one empty line); equal texts have equal fingerprints; neighbours are
taken in descending id order with ties in descending order of the text and null ids last, the last is followed by the
first (a single row by itself); repeated rows are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.llm.common import materialise, shuffle_partitions, text_or_empty

STRONG, PACKS_A_HASH, HASHES, LANES_A_PACK, LANE_BITS = 4, 20, 2, 3, 20
PACKS = PACKS_A_HASH * HASHES
LANES = PACKS * LANES_A_PACK
STRONG_MASK, PACK_MASK = (1 << 62) - 1, (1 << 60) - 1
UNITS = sum(1 << (LANE_BITS * i) for i in range(LANES_A_PACK))
#: Positions in the vector: the strong sums, the packed counters, the number of lines.
WIDTH = STRONG + PACKS + 1
#: Rows that a bucket of neighbours holds about, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1_000, 20_000


def _masks() -> Column:
    return F.array(*[F.lit(STRONG_MASK)] * STRONG, *[F.lit(PACK_MASK)] * (PACKS + 1))


def vector(text: Column) -> Column:
    """``array<long>`` of ``WIDTH``: the sum over the text's lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    hashed = F.transform(
        lines, lambda line: F.struct(*[F.xxhash64(line, F.lit(i)).alias(f"h{i}") for i in range(max(STRONG, HASHES))])
    )

    def grown(sums: Column, h: Column) -> Column:
        strong = [(sums[f"s{i}"] + h[f"h{i}"].bitwiseAND(F.lit(STRONG_MASK))).bitwiseAND(F.lit(STRONG_MASK)).alias(f"s{i}") for i in range(STRONG)]
        packs = []
        for i in range(PACKS):
            bits = F.shiftrightunsigned(h[f"h{i // PACKS_A_HASH}"], i % PACKS_A_HASH).bitwiseAND(F.lit(UNITS))
            packs.append((sums[f"p{i}"] + bits).bitwiseAND(F.lit(PACK_MASK)).alias(f"p{i}"))
        return F.struct(*strong, *packs)

    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{i}") for i in range(STRONG)], *[F.lit(0).cast("long").alias(f"p{i}") for i in range(PACKS)])
    names = [f"s{i}" for i in range(STRONG)] + [f"p{i}" for i in range(PACKS)]

    def flat(sums: Column) -> Column:
        return F.array(*[sums[n] for n in names])

    return F.concat(F.aggregate(hashed, zero, grown, flat), F.array(F.size(lines).cast("long")))


def combine(left: Column, right: Column, delete: bool = False) -> Column:
    """Vector of the union of two multisets of lines, or of ``left`` without ``right``."""
    both = F.arrays_zip(left.alias("a"), right.alias("b"), _masks().alias("m"))
    names = ["a", "b", "m"]

    def each(x: Column) -> Column:
        a, b, m = (x[n] for n in names)
        other = (m - b + 1) if delete else b
        return (a + other.bitwiseAND(m)).bitwiseAND(m)

    return F.transform(both, each)


def fingerprint(vec: Column) -> Column:
    """The vector in hexadecimal digits, 16 for each long."""
    return F.array_join(F.transform(vec, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _squares(left: Column, right: Column | None) -> Column:
    """Sum over the lanes of (2 * counter - lines) squared, of the difference of two vectors or of one."""
    lane, half = (1 << LANE_BITS) - 1, 1 << LANE_BITS
    lines = F.element_at(left, WIDTH) - (F.element_at(right, WIDTH) if right is not None else F.lit(0))

    def of_pack(sums: Column, i: Column) -> Column:
        total = sums
        for k in range(LANES_A_PACK):
            a = F.shiftrightunsigned(F.element_at(left, i), LANE_BITS * k).bitwiseAND(F.lit(lane))
            b = F.shiftrightunsigned(F.element_at(right, i), LANE_BITS * k).bitwiseAND(F.lit(lane)) if right is not None else F.lit(0)
            # A counter is known modulo 2**20, so twice a counter modulo 2**21.
            signs = (F.lit(2) * (a - b) - lines + F.lit(half)).bitwiseAND(F.lit(2 * half - 1)) - F.lit(half)
            total = total + signs.cast("double") * signs.cast("double")
        return total

    return F.aggregate(F.sequence(F.lit(STRONG + 1), F.lit(STRONG + PACKS)), F.lit(0.0), of_pack)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the estimated share of lines that two texts have in common; exactly 1 for equal vectors."""
    apart = F.try_divide(_squares(left, right), _squares(left, None) + _squares(right, None))
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(apart, F.lit(1.0)))))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, next_text)``: each row with the text after it in descending id order, the last with the first.

    Rows are dealt into buckets of the id's range, and each bucket looks ahead by itself.  A bucket's last row gets the first row of
    the next bucket that has any: one row for each bucket goes there as a guest.  So no task sees the whole order.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n, least, most = rows.agg(F.count("*"), F.min("id"), F.max("id")).first()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    bounds: list = []
    if least is not None and buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(rows.agg(F.percentile_approx("id", at, 20 * buckets).alias("q")).first().q or []))
    # Bucket 0 has the largest ids; null ids are in the last.
    position = _bucket(F.col("id"), bounds)
    dealt = rows.withColumn("bucket", F.coalesce(position, F.lit(len(bounds) + 1)))
    order = [F.desc_nulls_last("id"), F.desc("text")]
    # At most MAX_BUCKETS + 1 rows, so the broadcast is bounded.
    top = materialise(dealt.groupBy("bucket").agg(F.max("id").alias("top")), "top-of-bucket")
    heads = dealt.join(F.broadcast(top.withColumnRenamed("bucket", "of")), (F.col("bucket") == F.col("of")) & F.col("id").eqNullSafe(F.col("top")))
    firsts = materialise(heads.groupBy("bucket").agg(F.max("id").alias("id"), F.max("text").alias("text")), "first-of-bucket")
    used = sorted(r.bucket for r in top.select("bucket").collect())
    if not used:
        return dealt.select("id", "text", F.col("text").alias("next_text"))
    before = F.map_from_arrays(F.lit(used), F.lit(used[-1:] + used[:-1]))
    guests = firsts.select("id", "text", F.element_at(before, F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    ahead = Window.partitionBy("bucket").orderBy("guest", *order)
    looked = both.withColumn("next_text", F.lead("text").over(ahead)).where(~F.col("guest"))
    return looked.select("id", "text", "next_text")


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are larger than the value: first among every k-th bound, then within k of them."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    k = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(F.lit(bounds[k - 1 :: k]), lambda b: b <= value))
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse * k + 1, k), lambda b: b <= value))
    return F.when(value.isNotNull(), F.lit(len(bounds)) - (coarse * k + fine))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, vector, fingerprint)`` of every row."""
    vec = vector(F.col(text_col))
    rows = df.select(F.col(id_col), F.length(text_or_empty(text_col)).cast("long").alias("n_chars"), vec.alias("vector"))
    return rows.withColumn("fingerprint", fingerprint(F.col("vector")))


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the vectors of its text, of its edited text and of the next text, and the edited text."""
    pairs = with_next(df, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return pairs.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        vector(F.col("text")).alias("vector"),
        vector(edited).alias("edited_vector"),
        vector(F.col("next_text")).alias("next_vector"),
    )
