"""Token counts of whole texts: a map-side two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier 1 is a broadcast hash table of the most frequent pre-tokens and their lengths (sent as one string and a byte for each; a worker makes a fixed table of it, which
nothing enters or leaves).  Which those are is counted over all
texts: each task keeps the counts of its own texts and hands over its ``per_task`` most frequent ones, whose sums are
ranked; that is a bounded sketch, and no pre-token row is shuffled.  Tier 2 is a bounded cache in each Python worker, apart from tier 1, which
has the tokenizer encode what tier 1 lacks.  The tables change the speed only; every count is exact.

Defined results: null text counts as empty (0 bytes, 0 tokens); null or repeated ids are kept as they are, one row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm import pretokens
from cellspan.llm.common import text_or_empty

#: Entries of tier 1, and what a task hands over to rank them.
TIER1, PER_TASK = 32_768, 4_096
#: A task's own counter is cut back to its most frequent half beyond so many words.
COUNTER_LIMIT = 400_000

_SKETCH = pa.schema([("word", pa.string()), ("n", pa.int64())])


def frequent_pretokens(df: DataFrame, text_col: str = "text", size: int = TIER1, per_task: int = PER_TASK) -> list[str]:
    """The (about) ``size`` most frequent pre-tokens of all texts; at most ``size`` strings reach the driver."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(pretokens.split(text.as_py()))
                if len(counts) > COUNTER_LIMIT:
                    counts = Counter(dict(counts.most_common(COUNTER_LIMIT // 2)))
        top = [(w, n) for w, n in counts.most_common(per_task) if len(w) <= 64 and "\0" not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], schema=_SKETCH)

    found = df.select(text_or_empty(text_col).alias("text")).mapInArrow(sketch, "word string, n long")
    ranked = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in ranked.collect()]


_caches: dict = {}


def _cache(table) -> pretokens.Frequent:
    """This worker's two tiers for a broadcast table; kept between tasks."""
    if table.id not in _caches:
        _caches.clear()
        path, words, lengths = table.value
        _caches[table.id] = pretokens.Frequent(dict(zip(words.split("\0"), lengths, strict=True)) if lengths else {}, pretokens.WordCache(length_of(path)))
    return _caches[table.id]


class _Table:
    """A broadcast with a name that stays the same in all tasks."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def length_of(path: str | None = None):
    encode = pretokens.word_encoder(path)
    return lambda word: len(encode(word))


def count_text(text: str, cache: dict, path: str | None = None) -> int:
    return sum(1 if special else sum(map(cache.__getitem__, pretokens.split(part))) for special, part in pretokens.segments(text, path))


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None, tier1: int = TIER1
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, as the library for the ``.json`` vocabulary counts."""
    spark = df.sparkSession
    words = frequent_pretokens(df, text_col, tier1)
    # A word has 64 characters at most, so 256 bytes and 256 tokens; those few that don't fit a byte stay out.
    found = [(w, n) for w, n in zip(words, map(length_of(path), words), strict=True) if n < 256]
    words, lengths = [w for w, _ in found], bytes(n for _, n in found)
    table = _Table(spark.sparkContext.broadcast((path, "\0".join(words), lengths)), uuid.uuid4().hex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(table)
        for batch in batches:
            n = [count_text(t.as_py(), cache, path) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
