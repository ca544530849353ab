"""Byte-level BPE encoding by a global distinct-word shuffle, and decoding by the token-byte table.

Encoding has three steps, and rows in all of them are packed, because a row for each occurrence would cost several times
the text:

1. Texts are cut into pre-tokens with their positions, block by block (``BLOCK`` characters of whole texts).  A block's distinct
   words are numbered by falling frequency, and the block keeps the sequence of its texts' word numbers, which are the
   positions.  The words go out in packets, one for each block and hash bucket.
2. Packets meet by bucket, over all blocks; a bucket encodes each distinct word once and answers every packet with the ids of its
   words, in the packet's order.
3. Answers come back to their blocks, and each text is put together by position.

What step 1 makes is written once in the shared folder, in buckets by block: both its readers see the same blocks, a lost executor
repeats single tasks, and step 3 shuffles the answers alone, as the number sequences lie where they are needed.  A word
that all texts hold costs one entry a block, wherever it is; no bucket gets more of it.  There is a bucket for every ``BUCKET``
characters of the table (and for every shuffle partition, at least), and a worker takes one after the other, so memory is bounded by a
block and by the distinct words of one bucket, however large the table is.

Decoding looks each id up in the token-byte table (a fixed vocabulary of some 50,000 entries, read by each worker from its
file) and concatenates, for many texts at once.

Defined results: null text is the empty text, with no ids; null and repeated ids get a row each; an empty table gives an
empty result; other columns are ignored; special strings are ordinary text; null ids decode to null, and ids outside the
table raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm import pretokens
from cellspan.llm.common import materialise_bucketed, shuffle_partitions, text_or_empty

#: Characters of a block (more only if a single text is longer), ids that are decoded in one go, and characters for which there is a bucket of words.
BLOCK, DECODED, BUCKET = 8 << 20, 1 << 19, 1 << 27

_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, as compressed byte planes; high planes are almost all zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _pack(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(strings: list[str]) -> bytes:
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    sizes = np.array([len(r) for r in raw], "<u4")
    return _pack(len(raw).to_bytes(4, "little") + sizes.tobytes() + b"".join(raw))


def unpack_strings(data: bytes) -> list[bytes]:
    raw = _unpack(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=False)] if n else []


class _Numbers(dict):
    """Words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split_blocks(buckets: int, kind: str):
    """Step 1; blocks are named by task and count, once and for all, as the result is written."""
    schema = pa.schema(
        [("block", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("ids", pa.list_(_ID_TYPES[kind])), ("texts", pa.binary())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, size = TaskContext.get().partitionId(), 0, 0
        ids, sequences, numbers = [], [], _Numbers()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                words = pretokens.split(text)
                ids.append(key.as_py())
                sequences.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text)
                if size >= BLOCK:
                    yield block((task << 32) + serial, ids, sequences, numbers)
                    ids, sequences, numbers, size, serial = [], [], _Numbers(), 0, serial + 1
        if ids:
            yield block((task << 32) + serial, ids, sequences, numbers)

    def block(name: int, ids: list, sequences: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        sequence = np.concatenate(sequences)
        common_first = np.argsort(-np.bincount(sequence, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(numbers), np.uint32)
        rank[common_first] = np.arange(len(numbers), dtype=np.uint32)
        of_bucket: dict[int, list[str]] = {}
        for w in numbers:
            of_bucket.setdefault(crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
        parts, packets, order = sorted(of_bucket), [], []
        for b in parts:
            mine = sorted(of_bucket[b])
            order.append(np.fromiter(map(numbers.__getitem__, mine), np.int64, len(mine)))
            packets.append(pack_strings(mine))
        ranks = rank[np.concatenate(order)] if order else np.zeros(0, np.uint32)
        lengths = np.array([len(x) for x in sequences], np.uint32)
        texts = _join([pack_numbers(ranks), pack_numbers(lengths), pack_numbers(rank[sequence])])
        n = len(parts)
        columns = [[name] * (n + 1), [*parts, -1], [*packets, None], [None] * n + [ids], [None] * n + [texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return split


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _encode_words(path: str | None):
    """Step 2: answer packets of words, sorted by bucket, with packets of ids; each distinct word of a bucket is encoded once."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.rank_encoder(path)._core_bpe
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            for name, part, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if part.as_py() != now:
                    now = part.as_py()
                    known.clear()
                words = unpack_strings(data.as_py())
                for w in words:
                    if w not in known:
                        known[w] = encoder.encode_single_piece(w)
                found = [known[w] for w in words]
                lengths = np.array([len(x) for x in found], np.uint32)
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
                answer = _join([pack_numbers(lengths), pack_numbers(flat)])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array([part.as_py()], pa.int64()), pa.array([answer], pa.binary())], schema=schema)

    return encode


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + lengths[i]]`` for all i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _reassemble(kind: str, decoded: bool, path: str | None):
    """Step 3: a block's number sequences and the answers to its packets; decodes the ids of each text too if asked."""
    schema = pa.schema([("id", _ID_TYPES[kind]), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.binary())] * decoded)

    def put(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lengths, flats = [], []
        for data in answers.sort_by("part")["words"]:
            a, b = _parts(data.as_py())
            lengths.append(unpack_numbers(a))
            flats.append(unpack_numbers(b))
        keys, out = [], []
        if texts.num_rows:
            ranks, sizes, numbers = map(unpack_numbers, _parts(texts["texts"][0].as_py()))
            flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
            length = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
            starts, of_rank = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            starts[ranks], of_rank[ranks] = np.cumsum(length) - length, length
            keys, end = texts["ids"][0].as_py(), 0
            for size in sizes.tolist():
                mine = numbers[end : end + size]
                end += size
                out.append(ragged(flat, starts[mine], of_rank[mine]).astype("<u4").tobytes())
        columns = [pa.array(keys, schema[0].type), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())]
        if decoded:
            columns.append(pa.array([decode_bytes(id_array(x), path) for x in out], pa.binary()))
        return pa.Table.from_arrays(columns, schema=schema)

    return put


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)`` of every row; ``ids`` is BINARY, little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded again where they are put together, as :func:`decode` would, into a column of that name.
    """
    spark = df.sparkSession
    tasks = shuffle_partitions(spark)
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    if kind not in _ID_TYPES:
        raise TypeError(f"{id_col} is {kind}; ids are bigint, int or string")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(tasks, -(-chars // BUCKET))
    packed = f"block long, part long, words binary, ids array<{kind}>, texts binary"
    blocks = materialise_bucketed(rows.mapInArrow(_split_blocks(buckets, kind), packed), "word-blocks", tasks, "block")
    words = blocks.where("part >= 0").select("block", "part", "words")
    answers = words.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_encode_words(path), "block long, part long, words binary")
    texts = blocks.where("part < 0").select("block", "ids", "texts")
    made = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _reassemble(kind, decoded, path), f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    )
    return made.withColumnRenamed("id", id_col)


def id_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


@lru_cache(2)
def _flat_table(path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and each id's start and length in it (-1 for ids that aren't there)."""
    table = pretokens.token_bytes(path)
    lengths = np.full(max(table) + 1, -1, np.int64)
    for i, raw in table.items():
        lengths[i] = len(raw)
    sizes = np.maximum(lengths, 0)
    flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(sizes))), np.uint8)
    return flat, np.cumsum(sizes) - sizes, lengths


def decode_bytes(ids: np.ndarray, path: str | None = None) -> bytes:
    flat, starts, lengths = _flat_table(path)
    out = []
    for begin in range(0, len(ids), DECODED):
        part = ids[begin : begin + DECODED]
        if part.max() >= len(lengths) or (lengths[part] < 0).any():
            raise ValueError("an id that the vocabulary does not have")
        out.append(ragged(flat, starts[part], lengths[part]).tobytes())
    return out[0] if len(out) == 1 else b"".join(out)


def decoder(path: str | None = None):
    """Function of a column of ids (as :func:`encode` returns them) that gives the decoded bytes."""

    @F.arrow_udf("binary")
    def decode_ids(column: pa.Array) -> pa.Array:
        # Rows go straight into one buffer, so that a batch is held once and not as objects besides.
        data, ends = bytearray(), np.zeros(len(column) + 1, np.int32)
        for i, x in enumerate(column):
            if x.is_valid:
                data += decode_bytes(id_array(x.as_buffer()), path)
            ends[i + 1] = len(data)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        valid = None if not missing.any() else pa.array(~missing).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(ends), pa.py_buffer(data)])

    return decode_ids


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with a column ``decoded``: the bytes that the ids stand for; null ids give null."""
    return df.withColumn("decoded", decoder(path)(F.col(ids_col)))
