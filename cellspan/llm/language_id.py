"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, each run of other characters becomes one space, and n-grams of one to three characters fall into
``BUCKETS`` buckets.  The matrix of log probabilities (buckets x languages) is broadcast, and texts are scored in
batches: the buckets of all texts of a batch in one array, one gather from the matrix, and sums by text.

The model is fitted on at most ``per_language`` texts of each language (chosen by a hash of the id; a documented bound), whole
texts each; its counts are summed by Spark and reach the driver as at most buckets x languages numbers.  The score
is the posterior probability of the predicted language, with the log likelihood of a long text scaled down to that of
``SCALE`` n-grams, as n-grams of a text aren't independent.

Defined results: null text or a text without any letter gives ``und`` and score 0; null and repeated ids are scored row by
row; ties go to the language that sorts first; without any training text all is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import text_or_empty

BUCKETS, ORDERS, SCALE, PER_LANGUAGE, UNKNOWN = 1 << 16, (1, 2, 3), 200.0, 4_000, "und"
#: Rows below this score are rejected by :func:`keep_known`.
LEAST_SCORE = 0.5
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Numbers (characters x languages) that are gathered in one go.
GATHERED = 1 << 20


def clean(text: str | None) -> str:
    """Lower-cased letters with single spaces between and around; empty if there is no letter."""
    if not text or not _LETTER.search(text):
        return ""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def ngram_buckets(codes: np.ndarray, buckets: int = BUCKETS):
    """For each order the buckets of the n-grams that start at each position of an array of code points."""
    mixed = np.zeros(len(codes), np.uint64)
    for k in range(max(ORDERS)):
        if k >= len(codes):
            return
        end = len(codes) - k
        mixed = mixed[:end] * np.uint64(0x100000001B3) + codes[k:].astype(np.uint64) + np.uint64(1)
        if k + 1 in ORDERS:
            h = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            yield (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count(text: str, buckets: int = BUCKETS) -> np.ndarray:
    found = [b for b in ngram_buckets(_codes(text), buckets)]
    return np.bincount(np.concatenate(found), minlength=buckets) if found else np.zeros(buckets, np.int64)


class Model:
    """Languages and the matrix of log probabilities; ``predict`` gives the best language and its score."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray):
        self.languages, self.logs, self.priors = languages, np.ascontiguousarray(logs, np.float32), priors
        self.chunk = max(4096, GATHERED // max(1, len(languages)))

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        codes, total, n = _codes(text), np.zeros(len(self.languages)), 0
        for start in range(0, len(codes), self.chunk):
            part = codes[start : start + self.chunk + max(ORDERS) - 1]
            for k, found in enumerate(ngram_buckets(part)):
                found = found[:self.chunk] if start + self.chunk < len(codes) else found
                total += self.logs[found].sum(axis=0, dtype=np.float64)
                n += len(found)
        return total, n

    def predict_batch(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Short texts are scored together; a text longer than the chunk alone."""
        names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, values
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.chunk:
                self._put([i], [self.scores(text)], names, values)
                continue
            if size + len(text) > self.chunk and group:
                self._put(group, self._together([texts[j] for j in group]), names, values)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            self._put(group, self._together([texts[j] for j in group]), names, values)
        return names, values

    def _together(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        totals, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for order, found in enumerate(ngram_buckets(codes), 1):
            # sums[i]: of all n-grams before position i; a text's n-grams end before the text does
            sums = np.zeros((len(found) + 1, len(self.languages)))
            np.cumsum(self.logs[found], axis=0, dtype=np.float64, out=sums[1:])
            stop = np.maximum(ends - order + 1, starts)
            totals += sums[stop] - sums[starts]
            counts += stop - starts
        return list(zip(totals, counts, strict=True))

    def _put(self, at, scored, names, values) -> None:
        for i, (total, n) in zip(at, scored, strict=True):
            log = total * min(1.0, SCALE / max(n, 1)) + self.priors
            best = int(np.argmax(log))
            names[i] = self.languages[best]
            values[i] = 1.0 / np.exp(log - log[best]).sum()


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Model of the rows of ``df`` with a language and a text."""
    spark = df.sparkSession
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).agg(F.count("*")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    # A row is taken if a hash of its id and text falls into its language's share.
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                counts[lang] = counts.get(lang, 0) + count(clean(text.as_py()))
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "bucket", "n"])

    tallied = chosen.mapInArrow(tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = tallied.toArrow() if hasattr(tallied, "toArrow") else pa.Table.from_pandas(tallied.toPandas())
    matrix = np.zeros((BUCKETS, len(languages)))
    place = {k: i for i, k in enumerate(languages)}
    if table.num_rows:
        matrix[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    smooth = 0.5
    logs = np.log(matrix + smooth) - np.log(matrix.sum(axis=0) + smooth * BUCKETS)
    total = sum(sizes.values())
    return Model(languages, logs, np.log([sizes[k] / total for k in languages]))


def predictor(spark, model: Model):
    """Function of a text column that gives ``struct<lang_pred, score>``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, values = shared.value.predict_batch([clean(t.as_py()) for t in texts])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every row; learns from the rows that aren't held out."""
    model = fit(df.where(~held_out(id_col)), id_col, text_col, lang_col, per_language)
    predict = predictor(df.sparkSession, model)
    found = df.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(text_or_empty(text_col)).alias("found"))
    return found.select(F.col(id_col), "held_out", "found.lang_pred", "found.score")


def keep_known(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """The rows with a recognised language (a score of ``least`` at least), with all their columns; learns from all of them.

    Without any row to learn from nothing can be recognised, and only rows without a letter go.
    """
    model = fit(df, id_col, text_col, lang_col, per_language)
    if not model.languages:
        return df.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    found = predictor(df.sparkSession, model)(text_or_empty(text_col))
    return df.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
