"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on each text.  How often each pattern of votes occurs is counted
over all texts (at most 3 to the power of the number of labellers), and expectation-maximisation on these counts estimates, without any
given label, each labeller's accuracy on good and on bad texts and the share of good ones; votes are taken as
independent given the class, and abstention says nothing.  The posterior of each pattern is the soft label on which a hashed
linear scorer is trained: logistic regression over hashed n-grams of character classes (runs of the same class count
once) and hashed bins of text statistics.  Texts whose score is below ``THRESHOLD`` are rejected.

The scorer is fitted on at most ``SAMPLE`` texts (drawn by a hash of id and text; a documented bound), whole texts each; the vote
counts cover all.  Fixed thresholds of the labellers are in :func:`votes`.

Defined results: null text is empty; the empty text gets no vote and the score that the fit gives texts without features; null and
repeated ids are scored row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import text_or_empty
from cellspan.llm.linear import fit_descent, sigmoid

#: A text is rejected only where the scorer is sure enough, so that clean texts stay.
BINS, SAMPLE, THRESHOLD = 1 << 11, 6_000, 0.2
LABELLERS = ("symbols", "capitals", "repeated_words", "few_distinct_words", "separators", "piled_marks", "repeated_lines")

# Classes of characters: other, lower, upper, digit, space, line end, sentence marks, and one for each other ASCII mark.
LOWER, UPPER, DIGIT, SPACE, LINE, SENTENCE, FIRST_MARK = 1, 2, 3, 4, 5, 6, 7
_SENTENCE = ".,;:'\"?!-()"
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in _SENTENCE)
CLASSES = FIRST_MARK + len(_MARKS)


def _classes() -> np.ndarray:
    """Class of each code point below 2**16; those above count as lower-case letters, like all scripts without case."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c in _MARKS:
            table[i] = FIRST_MARK + _MARKS.index(c)
        elif c in _SENTENCE:
            table[i] = SENTENCE
        elif c == "\n":
            table[i] = LINE
        elif c.isspace():
            table[i] = SPACE
        elif c.isupper():
            table[i] = UPPER
        elif c.isalpha():
            table[i] = LOWER
        elif c.isdigit():
            table[i] = DIGIT
    return table


_table: list[np.ndarray] = []


def classes_of(text: str) -> np.ndarray:
    if not _table:
        _table.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1 << 16, _table[0][np.minimum(codes, (1 << 16) - 1)], np.uint8(LOWER))


class Profile:
    """What labellers and scorer look at, of one whole text."""

    def __init__(self, text: str):
        self.classes = classes_of(text)
        self.counts = np.bincount(self.classes, minlength=CLASSES)
        words = text.split()
        self.n_words = len(words)
        self.distinct = len(set(words))
        self.same_as_before = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
        self.separators = sum(len(w) == 1 and not w.isalnum() for w in words) / max(1, len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        self.n_lines, self.same_lines = len(lines), 1 - len(set(lines)) / max(1, len(lines))
        visible = len(text) - self.counts[SPACE] - self.counts[LINE]
        letters = self.counts[LOWER] + self.counts[UPPER]
        self.symbols = self.counts[FIRST_MARK:].sum() / max(1, visible)
        self.capitals, self.letters = self.counts[UPPER] / max(1, letters), letters
        marks = (self.classes == SENTENCE) | (self.classes >= FIRST_MARK)
        self.piled = float((marks[1:] & marks[:-1]).sum()) / max(1, len(words))
        self.root_distinct = self.distinct / max(1.0, self.n_words) ** 0.5


def _vote(good: bool, bad: bool) -> int:
    return 2 if bad else 1 if good else 0


def votes(p: Profile) -> tuple[int, ...]:
    """For each labeller 0 (abstains), 1 (good) or 2 (bad)."""
    few = p.n_words >= 12
    return (
        _vote(p.symbols < 0.01 and few, p.symbols > 0.06),
        _vote(p.capitals < 0.15 and p.letters >= 40, p.capitals > 0.45 and p.letters >= 40),
        _vote(p.same_as_before < 0.05 and few, p.same_as_before > 0.3 and few),
        _vote(p.root_distinct > 4 and p.n_words >= 25, p.root_distinct < 2 and few),
        _vote(p.separators < 0.02 and few, p.separators > 0.15),
        _vote(p.piled < 0.05 and few, p.piled > 0.4),
        _vote(p.same_lines < 0.2 and p.n_lines >= 5, p.same_lines > 0.6 and p.n_lines >= 5),
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def features(p: Profile) -> np.ndarray:
    """``BINS`` numbers: shares of hashed n-grams of class runs, and hashed bins of the statistics."""
    x = np.zeros(BINS, np.float32)
    c = p.classes
    if len(c):
        runs = c[np.concatenate([[True], c[1:] != c[:-1]])].astype(np.uint64)
        for n in (1, 2, 3):
            if len(runs) >= n:
                h = np.zeros(len(runs) - n + 1, np.uint64)
                for k in range(n):
                    h = h * np.uint64(131) + runs[k : len(runs) - n + 1 + k] + np.uint64(1)
                h = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(64 - BINS.bit_length() + 1)
                x += np.bincount(h.astype(np.int64), minlength=BINS).astype(np.float32) * (10.0 / len(h))
    for k, (value, edges) in enumerate(
        (
            (p.symbols, (0.01, 0.03, 0.06, 0.12, 0.25)),
            (p.capitals, (0.1, 0.2, 0.45, 0.7)),
            (p.same_as_before, (0.02, 0.05, 0.15, 0.3, 0.6)),
            (p.root_distinct, (0.5, 1.0, 2.0, 3.0, 4.0)),
            (p.separators, (0.02, 0.08, 0.15, 0.3)),
            (p.piled, (0.05, 0.15, 0.4, 0.8)),
            (p.same_lines, (0.1, 0.2, 0.4, 0.6)),
            (float(np.log2(p.n_words + 1)), (2.0, 4.0, 6.0, 8.0)),
        )
    ):
        b = int(np.searchsorted(edges, value, side="right"))
        x[(k * 16 + b + 1) * 2654435761 % (1 << 32) >> (32 - BINS.bit_length() + 1)] += 1.0
    return x


class WeakLabels:
    """Labeller accuracies and class share from expectation-maximisation over counted vote patterns."""

    def __init__(self, counts: dict[int, int], steps: int = 100):
        k = len(LABELLERS)
        keys = sorted(counts)
        self.v = np.array([[x // 3**i % 3 for i in range(k)] for x in keys], np.int8).reshape(len(keys), k)
        n = np.array([counts[x] for x in keys], float)
        # Start: labellers are mostly right, and less often when they have to find what is bad.
        self.on_good, self.on_bad, self.share = np.full(k, 0.95), np.full(k, 0.5), 0.8
        for _ in range(steps if len(keys) else 0):
            post = self._posterior(self.v)
            g, b = (n * post)[:, None], (n * (1 - post))[:, None]
            good, bad = self.v == 1, self.v == 2
            old = np.concatenate([self.on_good, self.on_bad])
            self.on_good = np.clip(((g * good).sum(axis=0) + 19) / ((g * (good | bad)).sum(axis=0) + 20), 0.5, 0.9999)
            self.on_bad = np.clip(((b * bad).sum(axis=0) + 1) / ((b * (good | bad)).sum(axis=0) + 2), 0.02, 0.9999)
            self.share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
            if np.abs(np.concatenate([self.on_good, self.on_bad]) - old).max() < 1e-7:
                break
        self.of_pattern = dict(zip(keys, self._posterior(self.v).tolist(), strict=True))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that texts with these votes are good."""
        good, bad = v == 1, v == 2
        log = np.log(self.share / (1 - self.share))
        log = log + (good * np.log(self.on_good / (1 - self.on_bad)) + bad * np.log((1 - self.on_good) / self.on_bad)).sum(axis=1)
        return sigmoid(log)

    def posterior(self, code: int) -> float:
        found = self.of_pattern.get(code)
        return found if found is not None else float(self._posterior(np.array([[code // 3**i % 3 for i in range(len(LABELLERS))]]))[0])


@F.arrow_udf(T.IntegerType())
def vote_pattern(texts: pa.Array) -> pa.Array:
    return pa.array([pattern(votes(Profile(t.as_py() or ""))) for t in texts], pa.int32())


@F.arrow_udf(T.StructType().add("pattern", T.IntegerType()).add("x", T.BinaryType()))
def _sampled(texts: pa.Array) -> pa.Array:
    profiles = [Profile(t.as_py() or "") for t in texts]
    return pa.StructArray.from_arrays(
        [pa.array([pattern(votes(p)) for p in profiles], pa.int32()), pa.array([features(p).tobytes() for p in profiles], pa.binary())], names=["pattern", "x"]
    )


class Model:
    def __init__(self, weak: WeakLabels, weights: np.ndarray):
        self.weak, self.weights = weak, weights

    def score(self, p: Profile) -> float:
        return float(sigmoid(features(p) @ self.weights[:-1] + self.weights[-1]))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model of all rows of ``df``: votes of every text, scorer weights from ``sample`` texts at most (about)."""
    text = text_or_empty(text_col)
    counted = df.select(vote_pattern(text).alias("pattern")).groupBy("pattern").count().collect()  # 3**7 rows at most
    counts = {r.pattern: r["count"] for r in counted}
    weak, total = WeakLabels(counts), sum(counts.values())
    if not total:
        return Model(weak, np.zeros(BINS + 1, np.float32))
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))
    drawn = df.where(draw < int(min(1.0, sample / total) * (1 << 30))).select(_sampled(text).alias("s")).select("s.*").toArrow()
    if not drawn.num_rows:
        return Model(weak, np.concatenate([np.zeros(BINS), [np.log(weak.share / (1 - weak.share))]]).astype(np.float32))
    x = np.stack([np.frombuffer(b.as_py(), np.float32) for b in drawn["x"]])
    y = np.array([weak.posterior(k) for k in drawn["pattern"].to_pylist()], np.float32)
    return Model(weak, fit_descent(x, y))


def scorer(spark, model: Model):
    """Function of a text column that gives ``struct<posterior, score>``: of its votes, and of the hashed scorer."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("posterior double, score double")
    def score(texts: pa.Array) -> pa.Array:
        m, post, values = shared.value, [], []
        for t in texts:
            p = Profile(t.as_py() or "")
            post.append(m.weak.posterior(pattern(votes(p))))
            values.append(m.score(p))
        return pa.StructArray.from_arrays([pa.array(post, pa.float64()), pa.array(values, pa.float64())], names=["posterior", "score"])

    return score


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, posterior, score, kept)`` of every row."""
    score = scorer(df.sparkSession, fit(df, id_col, text_col))
    found = df.select(F.col(id_col), score(text_or_empty(text_col)).alias("s"))
    return found.select(F.col(id_col), "s.posterior", "s.score", (F.col("s.score") >= threshold).alias("kept"))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    score = scorer(df.sparkSession, fit(df, id_col, text_col))
    return df.where(score(text_or_empty(text_col))["score"] >= threshold)
