"""Toxicity by a classifier chain.

Categories are label columns, predicted one after the other in the order of ``categories`` (``quality`` and then ``toxic``, as the given labels have them; any
further columns can be named).  Each is a linear model over hashed words and word beginnings (present or not) and the probabilities of
the categories before it.  In training these probabilities are out-of-fold predictions (``FOLDS`` folds by a hash of the id), so that a later model
learns how far it can trust an earlier one; what predicts is fitted on all folds.

Beginnings of four to six letters catch the inflected forms of a word.  All hashed features enter every model, and the fit is a logistic regression with a ridge penalty, by L-BFGS.
A feature's value is the strength of its evidence in the training rows (the deviation of its count among positive texts from what chance gives, in standard
deviations), so the penalty holds down chance words, and a word that many toxic texts share costs little; no feature is cut off.

The fit takes at most ``PER_CLASS`` labelled texts of each class of the last category (drawn by a hash of the id; a documented bound), weighted back to
the classes' shares; scoring covers every text, a batch of texts at a time.

Defined results: null and empty texts have no words and get the models' base rates; rows whose last label is null are ignored, an earlier label that is null leaves the row out of
that category's fit alone, and several labels of an id count as positive if any is; null and repeated ids are scored row by row; without labels of both classes
all probabilities are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import text_or_empty
from cellspan.llm.linear import minimise, sigmoid

CATEGORIES = ("quality", "toxic")
FOLDS, PER_CLASS, THRESHOLD = 3, 5_000, 0.5
#: Columns of the hashed feature space, the ridge penalty, and letters of a word's beginnings.
COLUMNS, RIDGE, BEGINNINGS = 1 << 20, 1.0, (4, 5, 6)
#: Features that are scored in one go, and words whose features a worker remembers.
SCORED, REMEMBERED = 1 << 21, 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class _Features(dict):
    """Word to the bytes of the 32-bit hashes of itself and of its beginnings; bounded."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found, h, at = array("I", (crc32(word.encode("utf-8", "surrogatepass")),)), crc32(b"^"), 0
        for k in BEGINNINGS:
            if len(word) <= k:
                break
            h, at = crc32(word[at:k].encode("utf-8", "surrogatepass"), h), k
            found.append(h)
        self[word] = raw = found.tobytes()
        return raw


_features = _Features()


def hashed(words) -> np.ndarray:
    """The columns of some words, each once, ascending."""
    found = np.frombuffer(b"".join(map(_features.__getitem__, words)), np.uint32) & np.uint32(COLUMNS - 1)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


class Chain:
    """For each category the weights of all columns, of the earlier probabilities, and the intercept."""

    def __init__(self, tables: list[np.ndarray], earlier: list[np.ndarray], intercepts: list[float]):
        self.tables, self.earlier, self.intercepts = tables, earlier, intercepts

    def predict(self, texts: list[str], categories: int) -> np.ndarray:
        """Probabilities (texts x categories)."""
        found, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(hashed(words_of(text)))
            size += len(held[-1])
            if size >= SCORED or i + 1 == len(texts):
                found.append(self._scored(held, categories))
                held, size = [], 0
        return np.concatenate(found) if found else np.zeros((0, categories))

    def _scored(self, held: list[np.ndarray], categories: int) -> np.ndarray:
        out = np.zeros((len(held), categories))
        rows, columns = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held)
        for c, (table, before, intercept) in enumerate(zip(self.tables, self.earlier, self.intercepts, strict=True)):
            total = np.bincount(rows, weights=table[columns], minlength=len(held))
            out[:, c] = sigmoid(total + out[:, :c] @ before + intercept)
        return out


class _Rows:
    """Training texts as (row, column) pairs, sorted both ways."""

    def __init__(self, texts: list[np.ndarray]):
        self.n = len(texts)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t in texts])
        self.names, columns = np.unique(flat, return_inverse=True)
        self.columns = columns.astype(np.int32)
        order = np.argsort(self.columns, kind="stable")
        self.by_column = self.rows[order]
        self.starts = np.searchsorted(self.columns[order], np.arange(len(self.names)))
        self.filled, self.firsts = np.unique(self.rows, return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each row the sum of its columns' numbers."""
        out = np.zeros(self.n)
        if len(self.rows):
            out[self.filled] = np.add.reduceat(w[self.columns], self.firsts)
        return out

    def transposed(self, r: np.ndarray) -> np.ndarray:
        """For each column the sum of its rows' numbers."""
        return np.add.reduceat(r[self.by_column], self.starts) if len(self.rows) else np.zeros(0)


def evidence(x: _Rows, y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """How many standard deviations each column's count among the positive training rows is from what chance gives."""
    n, p = float(train.sum()), float(y[train].sum())
    have, positive = x.transposed(train.astype(float)), x.transposed(y * train)
    expected = have * p / n
    return np.abs(positive - expected) / np.sqrt(expected * (1 - p / n) * (1 - have / (n + 1)) + 0.5)


def fit_one(x: _Rows, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the columns, of the earlier probabilities, and the intercept; rows of weight 0 take no part."""
    train, k, e = weight > 0, len(x.names), earlier.shape[1]
    share = float((weight * y).sum() / max(weight.sum(), 1e-9))
    if not 0 < share < 1:
        return np.zeros(k), np.zeros(e), float(np.log(np.clip(share, 0.001, 0.999) / (1 - np.clip(share, 0.001, 0.999))))
    scale = evidence(x, y, train)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(scale * w[:k]) + earlier @ w[k : k + e] + w[-1]
        apart = weight * (sigmoid(z) - y)
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * (w[:-1] @ w[:-1]))
        return value, np.concatenate([scale * x.transposed(apart) + ridge * w[:k], earlier.T @ apart + ridge * w[k : k + e], [apart.sum()]])

    start = np.zeros(k + e + 1)
    start[-1] = np.log(share / (1 - share))
    w = minimise(loss, start)
    return scale * w[:k], w[k : k + e], float(w[-1])


def fit_chain(texts: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> Chain:
    """Chain of the categories in the columns of ``labels`` (NaN: unknown); ``texts`` are hashed word sets."""
    x, chain = _Rows(texts), Chain([], [], [])
    earlier = np.zeros((len(texts), 0))
    for c in range(labels.shape[1]):
        y = np.nan_to_num(labels[:, c])
        known = weight * ~np.isnan(labels[:, c])
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(texts))
            for f in range(FOLDS):
                held = fold == f
                w, v, b = fit_one(x, y, known * ~held, earlier, ridge)
                out[held] = sigmoid(x.times(w) + earlier @ v + b)[held]
        w, v, b = fit_one(x, y, known, earlier, ridge)
        table = np.zeros(COLUMNS, np.float32)
        table[x.names] = w
        chain.tables.append(table), chain.earlier.append(v), chain.intercepts.append(b)
        if c + 1 < labels.shape[1]:
            earlier = np.column_stack([earlier, out])
    return chain


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = CATEGORIES, per_class: int = PER_CLASS
) -> Chain | None:
    """The chain, or None without labels of both classes of the last category."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(categories[-1]).isNotNull())
    known = known.groupBy(F.col(id_col).alias("of")).agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)])
    last = f"y{len(categories) - 1}"
    sizes = {r[last]: r["count"] for r in known.groupBy(last).count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    draw = F.pmod(F.xxhash64("of"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    # About two times per_class rows of a few numbers, so the broadcast is bounded.
    drawn = known.where(draw < F.when(F.col(last) == 1, share[1]).otherwise(share[0]))
    made = (
        df.join(F.broadcast(drawn), F.col(id_col) == F.col("of"))
        .select("of", *[f"y{i}" for i in range(len(categories))], _word_hashes(text_or_empty(text_col)).alias("hashes"))
        .toArrow()
    )
    if not made.num_rows:
        return None
    # In the same order whatever the partitions were.
    made = made.take(sorted(range(made.num_rows), key=list(zip(made["of"].to_pylist(), made["hashes"].to_pylist(), strict=True)).__getitem__))
    texts = [np.frombuffer(b.as_py(), np.uint32) for b in made["hashes"]]
    matrix = np.stack([made[f"y{i}"].cast(pa.float64()).to_numpy() for i in range(len(categories))], axis=1)
    fold = np.array([crc32(str(i).encode()) % FOLDS for i in made["of"].to_pylist()])
    y = matrix[:, -1]
    weight = np.where(y == 1, 1.0, (sizes[0] / sizes[1]) / max((y == 0).sum() / max((y == 1).sum(), 1), 1e-9))
    return fit_chain(texts, matrix, fold, weight)


@F.arrow_udf(T.BinaryType())
def _word_hashes(texts: pa.Array) -> pa.Array:
    return pa.array([hashed(words_of(t.as_py())).tobytes() for t in texts], pa.binary())


def predictor(spark, chain: Chain | None, categories: tuple[str, ...] = CATEGORIES):
    """Function of a text column that gives a struct of the categories' probabilities."""
    shared = spark.sparkContext.broadcast(chain)

    @F.arrow_udf(", ".join(f"p_{c} double" for c in categories))
    def predict(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), len(categories))) if shared.value is None else shared.value.predict(texts.to_pylist(), len(categories))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(categories))], names=[f"p_{c}" for c in categories])

    return predict


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = CATEGORIES,
    threshold: float = THRESHOLD,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """``(id, p_<category>..., toxic)`` of every row; ``toxic`` is whether the last category's probability reaches the threshold."""
    predict = predictor(df.sparkSession, fit(df, labels, id_col, text_col, categories, per_class), categories)
    found = df.select(F.col(id_col), predict(text_or_empty(text_col)).alias("p"))
    return found.select(F.col(id_col), *[F.col(f"p.`p_{c}`") for c in categories], (F.col(f"p.`p_{categories[-1]}`") >= threshold).alias("toxic"))
