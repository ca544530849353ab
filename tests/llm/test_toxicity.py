from collections import Counter

import numpy as np
import pytest

from cellspan.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_agrees_with_given_labels(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    assert len(found) == df.count()
    known = [(r.toxic, found[r.doc_id].toxic) for r in labels.collect()]
    assert sum(t for y, t in known if y == 0) <= 5
    assert sum(t for y, t in known if y == 1) >= 0.9 * sum(y for y, _ in known)


def planted(n=1200):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (int(rng.integers(5, 400)), 2))]
        y = int(rng.random() < 0.15)
        if y:
            words.insert(len(words) // 2, ["idiot", "trash", "zorgvex", "zorgvalis", "zorgvum"][int(rng.integers(0, 5))])
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.classify(df, seen, categories=("toxic",)).collect()}
    held = [(y, found[i]) for i, y in labels if i % 3 == 0]
    assert sum(t != bool(y) for y, t in held) <= 0.02 * len(held)


def test_chain_feeds_earlier_probabilities():
    rows, labels = planted(600)
    texts = [toxicity.hashed(toxicity.words_of(t)) for _, t in rows]
    y = np.array([v for _, v in labels], float)
    insult = (np.array(["idiot" in t for _, t in rows]) & (y == 1)).astype(float)
    chain = toxicity.fit_chain(texts, np.stack([insult, y], axis=1), np.arange(600) % 5, np.ones(600))
    assert [len(v) for v in chain.earlier] == [0, 1] and len(chain.tables) == 2 and chain.earlier[1][0] > 0
    found = chain.predict(["idiot", "hello there", ""], 2)
    assert found[0, 0] > 0.5 and found[0, 1] > 0.5 and found[1, 1] < 0.1 and found[2, 1] < 0.1


def plain_fit(sets, names, y, weight, earlier, ridge=toxicity.RIDGE):
    """Newton steps on a dense matrix, with the evidence counted by loops."""
    n, train = len(sets), [i for i in range(len(sets)) if weight[i] > 0]
    p, scale = sum(y[i] for i in train), []
    for h in names:
        have = sum(h in sets[i] for i in train)
        positive = sum(h in sets[i] and y[i] for i in train)
        expected = have * p / len(train)
        scale.append(abs(positive - expected) / (expected * (1 - p / len(train)) * (1 - have / (len(train) + 1)) + 0.5) ** 0.5)
    x = np.array([[s if h in sets[i] else 0.0 for h, s in zip(names, scale)] + [e[i] for e in earlier] + [1.0] for i in range(n)])
    w, penalty = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (q - y)) + penalty * w)
    return lambda s, before: 1 / (1 + np.exp(-(sum(w[j] * scale[j] for j, h in enumerate(names) if h in s) + sum(a * b for a, b in zip(w[len(names) :], before)) + w[-1])))


def test_chain_and_folds_match_brute_force(monkeypatch):
    from functools import partial

    monkeypatch.setattr(toxicity, "minimise", partial(toxicity.minimise, near=0.0, steps=3000))
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["apple", "trash", "idiot", "pear", "plum", "fig", "kiwi", "lime"], int(rng.integers(0, 6)))) for _ in range(60)]
    y1 = np.array([float("trash" in t) for t in texts])
    y2 = np.array([float("trash" in t or "idiot" in t) for t in texts])
    for i in (3, 10, 20):
        y1[i], y2[i] = 1 - y1[i], 1 - y2[i]
    unknown = y1.copy()
    unknown[[1, 7]] = np.nan
    weight, fold = np.where(y2 == 1, 1.0, 1.7), np.arange(60) % toxicity.FOLDS
    hashed = [toxicity.hashed(toxicity.words_of(t)) for t in texts]
    chain = toxicity.fit_chain(hashed, np.stack([unknown, y2], axis=1), fold, weight)
    sets, names = [set(h.tolist()) for h in hashed], sorted({int(i) for h in hashed for i in h})
    known = weight * ~np.isnan(unknown)
    out = np.zeros(60)
    for f in range(toxicity.FOLDS):
        first = plain_fit(sets, names, y1, known * (fold != f), [])
        for i in np.flatnonzero(fold == f):
            out[i] = first(sets[i], [])
    first, second = plain_fit(sets, names, y1, known, []), plain_fit(sets, names, y2, weight, [out])
    found = chain.predict(texts, 2)
    for i, s in enumerate(sets):
        p = first(s, [])
        assert abs(found[i, 0] - p) < 2e-3 and abs(found[i, 1] - second(s, [p])) < 2e-3


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_held_out_labels(sf, least):
    """Two thirds of the labels fit, one third is held out; of the toxic texts counted are those with a word that a tenth of the toxic and no clean texts have
    (of the others most hold no word that any other toxic text has)."""
    import pyarrow.parquet as pq

    labels = pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pylist()
    of = dict(zip(*(pq.read_table(f"/root/testdata/{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    texts = [of[r["doc_id"]] or "" for r in labels]
    words = [toxicity.words_of(t) for t in texts]
    y = np.array([[r["quality"], r["toxic"]] for r in labels], float)
    fold, found = np.arange(len(texts)) % 3, np.zeros(len(texts))
    for f in range(3):
        train = np.flatnonzero(fold != f)
        chain = toxicity.fit_chain([toxicity.hashed(words[i]) for i in train], y[train], np.arange(len(train)) % toxicity.FOLDS, np.ones(len(train)))
        held = np.flatnonzero(fold == f)
        found[held] = chain.predict([texts[i] for i in held], 2)[:, 1]
    toxic = found >= toxicity.THRESHOLD
    clean_words = set().union(*(words[i] for i in range(len(texts)) if not y[i, 1]))
    times = Counter(w for i in range(len(texts)) if y[i, 1] for w in words[i] - clean_words)
    telling = np.array([any(times[w] >= 0.1 * y[:, 1].sum() for w in s) for s in words]) & (y[:, 1] == 1)
    print(sf, "toxic", int(y[:, 1].sum()), "found", int(toxic[y[:, 1] == 1].sum()), "telling", int(telling.sum()), "found", int(toxic[telling].sum()), "clean flagged", int(toxic[y[:, 1] == 0].sum()))
    assert toxic[y[:, 1] == 0].mean() <= 0.01 and toxic[telling].mean() >= least


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(2, 1, 1), (2, None, 0), (3, 0, 0), (4, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(edge, labels).collect()
    assert len(found) == edge.count() and all(0 <= r.p_toxic <= 1 for r in found)
    assert toxicity.classify(empty, labels).count() == 0
    none = toxicity.classify(edge, labels.where("toxic = 0")).collect()
    assert not any(r.toxic for r in none) and all(r.p_toxic == 0 for r in none)


def test_the_fit_takes_five_thousand_texts_a_class():
    assert toxicity.PER_CLASS == 5_000


def test_labelled_texts_of_a_small_table_are_found(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r.doc_id: r.toxic for r in toxicity.classify(df, labels).collect()}
    known = [(r.toxic, found[r.doc_id]) for r in labels.collect()]
    assert sum(t for y, t in known if y) >= 0.95 * sum(y for y, _ in known) and not any(t for y, t in known if not y)
