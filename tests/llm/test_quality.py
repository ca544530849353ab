import numpy as np
import pytest

from cellspan.llm import quality


def test_agrees_with_given_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in quality.classify(df).collect()}
    known = [(r.quality, found[r.doc_id].kept) for r in labels.collect()]
    good = [kept for q, kept in known if q == 1]
    bad = [kept for q, kept in known if q == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)
    assert len(found) == df.count()


def test_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    k, n = len(quality.LABELLERS), 40_000
    good = rng.random(n) < 0.7
    right = np.linspace(0.75, 0.95, k)
    says = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None])
    votes = np.where(rng.random((n, k)) < 0.3, 0, np.where(says, 1, 2))
    codes = (votes * 3 ** np.arange(k)).sum(axis=1)
    counts = dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True))))
    weak = quality.WeakLabels(counts)
    assert abs(weak.share - 0.7) < 0.03
    assert np.abs(weak.on_good - right).max() < 0.05 and np.abs(weak.on_bad - right).max() < 0.06
    post = np.array([weak.posterior(c) for c in codes.tolist()])
    assert ((post > 0.5) == good).mean() > 0.95


def test_votes_on_plain_cases():
    def of(text):
        return dict(zip(quality.LABELLERS, quality.votes(quality.Profile(text))))

    clean = "The quick brown fox jumps over the lazy dog while many other animals watch from afar, and none of them ever makes a sound today; it is a rather calm evening in spring."
    assert 2 not in of(clean).values() and sum(v == 1 for v in of(clean).values()) >= 5
    assert of("word*** other### thing$$$ " * 10)["symbols"] == 2
    assert of("ALL OF THIS IS WRITTEN IN CAPITALS AND GOES ON LIKE THAT FOR LONG")["capitals"] == 2
    assert of("same " * 50)["repeated_words"] == 2 and of("same " * 50)["few_distinct_words"] == 2
    assert of("one | two | three | four | five | six | seven |")["separators"] == 2
    assert set(of("").values()) == {0}


def test_edges(edge, empty, spark):
    found = quality.classify(edge).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found)
    assert quality.classify(empty).count() == 0


def test_long_and_odd_texts_have_profiles():
    for text in ("😀" * 1000, "\n" * 50, "a" * 100_000, "\x00", "é" * 3):
        p = quality.Profile(text)
        assert quality.features(p).shape == (quality.BINS,) and np.isfinite(quality.features(p)).all()


def test_matches_a_plain_expectation_maximisation(docs):
    """EM over single rows with loops, in place of counted vote patterns."""
    import math

    rows = [quality.votes(quality.Profile(r.text or "")) for r in docs.collect()]
    k = len(quality.LABELLERS)
    on_good, on_bad, share = [0.95] * k, [0.5] * k, 0.8
    for _ in range(100):
        post = []
        for v in rows:
            log = math.log(share / (1 - share))
            for i, x in enumerate(v):
                if x == 1:
                    log += math.log(on_good[i] / (1 - on_bad[i]))
                elif x == 2:
                    log += math.log((1 - on_good[i]) / on_bad[i])
            post.append(1 / (1 + math.exp(-max(-40.0, min(40.0, log)))))
        before = on_good + on_bad
        for i in range(k):
            voted = [j for j, v in enumerate(rows) if v[i]]
            good, bad = sum(post[j] for j in voted), sum(1 - post[j] for j in voted)
            on_good[i] = min(0.9999, max(0.5, (sum(post[j] for j in voted if rows[j][i] == 1) + 19) / (good + 20)))
            on_bad[i] = min(0.9999, max(0.02, (sum(1 - post[j] for j in voted if rows[j][i] == 2) + 1) / (bad + 2)))
        share = min(0.99, max(0.01, sum(post) / len(post)))
        if max(abs(a - b) for a, b in zip(before, on_good + on_bad)) < 1e-7:
            break
    counts = {}
    for v in rows:
        counts[quality.pattern(v)] = counts.get(quality.pattern(v), 0) + 1
    weak = quality.WeakLabels(counts)
    assert all(abs(a - b) < 1e-6 for a, b in zip([*weak.on_good, *weak.on_bad, weak.share], [*on_good, *on_bad, share]))


def test_features_and_scores_match_loops(spark, docs):
    import math

    model = quality.fit(docs)
    found = {r.doc_id: r for r in quality.classify(docs).collect()}
    bits = quality.BINS.bit_length() - 1
    for r in docs.collect()[:12]:
        p = quality.Profile(r.text or "")
        runs = [int(c) for i, c in enumerate(p.classes) if i == 0 or c != p.classes[i - 1]]
        x = [0.0] * quality.BINS
        for n in (1, 2, 3):
            for i in range(len(runs) - n + 1):
                h = 0
                for c in runs[i : i + n]:
                    h = (h * 131 + c + 1) % (1 << 64)
                x[((h * 0x9E3779B97F4A7C15 + n) % (1 << 64)) >> (64 - bits)] += 10.0 / (len(runs) - n + 1)
        made = quality.features(p)
        rest = [a - b for a, b in zip(made.tolist(), x)]
        assert all(abs(d - round(d)) < 1e-3 for d in rest) and round(sum(rest)) == 8  # a bin for each statistic
        score = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(made.tolist(), model.weights.tolist())) + float(model.weights[-1]))))
        assert abs(found[r.doc_id].score - score) < 1e-4 and found[r.doc_id].kept == (found[r.doc_id].score >= quality.THRESHOLD)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_agrees_with_labels_that_it_never_sees(spark, sf):
    found = {r.doc_id: r.kept for r in quality.classify(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()}
    known = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()]
    assert sum(k for y, k in known if y) >= 0.995 * sum(y for y, _ in known)
    assert sum(not k for y, k in known if not y) >= 0.95 * sum(not y for y, _ in known)
