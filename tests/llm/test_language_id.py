import zlib

from cellspan.llm import language_id


def test_held_out_accuracy(docs, doc_rows):
    found = language_id.identify(docs).collect()
    assert len(found) == len(doc_rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == doc_rows[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(edge, empty):
    found = language_id.identify(edge).collect()
    assert len(found) == edge.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    for i in (1, 2, 8, 9):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "fr", "und") for r in found)
    assert language_id.identify(empty).count() == 0


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(df).collect()] == ["und"]


def test_batches_score_as_single_texts(docs):
    model = language_id.fit(docs, per_language=20)
    texts = [language_id.clean(r.text) for r in docs.limit(20).collect()] + ["", " a ", " ab "]
    names, values = model.predict_batch(texts)
    for text, name, value in zip(texts, names, values):
        alone = model.predict_batch([text])
        assert alone[0][0] == name and abs(alone[1][0] - value) < 1e-6
    whole = model.scores(texts[0])
    model.chunk = 100
    parts = model.scores(texts[0])
    assert whole[1] == parts[1] and abs(whole[0] - parts[0]).max() < 1e-3


def _plain_buckets(text, buckets=language_id.BUCKETS):
    """Buckets of all n-grams of a cleaned text, with Python's integers."""
    found, wrap = [], (1 << 64) - 1
    for n in language_id.ORDERS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) & wrap
            h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 + n - 1) & wrap
            found.append(h >> (64 - (buckets.bit_length() - 1)))
    return found


def test_matches_a_plain_naive_bayes(spark):
    import math

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.collect()
    counts, texts_of = {}, {}
    for r in rows:
        import zlib

        if r.lang is None or r.text is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            continue
        texts_of[r.lang] = texts_of.get(r.lang, 0) + 1
        mine = counts.setdefault(r.lang, {})
        for b in _plain_buckets(language_id.clean(r.text)):
            mine[b] = mine.get(b, 0) + 1
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    total = sum(texts_of.values())
    for r in rows[:60]:
        text = language_id.clean(r.text)
        if not text:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        grams = _plain_buckets(text)
        logs = {}
        for lang, mine in counts.items():
            whole = sum(mine.values()) + 0.5 * language_id.BUCKETS
            log = sum(math.log((mine.get(b, 0) + 0.5) / whole) for b in grams)
            logs[lang] = log * min(1.0, language_id.SCALE / len(grams)) + math.log(texts_of[lang] / total)
        best = max(sorted(logs), key=logs.get)
        assert found[r.doc_id].lang_pred == best
        assert abs(found[r.doc_id].score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-3
