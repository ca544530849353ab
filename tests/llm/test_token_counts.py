import random

import pytest

from cellspan.llm import pretokens, token_counts


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_counts_match_the_library(table, request):
    df = request.getfixturevalue(table)
    tokenizer = pretokens.json_tokenizer()
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect()
    )
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df).collect())
    assert got == want


def test_empty(empty):
    assert token_counts.count_tokens(empty).count() == 0


def test_small_caches_change_nothing(doc_rows):
    cache = pretokens.Frequent({"the": 1}, pretokens.WordCache(token_counts.length_of(), limit=50))
    tokenizer = pretokens.json_tokenizer()
    for r in list(doc_rows.values())[:40]:
        assert token_counts.count_text(r.text, cache) == len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        assert len(cache.rest) <= 51 and len(cache.rest.old) <= 50 and len(cache) == 1


def test_word_encoder_agrees_with_the_library(doc_rows):
    rng = random.Random(7)
    alphabet = "etaoinshrdlu" * 4 + "ABCXYZ" + "éèñßüöä" + "0123456789" + "'’.,!?*$|<>-_()" + "日本語のабвгд😀\u200b\xa0\u0301"
    words = {w for r in doc_rows.values() for w in pretokens.split(r.text)}
    for _ in range(4000):
        words.update(pretokens.split("".join(rng.choice(alphabet + "  \n\t") for _ in range(rng.randint(1, 60)))))
    words = sorted(words)
    tokenizer, encode = pretokens.json_tokenizer(), pretokens.word_encoder()
    assert list(map(encode, words)) == [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def test_split_covers_and_fast_path_agrees():
    for text in ["it's 5² ½ \xa0\x85  x", "a\x1cb\x1fc", "ÀÉ×÷ª  \n\n y", "I'LL we'll 'sx", "", " ", "日本 a"]:
        assert pretokens.split(text) == pretokens._general().findall(text)
        assert "".join(pretokens.split(text)) == text


def test_the_first_tier_outlives_what_the_cache_forgets():
    from cellspan.llm import pretokens, token_counts

    asked = []
    cache = pretokens.WordCache(lambda w: asked.append(w) or len(w), limit=3)
    table = pretokens.Frequent({"often": 1, "the": 1}, cache)
    text = "often" + "".join(f" w{i} the" for i in range(50))
    words = pretokens.split(text)
    assert sum(map(table.__getitem__, words)) == sum(1 if w in ("often", "the") else len(w) for w in words)
    assert dict(table) == {"often": 1, "the": 1} and len(cache) <= 3 and "often" not in asked
    try:
        table["new"] = 1
        raise AssertionError("the table took a word")
    except TypeError:
        pass
    assert token_counts.count_text(text, table) == sum(map(table.__getitem__, words))
