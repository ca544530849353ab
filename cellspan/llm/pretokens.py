"""Pre-tokens of byte-level BPE vocabularies, and caches of their encodings inside Python workers."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import regex

from cellspan.llm.common import vocabulary_path

# Character classes of the code points below 256, for texts that stay below it.
LATIN_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACE = "\t-\r \x85\xa0"


@lru_cache(1)
def _general() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(1)
def _latin() -> re.Pattern:
    letter, number, space = LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE
    return re.compile(
        f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def split(text: str) -> list[str]:
    """All matches of the public pattern, in order; they cover the text.

    Texts whose code points are all below 256 take the standard ``re`` with the classes written out,
    which is about twice as fast and gives the same matches.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _general().findall(text)
    return _latin().findall(text)


@lru_cache(2)
def rank_encoder(path: str | None = None):
    """tiktoken encoder of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def token_bytes(path: str | None = None) -> dict[int, bytes]:
    """Token-byte table of a rank file: id to the bytes that the token stands for."""
    with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


@lru_cache(2)
def json_tokenizer(path: str | None = None):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary_path("byte_bpe_50k.json"))


@lru_cache(2)
def special_pattern(path: str | None = None) -> tuple[re.Pattern, dict[str, int]] | None:
    """Pattern of the strings that the tokenizer takes as special tokens inside texts, and their ids."""
    tokenizer = json_tokenizer(path)
    if tokenizer.encode_special_tokens:
        return None
    found = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    if not found:
        return None
    longest_first = sorted(found, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")"), found


def _byte_of_character() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def word_encoder(path: str | None = None):
    """Function that gives a pre-token's ids as the library for the ``.json`` vocabulary does, as a list.

    If the file is a plain byte-level BPE whose merges stand in the order of the ids that they make, merging by rank gives the same ids
    as the list of merges, and tiktoken's merge loop is several times as fast as a call of the library for each word; the
    tests compare both.  Otherwise the library encodes the word.
    """
    import json

    import tiktoken

    tokenizer = json_tokenizer(path)
    with open(path or vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec["normalizer"] is None
    if plain and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("unk_token") and made == sorted(set(made)) and made[0] >= 0:
        byte = _byte_of_character()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        core = tiktoken.Encoding("json", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda word: core.encode_single_piece(word.encode("utf-8", "surrogatepass"))
    return lambda word: tokenizer.encode(word, add_special_tokens=False).ids


class WordCache(dict):
    """Pre-token to encoding, bounded, in two generations; only speed depends on what it holds.

    A word that is missing here comes from the old generation or from ``encode``.  When this generation is full it becomes the old one,
    and what the old one held and nobody asked for since is gone; so frequent words stay.
    """

    def __init__(self, encode, limit: int = 250_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


class Frequent(dict):
    """A fixed table of frequent pre-tokens' encodings; what it lacks is looked up in ``rest`` and never enters it."""

    def __init__(self, table: dict, rest: WordCache):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, word: str):
        return self.rest[word]

    def __setitem__(self, word: str, value) -> None:
        raise TypeError("the table is fixed")


def segments(text: str, path: str | None = None):
    """(is_special, string) parts of a text, cut at special strings as the tokenizer does."""
    found = special_pattern(path)
    if found is None or not any(s in text for s in found[1]):
        return [(False, text)]
    return [(i % 2 == 1, part) for i, part in enumerate(found[0].split(text)) if part]
