import random

import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import bpe
from chartloom.session import table


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_special_strings_spaces_and_numbers(own, public):
    for text in ("x <|endoftext|> y", "  a  b\t\r\n\n c ", "it's we'll I'D 12345 ½ ²", "\x1c \x1f\x85\xa0 z", "é ﬁ 🙂🙂", "�"):
        assert own.encode(text) == public.encode(text, add_special_tokens=False).ids, text


def test_long_words_merge_alike(own, public):
    rng = random.Random(3)
    for n in (129, 1_000, 20_000):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        assert own.encode(word) == public.encode(word, add_special_tokens=False).ids
    raw = bytes(rng.randrange(97, 101) for _ in range(600))
    assert own._scan(raw) == own._heap(raw)


def test_the_documents(spark, sf, public):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (public.encode(r.text, add_special_tokens=False).ids if r.text else [])


def test_null_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a", "z"), (2, "a", "a"), (2, "a", "a")], "k BIGINT, t STRING, ids STRING")
    got = sorted(((r.k or 0), r.ids) for r in bpe.encode(df, "k", "t").collect())
    assert got == [(0, [64]), (1, []), (1, []), (2, [64]), (2, [64])]
    assert bpe.encode(df.limit(0), "k", "t").count() == 0
    counts = bpe.count_tokens(df, "t", "n").orderBy("ids").collect()
    assert [(r.ids, r.n) for r in counts][-3:] == [("x", 0), ("y", 0), ("z", 1)]


def test_known_words_are_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    fresh = bpe.Vocabulary(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    text = "one two three four five six seven one two"
    assert fresh.encode(text) == own.encode(text)
