import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file here")

PARTS = ["abcde", "aaaa", " ", "  \n", "'s", "'re", "'", "123", "é中文字", "!!??", "_-", "ab", "the", "ing", "あ", " ", "​", "😀", "<|endoftext|>"]


def random_text(rng, spaces=True):
    text = "".join(rng.choice(PARTS) if rng.random() < 0.7 else rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 200)))
    return text if spaces else "".join(text.split())


@pytest.mark.parametrize("spaces", [True, False])
def test_joined_halves_equal_the_whole(spaces):
    rng, whole = random.Random(3), T.encoding()
    for leaf in (1, 7, 64):
        encoder = T.Encoder(leaf_bytes=leaf)
        for _ in range(300):
            text = random_text(rng, spaces)
            assert encoder.text(text) == whole.encode_ordinary(text)
            assert whole.decode(encoder.text(text)) == text


def test_long_unsplit_text():
    rng = random.Random(5)
    for text in ("ab" * 200_000, "a" * 100_000, "".join(rng.choice("theinandof") for _ in range(100_000)), "é" * 50_000):
        assert T.Encoder(leaf_bytes=256).text(text) == T.encoding().encode_ordinary(text)


@given(st.lists(st.sampled_from([*PARTS, "ab" * 40, "中" * 30, " " * 70, "1" * 65, "?!" * 40, "'s" + "x" * 70]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_production_sizes(text):
    assert T.Encoder().text(text) == T.encoding().encode_ordinary(text)


def test_rows(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "Hello world", "x" * 3000, *(random_text(rng) * 3 for _ in range(40)), "dup", "dup"]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(500, texts[4], "c"), (500, texts[4], "c"), (None, None, "c")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    for long_chars, leaf, fan in ((10**6, 1000, 16), (50, 16, 16), (40, 12, 3)):
        out = T.encode_texts(df, F.col("doc_id"), F.col("text"), long_chars=long_chars, leaf_chars=leaf, leaf_bytes=32, fan=fan).collect()
        expect = [(i, T.encoding().encode_ordinary(t) if t else []) for i, t, _ in data]
        assert sorted(map(repr, ((r.doc_id, r.ids) for r in out))) == sorted(map(repr, expect))


def test_empty_table(spark):
    assert T.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), F.col("doc_id"), F.col("text")).count() == 0


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = T.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no file")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    rng = random.Random(9)
    for _ in range(100):
        text = random_text(rng)
        assert T.Encoder().text(text) == other.encode(text, add_special_tokens=False).ids
