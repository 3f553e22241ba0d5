import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import contamination as C

WORDS = "alpha Beta gamma délta epsilon zeta eta theta iota kappa lambda mu 12 3b".split()


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute(docs, items, n=10):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = [(i, grams(t)) for i, t in items]
    return sorted({(d, i) for d, t in docs for i, g in held if g & grams(t)})


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    return C.shared_passages(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"), **more)


@pytest.mark.parametrize("block_chars", [10**6, 40])
def test_random_texts_against_brute_force(spark, block_chars):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 25)))) for k in range(20)] + [(90, None), (91, ""), (92, "one two")]
    docs = [(None, None), (1, ""), (2, " \n")]
    for k in range(60):
        _, passage = rng.choice(items[:20])
        at = rng.randint(0, 8)
        cut = " ".join(passage.split()[at : at + rng.randint(7, 14)])
        docs.append((10 + k, f"{rng.choice(WORDS)} — {cut.upper().replace(' ', rng.choice([' ', '_', ', ', chr(0x200B), chr(10)]))}! {rng.choice(WORDS)}"))
    got = found(spark, docs, items, block_chars=block_chars)
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == brute(docs, items)


def test_passage_is_mapped_to_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = "Intro: ONE, two three\nfour_five six seven; eight (nine) ten eleven... other"
    ((doc, it, start, end, n),) = found(spark, [(5, text)], [(1, item)]).collect()
    assert (doc, it, n) == (5, 1, 11) and text[start:end].startswith("ONE") and text[start:end].endswith("eleven")


def test_equal_items_repeated_rows_and_long_texts(spark):
    item = " ".join(f"w{k}" for k in range(12))
    long = ("filler words here " * 50_000) + item + (" more" * 1000)
    got = found(spark, [(1, item), (1, item), (2, long)], [(7, item), (8, item)]).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 7), (1, 7), (1, 8), (1, 8), (2, 7), (2, 8)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]).count() == 0 and found(spark, [(1, "a b")], []).count() == 0
