"""Rare toxic words, and words whose hashes share their low bits."""

import random

import xxhash

from hourgrid.llm import toxicity

from .test_models_and_media import crc, prose


def corpus(spark, rng, n, words, each=1):
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(20, 120)).split()
        for _ in range(each if i % 6 == 0 else 0):
            text.insert(rng.randrange(len(text)), rng.choice(words))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(n) if i % 5 < 4], "doc_id long, toxic int")


def low_bits(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42) & (1 << 18) - 1


def test_words_of_one_bucket_are_told_apart(spark):
    clean = next(w for w in (f"clean{i}" for i in range(5_000_000)) if low_bits(w) == low_bits("vile"))
    docs, labels = corpus(spark, random.Random(10), 1200, ["vile"], 3)
    model = toxicity.fit_toxicity(docs, labels)
    new = spark.createDataFrame([(1, "word1 vile word2 vile vile"), (2, f"word1 {clean} word2 {clean} {clean}")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(new, model).collect()}
    assert got == {1: 1, 2: 0}


def test_words_in_a_fiftieth_of_toxic_documents(spark):
    docs, labels = corpus(spark, random.Random(11), 6000, [f"slur{i}" for i in range(50)])
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).filter("held_out").collect()
    bad = [r.predicted for r in got if r.doc_id % 6 == 0]
    good = [r.predicted for r in got if r.doc_id % 6]
    assert sum(bad) / len(bad) > 0.9 and sum(good) / len(good) < 0.03
    assert all(crc(r.doc_id) == 0 for r in got)
