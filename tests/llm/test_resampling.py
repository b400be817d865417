"""Importance resampling: counts, weights and selection recomputed; frequencies follow the weights."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from hourgrid.llm import quality

from .test_models_and_media import crc, prose


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(t.encode(), seed=42) & (1 << 31) - 1 for t in regex.findall(quality.TOKEN, (text or "").lower())]
    return [x % buckets for x in h] + [(a * 1_000_003 + b) % buckets for a, b in zip(h, h[1:])]


def test_counts_weights_and_selection_recomputed(spark):
    rng = random.Random(31)
    rows = [(i, " ".join(w + "%%" for w in prose(rng, 30).split()) if i % 5 == 0 else prose(rng, rng.randint(1, 60)) + " é ß") for i in range(200)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "word1 " * 50_000)]
    labels = [(i, int(i % 5 != 0)) for i in range(150)] + [(None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=500)
    raw = Counter(b for _, t in rows for b in grams(t, 500))
    good = {i for i, y in labels if i is not None and y == 1 and crc(i)}
    target = Counter(b for i, t in rows if i in good for b in grams(t, 500))
    ratio = [math.log((target[b] + 1) / (target.total() + 500)) - math.log((raw[b] + 1) / (raw.total() + 500)) for b in range(500)]
    assert model.ratio == pytest.approx(ratio)
    got = {r.doc_id: r for r in quality.resample(docs, model, temperature=2.0, cap=0.5).collect()}
    want = {i: min(sum(ratio[b] for b in grams(t, 500)) / 2, 0.5) for i, t in rows}
    assert {i: r.log_weight for i, r in got.items()} == pytest.approx(want)
    k = int(sum(math.exp(min(w, 0)) for w in want.values()))
    assert {i for i, r in got.items() if r.selected} == set(sorted(got, key=lambda i: -got[i].noisy_weight)[:k])


def test_selection_follows_the_weights(spark):
    model = quality.QualityModel(np.zeros(1000))
    for text, w in (("alpha", -1.5), ("beta", 0.0)):
        model.ratio[grams(text, 1000)[0]] = w
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "alpha").otherwise("beta").alias("text"))
    for seed in ("x", "y"):
        n = dict(quality.resample(docs, model, k=1000, seed=seed).filter("selected").groupBy("text").count().collect())
        assert n["alpha"] + n["beta"] == 1000
        assert n["alpha"] / n["beta"] == pytest.approx(math.exp(-1.5), rel=0.25)
