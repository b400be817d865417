"""Rows that tie where a source's budget ends, and the default quality weight."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hourgrid.llm.common import blank_words
from hourgrid.llm.mixing import mix_sources, quality_weight

from .test_pairs_and_lines import frame


def test_equal_rows_come_near_the_target(spark):
    rows = [(7, "a b c d e f g h", "en", "x", i) for i in range(1000)] + [(8, "a b c", "en", None, i) for i in range(200)] + [(i, "w " * (i % 9), "en", "y", 0) for i in range(300)]
    weights = spark.createDataFrame([("x", 2.0), (None, 0.1), ("y", 1.0)], "source string, weight double")
    df = frame(spark, rows).repartition(7)
    got = mix_sources(df, weights, share=0.6).collect()
    again = mix_sources(df.repartition(3), weights, share=0.6).collect()
    assert Counter((r.doc_id, r.times) for r in got) == Counter((r.doc_id, r.times) for r in again)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], r[4]) for r in rows)
    for source, size in (("x", 8), (None, 3)):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= size / 2
        assert {r.times for r in own} == {0, 1}


def test_quality_weights(spark):
    texts = [None, "", "word", "some words of usual kind", "same " * 500, "x y z", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA BBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBBB"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.w for r in df.select("i", quality_weight(blank_words(F.col("text")), F.col("text")).alias("w")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        varied = math.log(len(set(w))) / math.log(len(w)) if len(w) > 1 else 1.0
        want = max(varied / (1 + abs(len(t) / len(w) - 6) / 6), 0.1) if w else 0.1
        assert got[i] == pytest.approx(want)
