"""Texts of a megabyte and more beside short ones, with extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from hourgrid.llm.decontam import find_overlaps
from hourgrid.llm.line_dedup import dedup_lines
from hourgrid.llm.mixing import mix_sources
from hourgrid.llm.simhash import near_duplicates
from tests.llm.test_pairs_and_lines import brute_lines

WORDS = [f"w{i * 7919 % 1_000_003}" for i in range(150_000)]
LONG = " ".join(WORDS)
LINED = "\n".join(" ".join(WORDS[i : i + 30]) for i in range(0, len(WORDS), 30)) + "\nshared"
ROWS = [(1, LONG, "a"), (2, LONG.replace("w7919 ", "other ", 1), "a"), (3, LINED, "b"), (4, "x" * 1_500_000, "b"), *[(10 + i, f"short {i}\nshared", "a") for i in range(10)]]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("n_lines", "n_dropped", "n_words", "items", "component_id", "node", "root", "size", "taken", "target")}).repartition(4).cache()


def test_lines(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs).collect()}
    assert got == {i: (n, gone, kept) for i, n, gone, kept in brute_lines([r[:2] for r in ROWS])} and got[3][1] == 1


def test_overlaps(spark, docs):
    items = spark.createDataFrame([("late", " ".join(WORDS[-25:])), ("none", "nothing of the kind in any text of these here at all")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in find_overlaps(docs, items).collect()}
    assert got[1] == got[2] == (150_000, 25, 1) and got[3] == (150_001, 25, 1) and got[4] == (1, 0, 0)


def test_near_copies(docs):
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1 and got[4] == 4 and len(got) == len(ROWS)


def test_mixing(docs):
    got = {r.doc_id: r for r in mix_sources(docs, (3.0, 1.0)).collect()}
    assert got[1].size == 150_000 and got[4].size == 1 and all(r.taken in (0, r.size, 2 * r.size) for r in got.values())
