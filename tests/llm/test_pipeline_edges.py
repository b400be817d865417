"""Odd rows through every stage of the pipeline, and tables that are empty."""

import pytest

import corpus_pipeline
from tests.llm.test_pairs_and_lines import DOCS, EDGE

WORDS = "ordinary words make up a text that a reader would go on to read without any wish to stop and that says a thing or two about rivers hills and towns".split()


def prose(i, n=60):
    return " ".join(WORDS[(i * 7 + k * (1 + i % 5)) % len(WORDS)] + (str(i * k) if k % 9 == 0 else "") for k in range(n)) + f"\nSecond line of {i}."


def folder(spark, tmp_path, docs, labels, benchmark):
    path = str(tmp_path)
    rows = spark.createDataFrame(docs, DOCS)
    # Extra columns with names that operators use for their own results.
    rows.selectExpr("*", "'mine' AS size", "1 AS n_lines", "true AS selected", "'x' AS contaminated", "2 AS __mine").drop("__mine").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    docs = EDGE + [(100 + i, prose(i), "en", "ab"[i % 2], 1) for i in range(80)] + [(300, prose(1), "en", "a", 1), (301, "x " * 60_000 + prose(2), "en", "b", 1)]
    labels = [(100 + i, int(i < 60), 0) for i in range(80)] + [(None, 1, 0), (4, None, None), (2, 0, 1)]
    leaked = " ".join(prose(5).split()[10:30])
    path = folder(spark, tmp_path_factory.mktemp("p"), [*docs, (302, f"{prose(70)} {leaked}", "en", "a", 1)], labels, [("one", leaked), (None, None), ("none", "")])
    return path, corpus_pipeline.run(spark, path).collect()


def test_every_stage_takes_odd_rows(spark, result):
    path, rows = result
    docs = spark.read.parquet(f"{path}/documents.parquet")
    given = {(r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()}
    assert rows and {(r.doc_id, r.source) for r in rows} <= given
    assert [c for c in docs.columns if c != "size"] == [c for c in rows[0].__fields__ if c not in ("size", "target", "times", "taken")]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert max(map(len, by_id.values())) == 1  # repeated rows are one document
    assert len({r.text for r in rows if not (r.text or "").strip()}) <= 1  # empty and null texts are copies of each other
    assert 105 not in by_id and 302 not in by_id  # they hold a benchmark item
    assert not {101, 300} <= by_id.keys()  # one of two equal texts
    assert all(r.taken == r.size * r.times and 0 <= r.times <= 2 for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_by_themselves(spark, result, stage):
    """Each stage on the odd rows alone, and on no rows."""
    path, _ = result
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id is null or doc_id < 100")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, path)
    assert set(docs.columns) <= set(out.columns) and out.count() <= docs.count() == len(EDGE)
    assert run(spark, docs.limit(0), path).count() == 0


def test_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
