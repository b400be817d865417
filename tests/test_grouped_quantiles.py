"""Quantiles of many groups, columns and places in shared passes, against numpy and DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.functions import quantiles
from hourgrid.functions.quantiles import exact_quantiles, grouped_medians, grouped_quantiles
from hourgrid.operators import delays


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows are of one group; a column is continuous, one has few values, one is mostly null."""
    rng = np.random.default_rng(11)
    n = 12_000
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    x, y = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    rows = [(None if i % 400 == 7 else str(g), float(a), float(b), float(a) if i % 50 == 0 else None) for i, (g, a, b) in enumerate(zip(group, x, y))]
    rows += [("empty", None, None, None), ("one", 3.5, 1.0, None)]
    return spark.createDataFrame(rows, "entity string, x double, y double, z double").repartition(6).cache()


@pytest.mark.parametrize("one_task", [40, 700, 100_000])
def test_medians_equal_duckdb(spark, skewed, one_task):
    rows = skewed.toArrow()  # noqa: F841
    want = duckdb.sql("SELECT entity, median(x), median(y), median(z) FROM rows GROUP BY entity").fetchall()
    got = grouped_medians(skewed, ["entity"], {c: F.col(c) for c in "xyz"}, one_task)
    assert got.columns == ["entity", "x", "y", "z"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    whole = duckdb.sql("SELECT median(x), median(y), median(z) FROM rows").fetchall()[0]
    assert tuple(grouped_medians(skewed, [], {c: F.col(c) for c in "xyz"}, one_task).first()) == whole


def test_many_places_of_groups(spark, skewed):
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = {(r.entity, r.column, r.p): r.value for r in grouped_quantiles(skewed, ["entity"], {"x": F.col("x"), "twice": F.col("y") * 2}, probs, one_task=100).collect()}
    table = skewed.toPandas()
    for e in ("hot", "a", "one"):
        own = table[table.entity == e]
        for name, v in (("x", own.x), ("twice", own.y * 2)):
            assert [got[e, name, p] for p in probs] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)
    assert not [k for k in got if k[0] == "empty"]


def test_no_task_orders_more_than_its_bound(spark, skewed, monkeypatch):
    """Cells that are sorted in the end, and how many jobs it took to cut them."""
    seen = []
    real = quantiles._refined

    def refined(part, want, big):
        part, want = real(part, want, big)
        seen.append(part.groupBy("k", "c", "b").count().agg(F.max("count")).first()[0])
        return part, want

    monkeypatch.setattr(quantiles, "_refined", refined)
    grouped_medians(skewed, ["entity"], {"x": F.col("x")}, 60).collect()
    assert seen[-1] <= 60 < skewed.filter("entity = 'hot'").count() and len(seen) <= 3


def test_passes_do_not_depend_on_the_number_of_places(spark, skewed, monkeypatch):
    passes, real = [], quantiles._refined
    monkeypatch.setattr(quantiles, "_refined", lambda *a: passes.append(1) or real(*a))
    counts = []
    for probs in ([0.5], [i / 12 for i in range(1, 12)]):
        passes.clear()
        got = exact_quantiles(skewed, F.col("x"), probs, one_task=500)
        counts.append(len(passes))
        assert got == pytest.approx(np.quantile(skewed.toPandas().x.dropna(), probs).tolist(), rel=1e-12)
    assert counts[0] == counts[1] == 1


def test_profiles(spark, skewed):
    exact = {r.entity: r for r in delays.entity_profiles(skewed, ["x", "y"]).collect()}
    near = {r.entity: r for r in delays.entity_profiles(skewed, ["x", "y"], approx=True).collect()}
    assert exact.keys() == near.keys() and exact["empty"].x is None
    assert all(math.isclose(exact[e].x, near[e].x, abs_tol=0.05) for e in ("hot", "a", "b", "c"))
    for approx in (False, True):
        row = delays.reference_profile(skewed, ["x", "y", "z"], {"y": 8}, approx).first()
        assert row.y == 8.0 and row.__fields__ == ["x", "y", "z"] and row.x is not None
    none = delays.reference_profile(skewed.limit(0), ["x", "y"], {"y": 1}).first()
    assert tuple(none) == (None, 1.0) and delays.entity_profiles(skewed.limit(0), ["x"]).count() == 0
