"""Forests by histograms against a search over the rows of each node."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.jobs import queries
from hourgrid.operators import boosting, forest, models

LEVELS, NUMBERS = {"c": ["x", "y", "z"], "e": ["1", "2"]}, ["a", "b", "few"]
FEATURES = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, None), (3, None), (4, None)]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(7)
    n = 900
    c, e, a, b, few = rng.choice(["x", "y", "z"], n), rng.choice(["1", "2"], n), rng.normal(50, 9, n), rng.random(n), rng.integers(0, 4, n)
    y = 1e4 + 2 * (a > 52) * (c == "y") - 3 * (b > 0.4) + 2 * (few == 2) + (e == "1") + rng.normal(size=n)
    rows = [(i, str(c[i]) if i % 50 else None, str(e[i]), float(a[i]) if i % 40 else None, float(b[i]), int(few[i]), float(y[i]) if i % 60 != 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, c string, e string, a double, b double, few int, y double").repartition(5, "id").cache()


def goes_right(codes, column, cut):
    return codes[column] == cut if column < 2 else codes[column] > cut


def gain(w, y, left, right):
    part = lambda m: (w[m] * y[m]).sum() ** 2 / w[m].sum()
    return part(left) + part(right) - part(left | right) if w[left].sum() and w[right].sum() else -math.inf


def test_splits_and_values_equal_a_search_over_the_rows(spark, df, monkeypatch):
    monkeypatch.setattr(forest, "BLOCKS", 2)
    trees, depth = 6, 4
    got = forest.fit_forest(df, LEVELS, NUMBERS, "y", trees=trees, depth=depth, bins=9, seed=3, block=64)
    cols = [c.alias(f"x{i}") for i, c in enumerate(forest.inputs(LEVELS, NUMBERS))]
    mean = df.agg(F.avg("y")).first()[0]
    blocks = forest._blocks(df.select(*cols, "y").dropna(subset=["y"]), 2, got.cuts, mean, 64).collect()
    assert len(blocks) >= 5 and len({r.id for r in blocks}) == len(blocks)
    codes, y = np.concatenate([np.frombuffer(r.codes, np.uint8).reshape(5, -1) for r in blocks], axis=1), np.concatenate([np.frombuffer(r.y) for r in blocks])
    assert len(y) == df.filter("y is not null").count()
    rng = np.random.default_rng(3)
    drawn = [rng.random((trees << level, len(FEATURES))).argsort(axis=1).reshape(trees, 1 << level, -1) < 3 for level in range(depth)]
    splits, ends = 0, np.zeros(len(y))
    for t in range(trees):
        w = np.concatenate([forest.bag(3, r.id, t, len(r.y) // 8) for r in blocks]).astype(float)
        at = {1: np.ones(len(y), bool)}
        for i in range(1, 2 << depth):
            if i not in at:
                continue
            own = at[i]
            assert got.value[t, i] == pytest.approx(mean + (w * y)[own].sum() / w[own].sum(), abs=1e-8)
            below = got.column[t, i] >= 0 and i < 1 << depth
            if i < 1 << depth:
                level = i.bit_length() - 1
                allowed = [f for f, on in zip(FEATURES, drawn[level][t, i - (1 << level)], strict=True) if on]
                tried = [goes_right(codes, c, k) for c, v in allowed for k in ([v] if v is not None else range(len(got.cuts[c - 2])))]
                best = max(gain(w, y, own & ~r, own & r) for r in tried)
                assert below == (best > 1e-6)
            if below:
                splits += 1
                right = goes_right(codes, got.column[t, i], got.cut[t, i])
                assert got.gain[t, i] == pytest.approx(best, rel=1e-6) == gain(w, y, own & ~right, own & right)
                at |= {2 * i: own & ~right, 2 * i + 1: own & right}
            else:
                ends[own] += got.value[t, i] / trees
    assert splits > 60
    plain = sorted(ends.tolist())
    assert sorted(r.prediction for r in got.transform(df.filter("y is not null")).collect()) == pytest.approx(plain, rel=1e-12)
    shares = got.importances()
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) in ("b", "few")


def test_bootstraps_are_poisson_and_come_again():
    w = np.concatenate([forest.bag(1, b, 5, 65_537) for b in range(20)])
    share = np.bincount(w, minlength=8)[:8] / len(w)
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(8)], abs=2e-3)
    assert w.mean() == pytest.approx(1, abs=4e-3) and w.var() == pytest.approx(1, abs=8e-3)
    assert (forest.bag(1, 3, 5, 1000) == forest.bag(1, 3, 5, 1000)).all() and (forest.bag(1, 3, 6, 1000) != forest.bag(1, 3, 5, 1000)).any()


def test_little_to_learn_from(spark, df):
    none = forest.fit_forest(df.limit(0), LEVELS, NUMBERS, "y", trees=2)
    assert none.transform(df).first().prediction is None
    flat = forest.fit_forest(df.withColumn("y", F.lit(2.5)), LEVELS, NUMBERS, "y", trees=2)
    assert (flat.column == -1).all() and {r.prediction for r in flat.transform(df.withColumn("c", F.lit("new"))).collect()} == {2.5}
    with pytest.raises(ValueError, match="depth"):
        forest.fit_forest(df, LEVELS, NUMBERS, "y", depth=9)


def test_many_levels_and_few_features(spark):
    rows = spark.range(1200).select(F.concat(F.lit("v"), F.col("id") % 300).alias("c"), (F.col("id") % 300 < 3).cast("double").alias("y"))
    got = models.fit_forest(rows, ["c"], [], "y", trees=30)
    by = {r.c: r.prediction for r in got.transform(rows).collect()}
    assert min(by["v0"], by["v1"], by["v2"]) > 2 * max(v for k, v in by.items() if k not in ("v0", "v1", "v2"))


def test_rows_take_as_much_room_for_300_trees_and_are_given_back(spark, df, monkeypatch):
    before, sizes = set(boosting.files.names(spark, boosting.shared_folder(spark))), []
    put = forest._Rows.put

    def watched(self, made):
        put(self, made)
        sizes.append(self.rdd.map(lambda r: len(r[2]) + len(r[3])).sum())

    monkeypatch.setattr(forest._Rows, "put", watched)
    model = models.fit_forest(df.na.fill({"c": "x"}).limit(300).cache(), ["c", "e"], NUMBERS, "y")
    assert len(model.value) == 300 and sizes[0] <= 300 * 16
    assert set(boosting.files.names(spark, boosting.shared_folder(spark))) == before
    assert {r.feature for r in models.coefficients(model, df).collect()} == {"c=x", "c=y", "c=z", "e=1", "e=2", *NUMBERS}


def test_regressions_are_compared_in_one_scan(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 6.0), (None, 1.0)], "y double, p double")
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    test = rows.mapInArrow(once, rows.schema)
    got = models.compare_models({str(n): lambda r, n=n: r.withColumn("prediction", F.col("p") + n) for n in (0, 1)}, test, "y").collect()
    y, p = np.array([1.0, 3, 8]), np.array([2.0, 3, 6])
    for r in got:
        miss = y - p - int(r.model)
        assert (r.r2, r.mae, r.rmse) == pytest.approx((1 - (miss**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(miss).mean(), math.sqrt((miss**2).mean())))
    assert seen.value == 4


def test_the_query_compares_both(spark):
    folder = "/root/testdata/sf0.001"
    linear, trees = queries.QUERIES["m22_forest_against_linear"](spark, folder).collect()
    alone = queries.QUERIES["m20_linear_regression"](spark, folder).first()
    assert (linear.model, trees.model) == ("linear", "forest") and trees.rmse > 0 and trees.mae <= trees.rmse
    assert (linear.r2, linear.mae, linear.rmse) == pytest.approx((alone.r2, alone.mae, alone.rmse), abs=1e-6)
