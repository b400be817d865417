"""Least squares from sums against numpy on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.jobs import queries
from hourgrid.operators import linear

NUMBERS = ["a", "b", "same"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(31)
    n = 900
    c, e = rng.choice(["x", "y", "z"], n, p=[0.6, 0.3, 0.1]), rng.choice(["1", "2"], n)
    a, b = rng.normal(50, 9, n), rng.random(n) * 1e-3
    y = 3 + 2 * a - 900 * b + (c == "y") * 5 + rng.normal(size=n)
    split = np.where(np.arange(n) < 700, "train", np.where(np.arange(n) < 880, "test", None))
    c[850] = "new"  # a level that only test rows have
    return [(i, str(c[i]), str(e[i]), float(a[i]), float(b[i]), 7.0, float(y[i]), split[i]) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [*table, (1000, "x", "1", None, 1.0, 7.0, 1.0, "train"), (1001, "x", "1", 1.0, 1.0, 7.0, None, "train")]
    return spark.createDataFrame(rows, "id long, c string, e string, a double, b double, same double, y double, split string").repartition(6).cache()


def design(rows):
    """Levels and standardised numbers of training, centred by an intercept, as a matrix; numpy's least squares."""
    train = [r for r in rows if r[7] == "train"]
    levels = [sorted({r[i] for r in train}) for i in (1, 2)]
    raw = lambda rs: np.array([[*[float(r[1] == v) for v in levels[0]], *[float(r[2] == v) for v in levels[1]], *r[3:6]] for r in rs])
    return raw, train


def brute(rows, fit_on):
    raw, _ = design(rows)
    x, y = raw(fit_on), np.array([r[6] for r in fit_on])
    scale = np.ones(x.shape[1])
    scale[-3:-1] = x[:, -3:-1].std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    beta = np.linalg.lstsq(z, y - y.mean(), rcond=1e-10)[0]
    return lambda rs: y.mean() + ((raw(rs) - x.mean(axis=0)) / scale) @ beta, beta


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_fits_and_folds_equal_numpy(spark, df, table):
    sums = linear.split_sums(df, ["c", "e"], NUMBERS, "y", ["id"])
    assert sums.names() == ["c=x", "c=y", "c=z", "e=1", "e=2", "a", "b", "same"]
    line = linear.solve(sums, list(range(5)))
    train, test = ([r for r in table if r[7] == s] for s in ("train", "test"))
    predict, beta = brute(table, train)
    assert line.slopes * line.scale == pytest.approx(beta, rel=1e-6, abs=1e-6)
    y, p = np.array([r[6] for r in test]), predict(test)
    assert linear.judged(sums, [linear.TEST], line) == pytest.approx((180, r2(y, p), np.sqrt(((y - p) ** 2).mean())), rel=1e-7)
    got = {r.id: r.prediction for r in linear.predicted(df.filter("split = 'test'"), line, sums.levels, NUMBERS).collect()}
    assert [got[r[0]] for r in test] == pytest.approx(p.tolist(), rel=1e-7)
    fold = {r.id: r.f for r in df.filter("split = 'train'").select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f")).collect()}
    for f, value in linear.cross_validated(sums):
        inside, outside = ([r for r in train if (fold[r[0]] == f) == own] for own in (True, False))
        # Levels are those of all training rows.
        assert value == pytest.approx(r2(np.array([r[6] for r in inside]), brute(table, outside)[0](inside)), rel=1e-6)


def test_one_scan_serves_all_folds(spark, df):
    """The sums of all folds and of the test rows come from one aggregate."""
    jobs, levels = spark.sparkContext.statusTracker(), linear.category_levels(df, ["c"])
    took = []
    for folds in (2, 11):
        spark.sparkContext.setJobGroup(f"{folds} folds", "")
        linear.fold_sums(df, levels, ["a"], "y", F.pmod("id", F.lit(folds)))
        took.append(len(jobs.getJobIdsForGroup(f"{folds} folds")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert took[0] == took[1] <= 2


def test_little_to_fit(spark, df, monkeypatch):
    none = linear.split_sums(df.limit(0), ["c"], ["a"], "y", ["id"])
    line = linear.solve(none, list(range(5)))
    assert line.intercept == 0.0 and line.names == ["a"] and np.isnan(linear.judged(none, [linear.TEST], line)[1])
    flat = linear.split_sums(df.withColumn("y", F.lit(4.0)), ["c"], ["a"], "y", ["id"])
    assert linear.solve(flat, [0, 1]).intercept == pytest.approx(4.0) and np.isnan(linear.judged(flat, [0], linear.solve(flat, [1]))[1])
    assert linear.predicted(df.filter("id = 1000"), linear.solve(flat, [0]), flat.levels, ["a"]).first().prediction is None
    monkeypatch.setattr(linear, "MAX_LEVELS", 2)
    with pytest.raises(ValueError, match="more than 2 levels"):
        linear.category_levels(df, ["c", "e"])


def test_queries_share_the_sums(spark, tmp_path):
    """The regression queries on small line items agree with each other and with numpy."""
    rng = np.random.default_rng(8)
    orders = [(i, f"2024-{1 + i % 12:02}-01", f"{i % 3}-P", "OFP"[i % 3]) for i in range(300)]
    items = [(o, k, float(rng.integers(1, 50)), float(rng.random() * 9e4), 1 + int(rng.integers(9)), "ANR"[int(rng.integers(3))], "OF"[int(rng.integers(2))], int(rng.integers(1, 120))) for o in range(300) for k in (1, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey long, d string, o_orderpriority string, o_orderstatus string").withColumn("o_orderdate", F.col("d").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    df = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_suppkey int, l_returnflag string, l_linestatus string, late int")
    df.join(spark.read.parquet(f"{tmp_path}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").withColumn("l_shipdate", F.date_add("o_orderdate", F.col("late"))).drop("o_orderdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = str(tmp_path)
    rows = queries._model_rows(spark, folder).toPandas()
    train, test = rows[rows.split == "train"], rows[rows.split == "test"]
    cats = {c: sorted(train[c].unique()) for c in queries.CATEGORIES}
    x = lambda t: np.column_stack([*[(t[c] == v).astype(float) for c in cats for v in cats[c]], *[t[n].astype(float) for n in queries.NUMBERS], np.ones(len(t))])
    p = x(test) @ np.linalg.lstsq(x(train), train.delay_min, rcond=None)[0]
    m = queries.QUERIES["m20_linear_regression"](spark, folder).first()
    err = test.delay_min - p
    assert (m.r2, m.mae, m.rmse) == pytest.approx((r2(test.delay_min, p), err.abs().mean(), np.sqrt((err**2).mean())), abs=1e-5)
    got = {r.line: (r.n_rows, r.mean_residual) for r in queries.QUERIES["p19_residuals"](spark, folder).collect()}
    assert got.keys() == set(test.line) and all(got[k][0] == len(g) and got[k][1] == pytest.approx(err[g.index].mean(), abs=1e-5) for k, g in test.groupby("line"))
    assert queries.QUERIES["m21_cross_validated_r2"](spark, folder).count() == 5
    top = queries.QUERIES["t3_top_coefficients"](spark, folder).collect()
    assert len(top) == 15 and [abs(r.value) for r in top] == sorted((abs(r.value) for r in top), reverse=True)
