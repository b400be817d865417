import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.functions import frames
from hourgrid.functions.sampling import hash_sample
from hourgrid.jobs.queries import BUNDLE
from hourgrid.operators import delays, metrics, models, scoring
from hourgrid.sources import sinks
from hourgrid.sources import updates as up


def scores(spark, rows):
    return spark.createDataFrame([(float(p), int(y)) for p, y in rows], "score double, label int")


def test_average_precision_is_by_steps(spark):
    r = metrics.ranking_metrics(scores(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])).first()
    assert r.average_precision == pytest.approx(0.8333333333) and r.roc_auc == pytest.approx(0.75)


def test_ranking_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    r = metrics.ranking_metrics(scores(spark, rows)).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)


def test_thresholds_confusion_and_histogram(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0.05, 0.29, 0.3, 0.57, 0.58, 1.0, 0.0]), int(rng.random() < 0.4)) for _ in range(300)]
    df = scores(spark, rows)
    f1 = lambda t: (lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if tp else 0.0)(sum(y for p, y in rows if p >= t), sum(1 - y for p, y in rows if p >= t), sum(y for p, y in rows if p < t))
    want = max((f1(i / 100), -i) for i in range(5, 96))
    best = metrics.best_threshold(df).first()
    assert best.threshold == -want[1] / 100 and best.f1 == pytest.approx(want[0])
    c = metrics.confusion_metrics(df, 0.3).first()
    assert c.tp + c.fp + c.fn + c.tn == 300 and c.f1 == pytest.approx(f1(0.3))
    hist = {r.bin: (r.pos, r.neg) for r in metrics.score_histogram(df).collect()}
    edges = np.linspace(0, 1, 1001)
    for y, i in ((1, 0), (0, 1)):
        assert [hist[b][i] for b in range(1000)] == np.histogram([p for p, z in rows if z == y], bins=edges)[0].tolist()
    table = {r.bin: r for r in metrics.threshold_table(metrics.score_histogram(df)).collect()}
    assert table[580].tp == sum(y for p, y in rows if p >= 0.58)


def test_no_predictions_give_zero(spark):
    c = metrics.confusion_metrics(scores(spark, [(0.1, 1), (0.2, 0)]), 0.9).first()
    assert (c.precision, c.recall, c.f1, c.accuracy) == (0.0, 0.0, 0.0, 0.5)
    empty = metrics.ranking_metrics(scores(spark, [])).first()
    assert empty.average_precision == 0.0 and empty.roc_auc is None


def test_calibration_edges_go_down(spark):
    rng = random.Random(7)
    rows = [(rng.choice([i / 20 for i in range(20)]), int(rng.random() < 0.5)) for _ in range(500)]
    p = np.array([x for x, _ in rows])
    edges = np.percentile(p, np.linspace(0, 100, 13))
    want = np.bincount(np.searchsorted(edges[1:-1], p), minlength=12)
    got = {r.bin: r.n_rows for r in metrics.calibration(scores(spark, rows)).collect()}
    assert got == {i: int(n) for i, n in enumerate(want) if n}


def test_nearby_rate_widens(spark):
    hist = metrics.score_histogram(scores(spark, [(0.5, 1)] * 100 + [(0.53, 0)] * 250))
    r = {x.bin: x for x in metrics.nearby_rates(hist).collect()}
    assert (r[500].n_near, r[500].half_width) == (350, 0.03)
    assert r[0].half_width == 0.96


def test_pr_curve_and_thinning(spark):
    curve = metrics.pr_curve(scores(spark, [(i / 1000, i % 3 == 0) for i in range(900)]))
    rows = curve.orderBy("place").collect()
    assert len(rows) == 901 and rows[-1].precision == 1.0 and rows[-1].recall == 0.0 and rows[0].recall == 1.0
    thin = sorted(r.place for r in metrics.thin_curve(curve, 200).collect())
    assert thin == sorted({i * 900 // 199 for i in range(200)})


def test_splits(spark):
    df = spark.range(100).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"), (F.col("id") % 2).cast("int").alias("label"))
    got = {r.split: r.n_rows for r in metrics.split_summary(metrics.chronological_split(df)).collect()}
    q = np.quantile(np.arange(100), [0.7, 0.85])
    assert got == {"train": int((np.arange(100) <= q[0]).sum()), "val": int(((np.arange(100) > q[0]) & (np.arange(100) <= q[1])).sum()), "test": int((np.arange(100) > q[1]).sum())}
    near = metrics.nearest_split(spark.createDataFrame([(i // 3,) for i in range(30)], "m int"), "m")
    assert near.filter("split = 'train'").agg(F.max("m")).first()[0] == sorted(i // 3 for i in range(30))[round(29 * 0.8)]


def test_running_totals_match_a_window(spark):
    df = spark.range(500).select((F.rand(3)).alias("p"), (F.col("id") % 7).alias("v"))
    df = df.cache()
    a = frames.running_totals(df, "p", ["v"], bins=16)
    b = df.withColumn("cum_v", F.sum("v").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    assert a.select("p", "v", "cum_v").exceptAll(b.select("p", "v", "cum_v")).count() == 0


def walk(bundle, row, entity):
    total = bundle["baseline"]
    for tree in bundle["trees"]:
        i = 0
        while tree[i][0] >= 0:
            f, t, left, right, missing = tree[i]
            name = bundle["features"][f]
            v = float(name == f"entity_{entity}") if name.startswith("entity_") else row[name]
            i = (left if missing else right) if v is None else left if v <= t else right
        total += tree[i][1]
    return 1 / (1 + math.exp(-total))


def test_tree_scores(spark):
    rng = random.Random(8)
    names = [n for n in BUNDLE["features"] if not n.startswith("entity_")]
    edge = {"hours_since_start": 12.0, "rate_prior_30d": 0.1, "system_starts_prior_3h": 2.0}
    rows = []
    for i in range(300):
        rows.append((rng.choice(["L3", "L7", "L1"]), i, *[None if rng.random() < 0.2 else edge.get(n, 1.0) if rng.random() < 0.2 else rng.random() * 24 for n in names]))
    df = spark.createDataFrame(rows, "entity string, i int, " + ", ".join(f"{n} double" for n in names))
    got = scoring.score_trees(df, BUNDLE).collect()
    assert max(abs(r.score - walk(BUNDLE, r, r.entity)) for r in got) < 1e-12
    parity = scoring.score_parity(scoring.score_trees(df, BUNDLE), df.withColumn("score", scoring.tree_expression(BUNDLE)), ["i"]).first()
    assert parity.n_rows == 300 and parity.passed
    s = {(r.entity, r.with_profile): r.score for r in scoring.scenario_scores(spark, BUNDLE, ["L1", "L3", "L7"]).collect()}
    assert s["L1", 0] == s["L1", 1] and s["L3", 1] != s["L3", 0]


def test_permutation_importance_finds_the_column_that_matters(spark):
    df = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", (F.col("a") > 0.7).cast("int")).cache()
    got = {r.feature: r.importance for r in models.permutation_importance(df, ["a", "b"], lambda x: x.withColumn("score", F.col("a")), ["id"]).collect()}
    assert got["a"] > 0.3 and abs(got["b"]) < 1e-9


def test_regression_and_design(spark):
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"), F.rand(4).alias("n")).withColumn("t", 2 * F.col("n") + F.when(F.col("c") == "x", 1.0).otherwise(0.0)).cache()
    model = models.fit_linear(df, ["c"], ["n"], "t")
    m = models.regression_metrics(model.transform(df), "t").first()
    assert m.r2 == pytest.approx(1.0) and m.rmse < 1e-6
    assert models.cv_r2(df, ["c"], ["n"], "t", ["id"]).count() == 5
    train, other = models.design_matrix(df, spark.createDataFrame([(1, "new", 0.5, 0.0)], df.schema), categories=["c"], numbers=["n"])
    assert train.first().x.size == 3 and other.first().x.toArray().tolist() == [0.0, 0.0, 0.5]
    assert {r.feature for r in models.top_features(models.coefficients(model, df), "value", 2).collect()} <= {"__scaled_0", "__h_c_x", "__h_c_y"}
    low = delays.clip_quantile(df.select("n"), "n", 0.1, 0.9)
    v = [r.n for r in df.collect()]
    a, b = np.quantile(v, [0.1, 0.9])
    assert low.count() == sum(a <= x <= b for x in v)


def test_classifiers_learn(spark):
    df = spark.range(600).select("id", F.lit("e").alias("entity"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", (F.col("a") > 0.8).cast("int")).cache()
    for fit in (lambda: models.fit_logistic(df, ["entity"], ["a", "b"]), lambda: models.fit_boosted(df, ["entity"], ["a", "b"], rounds=5, depth=3)):
        assert metrics.ranking_metrics(models.classify(fit(), df)).first().roc_auc > 0.95


def test_layers_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "layer")
    sinks.write_layer(df, path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_layer(df, path)
    sinks.write_layer(df, path, replace=True)
    assert spark.read.parquet(path).count() == 3
    sinks.write_review(df.select(F.col("id").cast("string").alias("entity")), str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).columns == ["entity", *sinks.REVIEWER_COLUMNS]


def test_snapshot(spark):
    df = spark.range(1, 11).select(F.col("id"), F.lit("x").alias("t"))
    assert [r.id for r in up.snapshot(df, "id", after=3, cutoff=8, limit=2).collect()] == [4, 5]
    with pytest.raises(up.BadRows):
        up.snapshot(df, "id", after=8, limit=5)
    a = df.agg(*up.fingerprint(df)).first()
    b = df.orderBy(F.desc("id")).agg(*up.fingerprint(df)).first()
    assert a == b


def test_hash_sample_is_the_same_for_any_order(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    want = {r.id for r in df.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).limit(200).collect()}
    assert {r.id for r in hash_sample(df, 200, ["id"]).collect()} == want == {r.id for r in hash_sample(df.orderBy(F.desc("id")).repartition(7), 200, ["id"]).collect()}
    assert hash_sample(df, 50, ["g"]).count() == 50 and hash_sample(df, 9000, ["id"]).count() == 5000 and hash_sample(df.limit(0), 5, ["id"]).count() == 0
