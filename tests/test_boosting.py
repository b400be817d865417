"""Histogram boosting against a brute-force search for splits; exported trees against the fitted ones."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.jobs import workloads
from hourgrid.operators import boosting, features, metrics, scoring
from hourgrid.operators.boosting import Settings, best_splits, bin_cuts, fit_histogram, score_boosted

SMALL = Settings(rounds=4, depth=4, max_leaves=9, min_rows=6)


def sample(seed, n=400):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 5, n), rng.random(n) * 100, rng.normal(size=n)]).astype(float)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    gone = (rng.random(n) < 0.25) & (rng.random(n) < np.where(y == 1, 0.9, 0.3))
    x[gone, 0] = np.nan
    x[rng.random(n) < 0.2, 2] = np.nan
    entity = rng.choice(["a", "b", "c"], n)
    return x, y, entity, rng.choice([0.5, 1.0, 2.0], n)


def frame(spark, x, y, entity, w):
    rows = [(*[None if math.isnan(v) else float(v) for v in r], int(t), str(e), float(z), i) for i, (r, t, e, z) in enumerate(zip(x, y, entity, w))]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", label int, entity string, weight double, id int")


NAMES = ["x0", "x1", "x2", "x3", "entity_a", "entity_c"]


def wide(x, entity):
    return np.column_stack([x, entity == "a", entity == "c"]).astype(float)


def brute_split(x, g, h, own, cuts, s):
    """The best split of some rows, over all features, thresholds and directions, from the rows themselves."""
    score = lambda m: g[m].sum() ** 2 / h[m].sum()
    best = None
    for f in range(x.shape[1]):
        gone = own & np.isnan(x[:, f])
        for to_left in (False, True) if gone.any() else (None,):
            for t in [*cuts[f], *([math.inf] if to_left is False else [])]:
                left = own & (x[:, f] <= t) | (gone if to_left else False)
                right = own & ~left
                if min(left.sum(), right.sum()) < s.min_rows or min(h[left].sum(), h[right].sum()) < s.min_hessian:
                    continue
                gain = score(left) + score(right) - score(own)
                if gain > s.min_gain and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, t, left.sum() > right.sum() if to_left is None else to_left, left, right)
    return best


def brute_trees(x, y, w, cuts, s):
    rate = (w * y).sum() / w.sum()
    raw = np.full(len(y), np.log(rate / (1 - rate)))
    trees = []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        root = {"rows": np.ones(len(y), bool), "depth": 0}
        leaves = [root]
        while len(leaves) < s.max_leaves:
            for leaf in leaves:
                if "best" not in leaf:
                    leaf["best"] = brute_split(x, g, h, leaf["rows"], cuts, s) if leaf["depth"] < s.depth else None
            ready = [leaf for leaf in leaves if leaf["best"]]
            if not ready:
                break
            node = max(ready, key=lambda leaf: leaf["best"][0])
            node["kids"] = [{"rows": node["best"][i], "depth": node["depth"] + 1} for i in (4, 5)]
            leaves = [leaf for leaf in leaves if leaf is not node] + node["kids"]
        for leaf in leaves:
            leaf["value"] = -s.rate * g[leaf["rows"]].sum() / h[leaf["rows"]].sum()
            raw[leaf["rows"]] += leaf["value"]
        trees.append(root)
    return trees, 1 / (1 + np.exp(-raw))


def same(tree, i, node):
    f, t, left, right, missing = tree[i]
    if "kids" not in node:
        assert f == -1 and t == pytest.approx(node["value"], rel=1e-9)
        return 1
    assert (f, t, bool(missing)) == (node["best"][1], pytest.approx(node["best"][2]), bool(node["best"][3]))
    return same(tree, left, node["kids"][0]) + same(tree, right, node["kids"][1])


@pytest.mark.parametrize(("seed", "bins"), [(1, 255), (2, 12)])
def test_splits_equal_a_brute_force_search(spark, seed, bins):
    x, y, entity, w = sample(seed)
    df = frame(spark, x, y, entity, w).repartition(5)
    model = fit_histogram(df, NAMES, settings=SMALL, bins=bins, block=64, groups=4)
    trees, scores = brute_trees(wide(x, entity), y, w, model.cuts, SMALL)
    exported = model.bundle()["trees"]
    assert len(exported) == SMALL.rounds and max(same(t, 0, b) for t, b in zip(exported, trees)) <= SMALL.max_leaves
    for scored in (score_boosted(df, model), scoring.score_trees(df, json.loads(json.dumps(model.bundle())))):
        got = {r.id: r.score for r in scored.collect()}
        assert [got[i] for i in range(len(y))] == pytest.approx(scores.tolist(), rel=1e-9)
    # Some split sends missing values left, some right.
    assert {n[4] for t in exported for n in t if n[0] in (0, 2)} == {0, 1}


def test_scores_are_written_in_between(spark, monkeypatch):
    x, y, entity, w = sample(3)
    df = frame(spark, x, y, entity, w)
    settings = Settings(rounds=7, depth=3, min_rows=6)
    whole = fit_histogram(df, NAMES, settings=settings)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    alike(fit_histogram(df, NAMES, settings=settings), whole)
    # Sums of tasks added up two at a time, by groups of features.
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    alike(fit_histogram(df.repartition(9, "id"), NAMES, settings=settings, block=16), whole)


def alike(a, b):
    """The same splits; values of leaves up to the rounding of sums in another order."""
    for t, u in zip(a.bundle()["trees"], b.bundle()["trees"], strict=True):
        assert [n[:1] + n[2:] for n in t] == [n[:1] + n[2:] for n in u]
        assert [n[1] for n in t] == pytest.approx([n[1] for n in u], rel=1e-9)


def test_cuts(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") > 9, F.lit(float("nan"))).otherwise(1.5).alias("one"))
    few, many, none, one = bin_cuts(df, {c: F.col(c) for c in df.columns}, 50)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and none.tolist() == one.tolist() == []
    share = np.diff(np.r_[0, np.searchsorted(np.arange(5000), many, "right"), 5000])
    assert len(many) == 49 and share.max() < 1.3 * 100
    with pytest.raises(ValueError, match="fit a byte"):
        bin_cuts(df, {"few": F.col("few")}, 300)


def test_a_split_of_missing_values_alone():
    """Values all alike, missing ones apart: the last bin keeps all values left."""
    sums = np.zeros((3, 1, 2))
    sums[:, 0, 0], sums[:, 0, 1] = (30.0, 10.0, 40), (-20.0, 8.0, 30)
    gain, at, to_left, left = (v[0] for v in best_splits(sums, SMALL))
    assert (at, to_left, *left) == (0, False, 30.0, 10.0, 40.0) and gain == pytest.approx(90 + 50 - 100 / 18)


def test_little_to_learn_from(spark):
    x, y, entity, w = sample(4, 60)
    df = frame(spark, x, y, entity, w)
    for rows, want in ((df.limit(0), 0.5), (df.withColumn("label", F.lit(1)), 1.0), (df.withColumn("label", F.lit(None).cast("int")), 0.5)):
        model = fit_histogram(rows, NAMES, settings=SMALL)
        assert model.trees == [] and score_boosted(df, model).first().score == pytest.approx(want, abs=1e-6)
    flat = df.withColumns({n: F.lit(1.0) for n in NAMES[:4]}).withColumn("entity", F.lit("b"))
    assert fit_histogram(flat, NAMES, settings=SMALL).trees == []


def test_it_learns_and_leaves_no_tables(spark):
    x, y, entity, w = sample(5, 3000)
    df = frame(spark, x, y, entity, w)
    before = set(boosting.files.names(spark, boosting.shared_folder(spark)))
    model = fit_histogram(df.filter("id % 3 > 0"), NAMES, weight=None, settings=Settings(rounds=25))
    assert set(boosting.files.names(spark, boosting.shared_folder(spark))) == before
    got = metrics.ranking_metrics(score_boosted(df.filter("id % 3 = 0"), model)).first()
    assert got.roc_auc > 0.8 and max(len(t) for t in model.trees) <= 61


def test_a_model_is_exported_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(6)
    cols = [*features.NUMERIC]
    rows = [(f"L{i % 3}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), int(rng.random() < 0.3), ["train", "val", "test"][min(i // 400, 2)], *[None if rng.random() < 0.1 else float(rng.integers(0, 50)) for _ in cols]) for i in range(1200)]
    df = spark.createDataFrame(rows, "entity string, hour timestamp_ntz, label int, split string, " + ", ".join(f"{c} double" for c in cols))
    model = workloads.boosted_job(df, Settings(rounds=6))
    bundle = workloads.export_model(df, f"{tmp_path}/bundle.json", model)
    read = json.loads((tmp_path / "bundle.json").read_text())
    assert read == json.loads(json.dumps(bundle)) and read["entities"] == ["L0", "L1", "L2"] and len(read["trees"]) == 6
    test = df.filter("split = 'test'")
    got = {(r.entity, r.hour): r.score for r in scoring.score_trees(test, read).collect()}
    assert got == pytest.approx({(r.entity, r.hour): r.score for r in score_boosted(test, model).collect()}, abs=1e-12)
    assert sum(read["test_scores"]["positives"]) + sum(read["test_scores"]["negatives"]) == test.count()
    assert read["reference"]["month"] == 6 and 0.05 <= read["threshold"] <= 0.95
    own = [r[4 + cols.index("history_hours")] for r in rows if r[0] == "L1" and r[3] == "train"]
    assert read["profiles"]["L1"]["history_hours"] == np.median([v for v in own if v is not None])
    with pytest.raises(ValueError, match="differ"):
        broken = boosting.Boosted(model.features, model.cuts, model.baseline, model.trees)
        broken.bundle = lambda: model.bundle() | {"baseline": 1.0}
        workloads.export_model(df, f"{tmp_path}/other.json", broken)
    assert not (tmp_path / "other.json").exists()
