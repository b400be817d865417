"""Hot events and saturated scores spread over tasks, equal to plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.functions import frames
from hourgrid.jobs import workloads
from hourgrid.operators import incidents, metrics
from hourgrid.policy import TRANSIT

SCHEMA = "update_id long, event_id long, revision long, published_at string, status_label string, affected string, header string"


@pytest.fixture(scope="module")
def updates(spark):
    """Event 1 has half of all updates, a third of these at one time."""
    rng = random.Random(21)
    labels = ["delays", "planned-work | delays", "suspended", "", "other"]
    rows = []
    for i in range(4000):
        event = 1 if i % 2 else rng.randint(2, 60)
        minute = 500 if event == 1 and rng.random() < 0.33 else rng.randint(0, 1400)
        rows.append((i, event, rng.choice([0, 1, 1, 1, 2, 5]), f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00", rng.choice(labels), rng.choice(["A", "A | C", "6X | 6", "zz"]), "h"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"published_at": F.col("published_at").cast("timestamp_ntz"), "agency": F.lit("a")})
    return df.repartition(5).cache()


def test_hot_events_equal_the_plain_window(updates):
    for run in (incidents.event_instances, lambda u, hot_rows: incidents.timeline(u, TRANSIT, hot_rows)):
        plain, spread = run(updates, hot_rows=1_000_000), run(updates, hot_rows=300)
        assert plain.schema == spread.schema or plain.dtypes == spread.dtypes
        assert plain.exceptAll(spread).count() == 0 and spread.count() == plain.count() == 4000
    assert incidents.hot_events(updates, 4000) is None and incidents.hot_events(updates, 3000) is None
    hot, n = incidents.hot_events(updates, 300)
    assert [r.event_id for r in hot.collect()] == [1] and n == 2000


def test_a_hot_event_is_in_no_task_whole(updates):
    dealt = frames.ranged(updates.filter("event_id = 1"), ["event_id", "published_at", "update_id"], 14)
    sizes = [r["count"] for r in dealt.groupBy("__bin").count().collect()]
    assert len(sizes) == 14 and max(sizes) <= 2 * 2000 / 14  # those at one time are told apart by id


def test_labels_of_hot_events(updates, monkeypatch):
    plain = workloads.label_job(updates, TRANSIT)
    assert plain.filter("label = 1").count() > 0
    monkeypatch.setattr(incidents.timeline, "__defaults__", (300,))
    assert workloads.label_job(updates, TRANSIT).exceptAll(plain).count() == 0


def test_scores_near_zero_spread_over_ranges(spark):
    df = spark.range(30_000).select((F.rand(5) * 1e-6).alias("score"), (F.rand(6) < 0.3).cast("int").alias("label"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g")).cache()
    groups = metrics.score_groups(df)
    sizes = [r["count"] for r in frames.ranged(groups, ["p"], 12).groupBy("__bin").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * 30_000 / 12
    plain = df.withColumn("cum_label", F.sum("label").over(Window.partitionBy("g").orderBy(F.desc("score")))).select("g", "score", "cum_label")
    spread = frames.running_totals(df, "score", ["label"], descending=True, bins=9, within=["g"]).select("g", "score", "cum_label")
    assert plain.exceptAll(spread).count() == 0 == spread.exceptAll(plain).count()


def test_curves_do_not_depend_on_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(min(1.0, rng.random() ** 9), int(rng.random() < 0.4), rng.choice("xy")) for _ in range(3000)]
    df = spark.createDataFrame([(round(p, 5), y, g) for p, y, g in rows], "score double, label int, g string").cache()
    one = metrics.ranking_metrics(df, ("g",)).orderBy("g").collect(), metrics.pr_curve(df).orderBy("place").collect()
    monkeypatch.setattr(frames, "BIN_ROWS", 150)
    many = metrics.ranking_metrics(df, ("g",)).orderBy("g").collect(), metrics.pr_curve(df).orderBy("place").collect()
    assert one[1] == many[1]
    for a, b in zip(one[0], many[0]):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
