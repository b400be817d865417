"""Whole jobs on a small synthetic folder, written and read again."""

import pytest
from pyspark.sql import functions as F

from hourgrid.jobs import workloads
from hourgrid.operators import features, incidents, metrics
from hourgrid.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    n = F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "signup", "view", "purchase")])
    events = spark.range(3000).select(
        n.alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (n * 13).cast("int"))).alias("ts"), (n * 7 % 40).alias("user_id"),
        F.element_at(kinds, (n * 11 % 5 + 1).cast("int")).alias("event_type"), (n % 9).cast("double").alias("value"), F.concat(F.lit('{"k": '), (n * 31 % 100).cast("string"), F.lit("}")).alias("props"),
    )
    events.write.parquet(f"{path}/events.parquet")
    return path


def test_build_writes_layers(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    workloads.build(spark, folder, out)
    labels, rows = spark.read.parquet(f"{out}/labels"), spark.read.parquet(f"{out}/features")
    assert labels.count() == rows.count() == labels.select("hour").distinct().count() * 25
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        workloads.build(spark, folder, out)
    direct = workloads.feature_job(tables.updates(spark, folder), tables.schedule(spark, folder), tables.EVENTS)
    cols = ["entity", "hour", "label", "starts_prior_24h", "rate_prior_30d", "hours_since_start", "system_starts_prior_6h", "is_eligible"]
    assert direct.select(cols).exceptAll(rows.select(cols)).count() == 0


def test_chunks_do_not_change_features(spark, folder):
    targets = workloads.label_job(tables.updates(spark, folder), tables.EVENTS).cache()
    cols = ["entity", "hour", "history_hours", "starts_prior_24h", "rate_prior_7d", "rate_prior_30d", "last_start_hour"]
    a, b = (features.entity_history(targets, chunk=c).select(cols) for c in (720, 8760))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        features.entity_history(targets, chunk=100)


def test_one_shuffle_serves_the_timeline(spark, folder):
    """Instance numbers, the planned flag and first starts share the distribution by event."""
    starts = incidents.incident_starts(tables.updates(spark, folder), tables.EVENTS)
    plan = starts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scores_split_by_time(spark, folder):
    scored = workloads.score_job(workloads.feature_job(tables.updates(spark, folder), tables.schedule(spark, folder), tables.EVENTS)).cache()
    edges = {r.split: (r.lo, r.hi) for r in scored.groupBy("split").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).collect()}
    assert edges["train"][1] < edges["val"][0] and edges["val"][1] < edges["test"][0]
    assert metrics.ranking_metrics(scored).first().n_pos > 0
