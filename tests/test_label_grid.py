"""The alert fixture, re-typed as rows, and its golden starts, labels and features."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourgrid.jobs.workloads import feature_job, label_job
from hourgrid.operators import incidents, labels, quality, review, schedules
from hourgrid.policy import TRANSIT
from hourgrid.sources import updates as up

SCOPE = "NYCT Subway"
ROWS = [
    ("1", "1", "0", "2024-01-01T00:00:00.000", SCOPE, "station-notice", "A"),
    ("2", "100", "0", "2024-01-01T01:15:00.000", SCOPE, "delays", "A"),
    ("3", "100", "1", "2024-01-01T01:30:00.000", SCOPE, "part-suspended", "A | C"),
    ("4", "101", "0", "2024-01-01T02:15:00.000", SCOPE, "planned-work | delays", "B"),
    ("5", "102", "0", "2024-01-01T03:15:00.000", SCOPE, "some-delays", "D"),
    ("6", "103", "0", "2024-01-01T04:15:00.000", SCOPE, "severe-delays", "6 | 6X"),
    ("7", "104", "0", "2024-01-01T05:15:00.000", SCOPE, "suspended", "F | FX | SIM7"),
    ("8", "105", "0", "2024-01-01T06:15:00.000", SCOPE, "delays", "SI"),
    ("9", "106", "0", "2024-01-01T07:00:00.000", SCOPE, "delays", "A"),
    ("10", "106", "1", "2024-01-01T07:30:00.000", SCOPE, "delays", "A"),
    ("11", "107", "0", "2024-01-01T08:00:00.000", SCOPE, "boarding-change", "Q"),
    ("12", "108", "0", "2024-01-01T08:15:00.000", SCOPE, "delays", "Q"),
    ("13", "108", "0", "2024-01-01T09:15:00.000", SCOPE, "delays", "Q"),
    ("14", "999", "0", "2024-01-01T10:00:00.000", SCOPE, "station-notice", "A"),
]
STARTS = {("100:1", "A", "01:15"), ("100:1", "C", "01:30"), ("103:1", "6", "04:15"), ("104:1", "F", "05:15"), ("106:1", "A", "07:00"), ("108:1", "Q", "08:15"), ("108:2", "Q", "09:15")}
SCHEDULE = [(1, "A", 4), (1, "C", 3), (2, "A", 5), (4, "5X", 2), (4, "6X", 3), (5, "FX", 4)]


def raw(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "a header", "") for r in rows], ", ".join(f"{c} string" for c in up.RAW))


@pytest.fixture(scope="module")
def typed(spark):
    good, _ = up.parse_updates(raw(spark), SCOPE)
    return good.cache()


@pytest.fixture(scope="module")
def schedule(spark):
    rows = [("2024", "ebrw-j62c", "2024-01-01", str(h), line, str(n)) for h, line, n in SCHEDULE]
    good, _ = up.parse_schedule(spark.createDataFrame(rows, "dataset_year string, dataset_id string, departure_date string, departure_hour string, trip_line string, scheduled_revenue_stop_departures string"), TRANSIT.datasets)
    return good.cache()


@pytest.fixture(scope="module")
def targets(typed):
    return label_job(typed, TRANSIT).cache()


@pytest.fixture(scope="module")
def features(typed, schedule):
    return feature_job(typed, schedule, TRANSIT).cache()


def test_starts(typed):
    got = incidents.incident_starts(typed, TRANSIT).collect()
    assert {(r.instance_id, r.entity, r.start_at.strftime("%H:%M")) for r in got} == STARTS and len(got) == 7


def test_grid_and_labels(targets):
    assert targets.count() == 250 and targets.select("hour").distinct().count() == 10
    positive = {(r.entity, r.hour.hour, r.n_starts) for r in targets.filter("label = 1").collect()}
    assert positive == {("A", 1, 1), ("C", 1, 1), ("6", 4, 1), ("F", 5, 1), ("A", 7, 1), ("Q", 8, 1), ("Q", 9, 1)}


def test_order_of_rows_is_irrelevant(spark, targets):
    good, _ = up.parse_updates(raw(spark, ROWS[::-1]), SCOPE)
    assert label_job(good, TRANSIT).exceptAll(targets).count() == 0


def test_instances_and_unmapped(typed):
    assert incidents.event_instances(typed).select("instance_id").distinct().count() == 12
    tokens = incidents.explode_tokens(typed, "update_id", "affected", upper=True)
    assert {r.token for r in incidents.unmapped_entities(tokens, TRANSIT).collect()} == {"SI", "SIM7"}
    assert quality.duplicate_update_keys(typed).first()[0] == 1
    top = quality.top_tokens(incidents.explode_tokens(typed, "update_id", "status_label"), 1).first()
    assert (top.token, top.n_updates) == ("delays", 7)


def test_features(features):
    rows = {(r.entity, r.hour.hour): r for r in features.collect()}
    assert len(rows) == 250
    a1, a2 = rows["A", 1], rows["A", 2]
    assert (a1.scheduled_departures, a1.starts_prior_1h, a1.system_starts_prior_1h, a1.label, a1.is_eligible) == (4, 0, 0, 1, 1)
    assert (a2.scheduled_departures, a2.starts_prior_1h, a2.system_starts_prior_1h, a2.label, a2.is_eligible) == (5, 1, 2, 0, 1)
    assert (a2.history_hours, a2.rate_prior_7d, a2.hours_since_start) == (2, 0.5, 1.0)
    assert a2.system_rate_prior_7d == pytest.approx(0.04)
    first = rows["Q", 0]
    assert (first.starts_prior_24h, first.rate_prior_7d, first.hours_since_start, first.system_starts_prior_24h) == (0, None, None, 0)
    eligible = [r for r in rows.values() if r.is_eligible]
    assert len(eligible) == 6 and sum(r.label for r in eligible) == 4
    assert sum(1 for r in rows.values() if r.coverage_known and r.service_active == 0 and r.label) == 3


def test_features_look_back_only(typed, schedule, features):
    """Dropping every update from an hour on leaves the features of earlier hours unchanged."""
    cut = datetime(2024, 1, 1, 7)
    keep = typed.filter((F.col("published_at") < F.lit(cut).cast("timestamp_ntz")) | (F.col("update_id") == 14))
    cols = ["entity", "hour", "starts_prior_24h", "rate_prior_7d", "hours_since_start", "system_starts_prior_24h", "history_hours"]
    a = feature_job(keep, schedule, TRANSIT).filter("hour(hour) <= 7").select(cols)
    b = features.filter("hour(hour) <= 7").select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_schedule_fact_folds_aliases(schedule):
    got = {(r.entity, r.hour.hour): r.departures for r in schedules.schedule_fact(schedule, TRANSIT).collect()}
    assert got[("5", 4)] == 2 and got[("6", 4)] == 3 and got[("F", 5)] == 4
    assert schedules.schedule_coverage(schedule).count() == 1 and schedules.unmapped_schedule(schedule, TRANSIT).count() == 0


def test_review_sample(typed):
    timeline, starts = incidents.timeline(typed, TRANSIT), incidents.incident_starts(typed, TRANSIT)
    cands = review.review_candidates(timeline, starts, TRANSIT)
    got = {(r.stratum, r.instance_id, r.entity) for r in cands.collect()}
    assert len(got) == 12
    assert {x[1:] for x in got if x[0] == review.PLANNED} == {("101:1", "B")}
    assert {x[1:] for x in got if x[0] == review.OTHER} == {("1:1", "A"), ("102:1", "D"), ("107:1", "Q"), ("999:1", "A")}
    sample = review.review_sample(cands, 6)
    assert {r.stratum: r.n_rows for r in review.strata_counts(sample).collect()} == {review.POSITIVE: 3, review.PLANNED: 1, review.OTHER: 2}
    with pytest.raises(ValueError):
        review.review_sample(cands, 60)
    with pytest.raises(ValueError):
        review.quotas(0)


def test_quality_checks_pass(typed, targets):
    bad = incidents.unmapped_entities(incidents.explode_tokens(typed, "update_id", "affected", upper=True), TRANSIT)
    summary = quality.quality_summary(incidents.event_instances(typed), incidents.incident_starts(typed, TRANSIT), targets, bad)
    row = summary.first()
    assert (row.n_updates, row.n_events, row.n_instances, row.n_starts, row.n_positive, row.n_unmapped) == (14, 11, 12, 7, 7, 2)
    assert row.prevalence == pytest.approx(0.028)
    quality.assert_quality(quality.quality_checks(summary, targets, TRANSIT))
    with pytest.raises(quality.QualityError):
        quality.assert_quality(quality.quality_checks(summary, targets.limit(10), TRANSIT).withColumn("passed", F.lit(False)))


def test_parse_rejects(spark):
    bad = [
        ("20", "1", "0", "2024-01-01T00:00:00+05:00", SCOPE, "", ""), ("21", "1", "0", "2024-01-01T00:00:00Z", SCOPE, "", ""), ("x", "1", "0", "2024-01-01T00:00:00", SCOPE, "", ""),
        ("22", "1", "-1", "2024-01-01T00:00:00", SCOPE, "", ""), ("23", "1", "0", "soon", SCOPE, "", ""), ("24", "1", "0", "2024-01-01T00:00:00", "bus", "", ""), (None, None, None, None, None, None, None),
    ]
    good, rejects = up.parse_updates(raw(spark, bad), SCOPE, on_error="split")
    assert good.count() == 0
    assert sorted(r.reason for r in rejects.collect()) == ["published_at"] * 3 + ["revision", "scope", "update_id", "update_id"]
    with pytest.raises(up.BadRows):
        up.parse_updates(raw(spark, bad), SCOPE)


def test_blank_and_repeated_tokens(spark):
    df = spark.createDataFrame([(1, " Delays |delays| |\tDELAYS\n"), (2, None), (3, "")], "update_id long, status_label string")
    assert [tuple(r) for r in incidents.explode_tokens(df, "update_id", "status_label").collect()] == [(1, "delays")]


def test_updates_before_a_reset_and_no_coverage(spark):
    rows = [("1", "5", "2", "2024-01-01T00:10:00", SCOPE, "delays", "A"), ("2", "5", "0", "2024-01-01T00:20:00", SCOPE, "delays", "A")]
    good, _ = up.parse_updates(raw(spark, rows), SCOPE)
    assert {r.instance_id for r in incidents.event_instances(good).collect()} == {"5:0", "5:1"}
    with pytest.raises(ValueError):
        labels.hours_covered(good)


def test_policy():
    assert TRANSIT.problems() == [] and len(TRANSIT.canonical) == 25 and "SI" not in TRANSIT.canonical
    assert len(TRANSIT.significant) == 4 and len(TRANSIT.planned) == 7


def test_read_updates_names_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("alert_id,event_id\n1,2\n")
    with pytest.raises(ValueError, match="update_number"):
        up.read_updates(spark, str(tmp_path / "a.csv"))
    head = ",".join(up.RAW)
    (tmp_path / "b.csv").write_text(f'{head}\n1,2,0,2024-01-01T00:00:00,{SCOPE},delays,A,"two\nlines",\n')
    good, _ = up.parse_updates(up.read_updates(spark, str(tmp_path / "b.csv")), SCOPE)
    assert good.first().header == "two\nlines" and good.first().description is None
