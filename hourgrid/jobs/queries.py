"""Named queries over the tables of a folder, one or more per operator."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions import columns as col
from hourgrid.functions.storage import materialise, shared_folder
from hourgrid.jobs import workloads as work
from hourgrid.operators import boosting as bo
from hourgrid.operators import delays as de
from hourgrid.operators import features as fe
from hourgrid.operators import forest as fo
from hourgrid.operators import incidents as inc
from hourgrid.operators import labels as lab
from hourgrid.operators import linear as li
from hourgrid.operators import metrics as me
from hourgrid.operators import models as mo
from hourgrid.operators import quality as qu
from hourgrid.operators import review as re_
from hourgrid.operators import schedules as sch
from hourgrid.operators import scoring as sc
from hourgrid.sources import sinks, tables
from hourgrid.sources import updates as up

P = tables.EVENTS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: A small bundle for tree scoring: thresholds that equal data values, and missing values
#: routed either way.
BUNDLE = {
    "features": ["hour_of_day", "is_weekend", "scheduled_departures", "starts_prior_3h", "starts_prior_6h", "rate_prior_7d", "rate_prior_30d", "hours_since_start", "system_starts_prior_3h", "entity_L3", "entity_L7"],
    "baseline": -2.0,
    "trees": [
        [[6, 0.1, 1, 2, 1], [-1, -0.5, 0, 0, 0], [7, 12.0, 3, 4, 0], [-1, 0.75, 0, 0, 0], [-1, 0.25, 0, 0, 0]],
        [[8, 2.0, 1, 2, 0], [0, 6.0, 3, 4, 1], [-1, 0.5, 0, 0, 0], [-1, -0.25, 0, 0, 0], [-1, 0.125, 0, 0, 0]],
        [[7, 24.0, 1, 2, 0], [3, 0.0, 3, 4, 1], [5, 0.05, 5, 6, 1], [-1, 0.0625, 0, 0, 0], [-1, 1.0, 0, 0, 0], [-1, -0.375, 0, 0, 0], [-1, 0.1875, 0, 0, 0]],
        [[9, 0.5, 1, 2, 0], [10, 0.5, 3, 4, 0], [-1, 0.3125, 0, 0, 0], [2, 1.0, 5, 6, 0], [-1, -0.125, 0, 0, 0], [-1, -0.0625, 0, 0, 0], [1, 0.5, 7, 8, 0], [-1, 0.03125, 0, 0, 0], [-1, -0.15625, 0, 0, 0]],
    ],
    "reference": {"hour_of_day": 8, "is_weekend": 0, "scheduled_departures": 1, "starts_prior_3h": 1, "starts_prior_6h": 1, "rate_prior_7d": 0.1, "rate_prior_30d": 0.1, "hours_since_start": 10, "system_starts_prior_3h": 6},
    "profiles": {"L3": {"rate_prior_30d": 0.3, "starts_prior_3h": 2, "hours_since_start": 3.0}, "L7": {"rate_prior_30d": 0.02, "starts_prior_3h": 0, "hours_since_start": None}},
}

NUMBERS = ["number_of_stops", "distance", "scheduled_trains", "avg_scheduled_runtime", "month"]
CATEGORIES = ["line", "direction", "time_period", "schedule_day_type"]
PROFILE = list(work.PROFILE)


def query(f: Query) -> Query:
    """Register a query; dates leave it as ISO strings."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(work.naive_session(spark), sf_dir)
        dates = [c for c, kind in df.dtypes if kind == "date"]
        return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

    QUERIES[f.__name__] = run
    return run


def _targets(s: SparkSession, d: str) -> DataFrame:
    return work.label_job(tables.updates(s, d), P)


def _features(s: SparkSession, d: str) -> DataFrame:
    return work.feature_job(tables.updates(s, d), tables.schedule(s, d), P)


def _scores(s: SparkSession, d: str, split: str | None = None) -> DataFrame:
    df = work.score_job(_features(s, d))
    rows = (df if split is None else df.filter(F.col("split") == split)).select("entity", "hour", "label", "score")
    return materialise(rows)  # four narrow columns, read several times by a metric


def _timeline(s: SparkSession, d: str) -> DataFrame:
    return inc.timeline(tables.updates(s, d), P)


def _delays(s: SparkSession, d: str) -> DataFrame:
    return de.clip_quantile(de.delay_rows(tables.running_times(s, d)), "delay_min")


# -- sources ---------------------------------------------------------------------------


@query
def s2_parsed_updates(s, d):
    good, _ = up.parse_updates(tables.raw_updates(s, d), "events", on_error="split")
    return good.select("update_id", "event_id", "revision", "published_at", "agency", "status_label", "affected", "header", "description")


@query
def s2_rejects_by_reason(s, d):
    _, bad = up.parse_updates(tables.raw_updates(s, d), "events", on_error="split")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def s3_parsed_schedule(s, d):
    raw = tables.schedule(s, d).select(F.col("dataset_year").cast("string").alias("dataset_year"), F.when(F.col("service_hour") == 3, "d1999").otherwise(F.col("dataset_id")).alias("dataset_id"), F.date_format("service_date", "yyyy-MM-dd").alias("departure_date"), F.when(F.col("service_hour") == 4, "24").otherwise(F.col("service_hour").cast("string")).alias("departure_hour"), F.concat(F.lit(" "), F.lower("line")).alias("trip_line"), F.col("departures").cast("string").alias("scheduled_revenue_stop_departures"))
    good, bad = up.parse_schedule(raw, P.datasets, on_error="split")
    return good.withColumn("reason", F.lit("")).unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("departures").alias("departures"), F.countDistinct("line").alias("n_lines"))


@query
def s4_duplicate_keys(s, d):
    return up.duplicate_keys(tables.updates(s, d), ["event_id", "revision"])


@query
def s5_snapshot(s, d):
    u = tables.updates(s, d)
    return up.snapshot(u, "update_id", after=100, limit=500, scope=F.col("agency") == "events").select("update_id", "event_id", "published_at")


@query
def s5_continued_snapshot(s, d):
    """A snapshot taken in two increments, the first up to half of the largest id, read back, and its manifest."""
    u, path = tables.updates(s, d), f"{shared_folder(s)}/{uuid.uuid4().hex}"
    half = u.agg(F.max("update_id")).first()[0] // 2
    up.continue_snapshot(u, path, "update_id", cutoff=half)
    manifest = up.continue_snapshot(u, path, "update_id")
    rows = up.read_snapshot(s, path)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max("update_id").alias("cutoff_id"), F.countDistinct("event_id").alias("n_events"), F.lit(manifest["n_rows"]).cast("long").alias("manifest_rows"), F.lit(manifest["parts"]).alias("parts"))


@query
def s6_snapshot_manifest(s, d):
    u = up.snapshot(tables.updates(s, d), "update_id", after=100)
    return up.snapshot_manifest(u, "update_id", "published_at").select("n_rows", "cutoff_id", "max_time", "source_rows", "limited", "columns")


@query
def s6_content_fingerprint(s, d):
    return tables.updates(s, d).agg(*up.fingerprint(tables.updates(s, d)))


@query
def s7_schedule_manifest(s, d):
    return up.schedule_manifest(tables.schedule(s, d))


@query
def s8_schedule_line_hours(s, d):
    return sch.schedule_line_hours(tables.departures(s, d))


@query
def s9_month_slice(s, d):
    return sch.schedule_line_hours(sch.month_slice(tables.departures(s, d), 2024, 1)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("departures").alias("departures"))


@query
def s11_review_sheet(s, d):
    u = tables.updates(s, d)
    return sinks.review_sheet(re_.review_sample(re_.review_candidates(inc.timeline(u, P), inc.incident_starts(u, P), P), 40, strict=False)).select("stratum", "instance_id", "entity", *sinks.REVIEWER_COLUMNS)


@query
def s13_running_times(s, d):
    source = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    tables.running_times(s, d).write.parquet(source)
    return up.read_running_times(s, source).groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def s13_running_time_rows(s, d):
    source = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    tables.running_times(s, d).write.parquet(source)
    return up.read_running_times(s, source).select("l_orderkey", "l_linenumber", "line", F.round("avg_actual_runtime", 6).alias("avg_actual_runtime"))


@query
def s14_model_rows(s, d):
    return fe.model_rows(_features(s, d)).select("entity", "hour", "scheduled_departures", "rate_prior_30d", "hours_since_start", "label")


# -- projections and tokens --------------------------------------------------------------


@query
def p1_normalized_updates(s, d):
    return inc.normalize_updates(tables.updates(s, d)).select("update_id", "agency_normalized", "status_normalized", "affected")


@query
def p2_status_tokens(s, d):
    return inc.explode_tokens(tables.updates(s, d), "update_id", "status_label")


@query
def p3_affected_tokens(s, d):
    return inc.explode_tokens(tables.updates(s, d), "update_id", "affected", upper=True)


@query
def p4_mapped_entities(s, d):
    return inc.map_entities(inc.explode_tokens(tables.updates(s, d), "update_id", "affected", upper=True), P)


@query
def p5_unmapped_entities(s, d):
    return inc.unmapped_entities(inc.explode_tokens(tables.updates(s, d), "update_id", "affected", upper=True), P)


@query
def p7_unmapped_schedule(s, d):
    return sch.unmapped_schedule(tables.schedule(s, d), P).select("service_date", "service_hour", "line", "departures")


@query
def p8_hour_keys(s, d):
    return tables.updates(s, d).groupBy(col.hour_floor(F.col("published_at")).alias("hour")).agg(F.count(F.lit(1)).alias("n_updates"))


@query
def p9_coverage_bounds(s, d):
    return lab.coverage_bounds(tables.updates(s, d))


@query
def p10_calendar(s, d):
    return lab.with_calendar(lab.hours_covered(tables.updates(s, d)))


@query
def p11_date_keys(s, d):
    c = F.col("published_at")
    return tables.updates(s, d).groupBy(F.to_date(c).alias("day"), col.month_key(c).alias("month"), col.date_hour(F.to_date(c), F.hour(c)).alias("hour")).agg(F.count(F.lit(1)).alias("n_updates"))


@query
def p16_stable_ranks(s, d):
    return inc.incident_starts(tables.updates(s, d), P).select("instance_id", "entity", col.stable_rank(F.lit(re_.POSITIVE), F.col("instance_id"), F.col("entity")).alias("order_key"))


@query
def p17_delay_rows(s, d):
    return de.delay_rows(tables.running_times(s, d)).groupBy("line", "year", "month").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("delay_min"), 6).alias("delay_min"))


@query
def p17_delay_of_rows(s, d):
    return de.delay_rows(tables.running_times(s, d)).select("l_orderkey", "l_linenumber", "year", "month", F.round("delay_min", 6).alias("delay_min"))


@query
def p18_clipped_rows(s, d):
    return _delays(s, d).select("l_orderkey", "l_linenumber", F.round("delay_min", 6).alias("delay_min"))


@query
def p18_clipped_delays(s, d):
    return _delays(s, d).groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"))


# -- incidents, labels, schedules, features -----------------------------------------------


@query
def e1_event_instances(s, d):
    return inc.event_instances(tables.updates(s, d)).select("update_id", "event_id", "instance_seq", "instance_id")


@query
def j1_flagged_updates(s, d):
    return inc.flag_updates(tables.updates(s, d), P).select("update_id", "is_planned", "is_significant")


@query
def j2_significant_updates(s, d):
    return inc.flag_updates(tables.updates(s, d), P).filter("is_significant = 1").select("update_id")


@query
def e2_planned_so_far(s, d):
    return _timeline(s, d).select("update_id", "instance_id", "planned_so_far")


@query
def j3_qualifying_updates(s, d):
    return inc.qualifying_updates(_timeline(s, d), P).select("update_id", "instance_id", "entity")


@query
def e3_first_starts(s, d):
    return inc.incident_starts(tables.updates(s, d), P)


@query
def j4_entity_hour_grid(s, d):
    return lab.entity_hour_grid(tables.updates(s, d), P)


@query
def d2_positive_counts(s, d):
    return lab.positive_counts(inc.incident_starts(tables.updates(s, d), P))


@query
def j5_label_grid(s, d):
    return _targets(s, d).select("entity", "hour", "hour_end", "n_starts", "label")


@query
def d3_schedule_fact(s, d):
    return sch.schedule_fact(tables.schedule(s, d), P)


@query
def d4_schedule_coverage(s, d):
    return sch.schedule_coverage(tables.schedule(s, d))


@query
def d5_system_hours(s, d):
    return fe.system_hours(_targets(s, d)).select("hour", "system_starts", "system_rate")


@query
def e4_trailing_sums(s, d):
    return fe.entity_history(_targets(s, d)).select("entity", "hour", *[f"starts_prior_{k}h" for k in fe.SUMS])


@query
def e5_trailing_rates(s, d):
    return fe.entity_history(_targets(s, d)).select("entity", "hour", *[f"rate_prior_{n}" for n in fe.RATES])


@query
def e6_hours_since_start(s, d):
    h = fe.entity_history(_targets(s, d))
    return h.select("entity", "hour", "last_start_hour", col.hours_between(F.col("last_start_hour"), F.col("hour")).alias("hours_since_start"))


@query
def e7_history_length(s, d):
    return fe.entity_history(_targets(s, d)).select("entity", "hour", "history_hours")


@query
def e4_to_e7_in_short_chunks(s, d):
    return fe.entity_history(_targets(s, d), chunk=720).select("entity", "hour", "history_hours", "starts_prior_24h", "rate_prior_30d", "last_start_hour")


@query
def e8_system_history(s, d):
    h = fe.system_history(fe.system_hours(_targets(s, d)))
    return h.withColumn("system_rate_prior_7d", F.round("system_rate_prior_7d", 9))


@query
def j6_features(s, d):
    return _features(s, d).select("entity", "hour", "coverage_known", "service_active", "scheduled_departures", "history_hours", "starts_prior_24h", "rate_prior_7d", "hours_since_start", "system_starts_prior_24h", "label", "n_starts", "is_eligible")


# -- quality -------------------------------------------------------------------------------


def _summary(s, d, targets):
    u = tables.updates(s, d)
    bad = inc.unmapped_entities(inc.explode_tokens(u, "update_id", "affected", upper=True), P)
    return qu.quality_summary(inc.event_instances(u), inc.incident_starts(u, P), targets, bad)


def _feature_summary(s, d, targets=None):
    plan = materialise(tables.schedule(s, d))
    features = work.feature_job(tables.updates(s, d), plan, P, targets)
    return qu.feature_summary(features, plan, sch.schedule_coverage(plan), sch.schedule_fact(plan, P), sch.unmapped_schedule(plan, P))


@query
def d6_quality_summary(s, d):
    return _summary(s, d, materialise(_targets(s, d)))


@query
def d7_duplicate_update_keys(s, d):
    return qu.duplicate_update_keys(tables.updates(s, d))


@query
def d8_prevalence_by_entity(s, d):
    return qu.prevalence_by_entity(_targets(s, d))


@query
def d9_feature_summary(s, d):
    return _feature_summary(s, d)


@query
def d10_quality_checks(s, d):
    targets = materialise(_targets(s, d))
    return qu.quality_checks(_summary(s, d, targets), targets, P, _feature_summary(s, d, targets))


@query
def d11_eligible_prevalence_by_entity(s, d):
    return qu.eligible_prevalence(_features(s, d), "entity")


@query
def d11_eligible_prevalence_by_month(s, d):
    return qu.eligible_prevalence(_features(s, d).withColumn("month_key", col.month_key(F.col("hour"))), "month_key")


@query
def d12_prevalence_by_hour(s, d):
    return qu.prevalence_by_hour(_features(s, d))


@query
def t1_top_tokens(s, d):
    return qu.top_tokens(inc.explode_tokens(tables.updates(s, d), "update_id", "status_label"), 30)


@query
def t2_top_unmapped(s, d):
    return qu.top_tokens(inc.unmapped_entities(inc.explode_tokens(tables.updates(s, d), "update_id", "affected", upper=True), P), 50)


@query
def u2_eligible_entities(s, d):
    return qu.eligible_entities(_features(s, d))


@query
def u3_policy_problems(s, d):
    """Tokens and aliases as the updates use them, checked against the policy's tables."""
    seen = inc.explode_tokens(tables.updates(s, d), "update_id", "affected", upper=True).select("token").distinct()
    aliases = seen.filter(F.col("token").endswith("X") | (F.col("token") == "ZZ")).select(F.col("token").alias("alias"), F.regexp_replace("token", "X$", "").alias("target"))
    return qu.check_policy(P.status_table(s), aliases, P.entity_table(s))


# -- review ---------------------------------------------------------------------------------


def _candidates(s, d):
    u = tables.updates(s, d)
    return re_.review_candidates(inc.timeline(u, P), inc.incident_starts(u, P), P)


@query
def d16_event_flags(s, d):
    return re_.event_flags(_timeline(s, d), P).select("instance_id", "any_planned", "any_significant")


@query
def j7_review_candidates(s, d):
    return _candidates(s, d)


@query
def e10_review_sample(s, d):
    return re_.review_sample(_candidates(s, d), 40, strict=False).select("stratum", "assigned_label", "instance_id", "entity", "hour", "order_key")


@query
def d17_strata_counts(s, d):
    return re_.strata_counts(re_.review_sample(_candidates(s, d), 40, strict=False))


# -- evaluation --------------------------------------------------------------------------------


@query
def m1_chronological_split(s, d):
    return work.score_job(_features(s, d)).select("entity", "hour", "split")


@query
def d13_split_summary(s, d):
    return me.split_summary(work.score_job(_features(s, d)))


@query
def m5_baseline_scores(s, d):
    return _scores(s, d, "test")


@query
def m8_best_threshold(s, d):
    return me.best_threshold(_scores(s, d, "val")).select("threshold", F.round("f1", 9).alias("f1"))


@query
def m8_threshold_scan(s, d):
    return me.threshold_scan(_scores(s, d, "val")).select("threshold", F.round("f1", 9).alias("f1"))


@query
def m9_confusion_metrics(s, d):
    m = me.confusion_metrics(_scores(s, d, "test"), 0.15)
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def m10_ranking_metrics(s, d):
    m = me.ranking_metrics(_scores(s, d, "test"))
    return m.select(F.round("average_precision", 9).alias("average_precision"), F.round("roc_auc", 9).alias("roc_auc"), "n_pos", "n_neg")


@query
def m11_pr_curve(s, d):
    return me.pr_curve(_scores(s, d, "test"))


@query
def t4_thin_curve(s, d):
    return me.thin_curve(me.pr_curve(_scores(s, d, "test")), 20)


@query
def m12_calibration(s, d):
    return me.calibration(_scores(s, d, "test")).withColumns({"mean_score": F.round("mean_score", 9), "observed_rate": F.round("observed_rate", 9)})


@query
def m13_score_histogram(s, d):
    return me.score_histogram(_scores(s, d))


@query
def m14_threshold_table(s, d):
    t = me.threshold_table(me.score_histogram(_scores(s, d)))
    return t.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "lift")})


@query
def m15_nearby_rates(s, d):
    return me.nearby_rates(me.score_histogram(_scores(s, d, "test")))


@query
def m15_nearby_rate_of_scores(s, d):
    hist = me.score_histogram(_scores(s, d, "test"))
    return me.nearby_rate(hist, _scores(s, d, "val")).select("entity", "hour", "score", "n_near", "rate")


@query
def d14_reference_profile(s, d):
    train = work.score_job(_features(s, d)).filter("split = 'train'")
    return de.reference_profile(train, ["month", "weekday", "hour_of_day", "is_weekend", *PROFILE], work.PINNED)


@query
def d15_entity_profiles(s, d):
    return de.entity_profiles(work.score_job(_features(s, d)).filter("split = 'train'"), PROFILE)


@query
def m17_tree_scores(s, d):
    return sc.score_trees(_features(s, d), BUNDLE).select("entity", "hour", F.round("score", 9).alias("score"))


@query
def m18_score_parity(s, d):
    f = _features(s, d)
    keys = ["entity", "hour"]
    parity = sc.score_parity(sc.score_trees(f, BUNDLE).select(*keys, "score"), f.select(*keys, sc.tree_expression(BUNDLE).alias("score")), keys)
    return parity.select("n_rows", "passed")


@query
def m19_scenario_scores(s, d):
    """Scenarios of the entities that the features hold, by profiles from their training rows."""
    train = work.score_job(_features(s, d)).filter("split = 'train'")
    names = [n for n in BUNDLE["features"] if not n.startswith("entity_")]
    rows = de.entity_profiles(train, [n for n in names if n in PROFILE]).orderBy("entity").collect()  # one row per entity of the policy
    bundle = BUNDLE | {"profiles": {r["entity"]: {k: v for k, v in r.asDict().items() if k != "entity"} for r in rows}}
    return sc.scenario_scores(s, bundle, [r["entity"] for r in rows]).withColumn("score", F.round("score", 9))


@query
def m16_permutation_importance(s, d):
    df = _features(s, d).filter("is_eligible = 1")
    cols = [n for n in BUNDLE["features"] if not n.startswith("entity_")]
    return mo.top_features(mo.permutation_importance(df.select("entity", "hour", "label", *cols), cols, lambda x: sc.score_trees(x, BUNDLE), ["entity", "hour"]), "importance")


# -- models -------------------------------------------------------------------------------------


def _fitted(s, d, fit):
    df = work.score_job(_features(s, d)).drop("score")
    model = fit(df.filter("split = 'train'"), ["entity"], list(fe.NUMERIC))
    return me.ranking_metrics(mo.classify(model, df.filter("split = 'test'")))


@query
def m6_logistic_test_metrics(s, d):
    return _fitted(s, d, mo.fit_logistic)


@query
def m7_boosted_test_metrics(s, d):
    """Trees by histograms: 300 rounds, depth 6, 31 leaves, rate 0.05, balanced classes."""
    rows = work.score_job(_features(s, d)).drop("score")
    return me.ranking_metrics(bo.score_boosted(rows.filter("split = 'test'"), work.boosted_job(rows)))


@query
def m18_fitted_parity(s, d):
    """A model fitted on rows with missing values, against its trees written as JSON and read again."""
    rows = materialise(me.chronological_split(_features(s, d).filter("is_eligible = 1")))
    model = work.boosted_job(rows)
    parity = work.exported_parity(rows.filter("split = 'test'"), model, json.loads(json.dumps(model.bundle())), ["entity", "hour"])
    return parity.select("n_rows", "passed")


@query
def d18_mean_delay(s, d):
    return de.mean_delay(_delays(s, d)).withColumn("mean_delay", F.round("mean_delay", 9))


@query
def d19_describe_target(s, d):
    t = de.describe_target(_delays(s, d))
    return t.select("n_rows", *[F.round(c, 7).alias(c) for c in t.columns if c != "n_rows"])


@query
def d20_histogram(s, d):
    return de.histogram(_delays(s, d), "avg_scheduled_runtime")


@query
def d21_correlation_matrix(s, d):
    return de.correlation_matrix(_delays(s, d), [*NUMBERS, "delay_min"]).withColumn("r", F.round("r", 8))


@query
def m2_nearest_split(s, d):
    return me.nearest_split(_delays(s, d), "month_date").groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("month_date").alias("first_month"), F.max("month_date").alias("last_month"))


def _model_rows(s, d):
    """Orders and line items are joined once; cuts and splits read what is written."""
    rows = materialise(de.delay_rows(tables.running_times(s, d)).select(*CATEGORIES, *NUMBERS, "delay_min", "month_date", "l_orderkey", "l_linenumber"))
    return me.nearest_split(de.clip_quantile(rows, "delay_min"), "month_date").dropna(subset=rows.columns)


def _regressions(s, d):
    df = _model_rows(s, d)
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def _line(s, d):
    """Model rows, their sums by fold, and the line fitted on all training folds."""
    df = _model_rows(s, d)
    sums = li.split_sums(df, CATEGORIES, NUMBERS, "delay_min", ["l_orderkey", "l_linenumber"])
    return df, sums, li.solve(sums, list(range(5)))


@query
def m3_design_matrix(s, d):
    train, test = _regressions(s, d)
    a, b = mo.design_matrix(train, test, categories=CATEGORIES, numbers=NUMBERS)
    from pyspark.ml.functions import vector_to_array

    x = F.aggregate(vector_to_array("x"), F.lit(0.0), lambda p, q: p + q)
    return a.unionByName(b).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(vector_to_array("x"))).alias("n_columns"), F.round(F.sum(x), 3).alias("total"))


@query
def m20_linear_regression(s, d):
    """R2 and RMSE from the sums of the test rows; MAE takes a scan of them."""
    df, sums, line = _line(s, d)
    _, r2, rmse = li.judged(sums, [li.TEST], line)
    test = de.residuals(li.predicted(df.filter("split = 'test'"), line, sums.levels, NUMBERS))
    return test.agg(F.round(F.lit(r2), 6).alias("r2"), F.round(F.avg(F.abs("residual")), 6).alias("mae"), F.round(F.lit(rmse), 6).alias("rmse"))


@query
def p19_residuals(s, d):
    df, sums, line = _line(s, d)
    rows = de.residuals(li.predicted(df.filter("split = 'test'"), line, sums.levels, NUMBERS))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("residual"), 6).alias("mean_residual"))


@query
def t3_top_coefficients(s, d):
    """Coefficients on standardised numbers and levels."""
    _, _, line = _line(s, d)
    rows = [(n, float(v)) for n, v in zip(line.names, line.slopes * line.scale, strict=True)]
    return mo.top_features(s.createDataFrame(rows, "feature string, value double"), "value", 15)


@query
def m21_cross_validated_r2(s, d):
    _, sums, _ = _line(s, d)
    return s.createDataFrame(li.cross_validated(sums), "fold int, r2 double")


@query
def m22_forest_against_linear(s, d):
    """A forest of 300 trees of depth 5 beside the linear model."""
    df, sums, line = _line(s, d)
    forest = fo.fit_forest(df.filter("split = 'train'"), sums.levels, NUMBERS, "delay_min")
    models = {"linear": lambda rows: li.predicted(rows, line, sums.levels, NUMBERS), "forest": forest.transform}
    return mo.compare_models(models, df.filter("split = 'test'"), "delay_min")
