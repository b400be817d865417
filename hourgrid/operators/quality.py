"""Counts, prevalences and named checks of the layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.policy import Policy


class QualityError(ValueError):
    """Checks that failed."""


def _long(col):
    return col.cast("long")


def quality_summary(timeline: DataFrame, starts: DataFrame, targets: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row of counts over the layers; each layer is aggregated by itself."""
    a = timeline.agg(F.count(F.lit(1)).alias("n_updates"), F.countDistinct("event_id").alias("n_events"), F.countDistinct("instance_id").alias("n_instances"), F.min("published_at").alias("min_published"), F.max("published_at").alias("max_published"))
    b = starts.agg(F.count(F.lit(1)).alias("n_starts"))
    c = targets.agg(F.count(F.lit(1)).alias("n_grid_rows"), F.countDistinct("hour").alias("n_hours"), _long(F.sum("label")).alias("n_positive"), _long(F.coalesce(F.sum("n_starts"), F.lit(0))).alias("n_assigned"))
    d = unmapped.agg(F.count(F.lit(1)).alias("n_unmapped"))
    rows = [x.withColumn("__one", F.lit(1)) for x in (a, b, c, d)]  # one row each
    df = reduce(lambda x, y: x.join(F.broadcast(y), "__one"), rows).drop("__one")
    return df.withColumn("prevalence", F.coalesce(F.try_divide(F.col("n_positive"), F.col("n_grid_rows")), F.lit(0.0)))


def duplicate_update_keys(updates: DataFrame) -> DataFrame:
    """How many (event, revision) keys occur more than once."""
    return updates.groupBy("event_id", "revision").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n_duplicate_keys"))


def prevalence_by_entity(targets: DataFrame) -> DataFrame:
    return targets.groupBy("entity").agg(F.count(F.lit(1)).alias("n_hours"), _long(F.sum("label")).alias("n_positive"), F.avg(F.col("label").cast("double")).alias("prevalence"))


def feature_summary(features: DataFrame, schedule_rows: DataFrame, coverage: DataFrame, fact: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row: sizes of the schedule layers, eligible rows, positives outside scheduled service."""
    eligible, positive = F.col("is_eligible") == 1, F.col("label") == 1
    count = lambda cond: F.count(F.when(cond, 1))
    f = features.agg(
        F.count(F.lit(1)).alias("n_feature_rows"), count(eligible).alias("n_eligible"), count(eligible & positive).alias("n_eligible_positive"),
        count((F.col("coverage_known") == 1) & (F.col("service_active") == 0) & positive).alias("n_positive_inactive"),
    )
    rows = [f] + [x.agg(F.count(F.lit(1)).alias(n)) for n, x in (("n_schedule_rows", schedule_rows), ("n_covered_dates", coverage), ("n_schedule_fact", fact), ("n_unmapped_schedule", unmapped))]
    rows = [x.withColumn("__one", F.lit(1)) for x in rows]
    return reduce(lambda x, y: x.join(F.broadcast(y), "__one"), rows).drop("__one")


def quality_checks(summary: DataFrame, targets: DataFrame, policy: Policy, features: DataFrame | None = None) -> DataFrame:
    """(name, passed, observed, expected) of five checks, and four more with the row of
    :func:`feature_summary`. ``expected`` is null where a check asks for a range."""
    bad = targets.agg(F.count(F.when(~F.col("label").isin(0, 1) | F.col("label").isNull(), 1)).alias("n_bad")).withColumn("__one", F.lit(1))
    df = summary.withColumn("__one", F.lit(1)).join(F.broadcast(bad), "__one")
    want = F.col("n_hours") * len(policy.canonical)
    checks = [
        ("raw_rows_present", F.col("n_updates") > 0, F.col("n_updates"), None),
        ("canonical_entity_count", F.lit(len(set(policy.canonical)) == len(policy.canonical)), F.lit(len(policy.canonical)), F.lit(len(set(policy.canonical)))),
        ("grid_completeness", F.col("n_grid_rows") == want, F.col("n_grid_rows"), want),
        ("binary_target_values", F.col("n_bad") == 0, F.col("n_bad"), F.lit(0)),
        ("both_target_classes_present", (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_grid_rows")), F.col("n_positive"), None),
    ]
    if features is not None:
        df = df.join(F.broadcast(features.withColumn("__one", F.lit(1))), "__one")
        checks += [
            ("feature_target_row_parity", F.col("n_feature_rows") == F.col("n_grid_rows"), F.col("n_feature_rows"), F.col("n_grid_rows")),
            ("schedule_rows_present", F.col("n_schedule_rows") > 0, F.col("n_schedule_rows"), None),
            ("schedule_entities_mapped", F.col("n_unmapped_schedule") == 0, F.col("n_unmapped_schedule"), F.lit(0)),
            ("eligible_rows_have_both_classes", (F.col("n_eligible_positive") > 0) & (F.col("n_eligible_positive") < F.col("n_eligible")), F.col("n_eligible_positive"), None),
        ]
    rows = [F.struct(F.lit(n).alias("name"), p.alias("passed"), _long(o).alias("observed"), (F.lit(None) if e is None else e).cast("long").alias("expected")) for n, p, o, e in checks]
    return df.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def assert_quality(checks: DataFrame) -> None:
    """Raise if a check failed."""
    if failed := [r["name"] for r in checks.filter(~F.col("passed")).collect()]:  # nine rows at most
        raise QualityError(", ".join(sorted(failed)))


def report_document(tables: dict[str, DataFrame]) -> dict:
    """Small tables as one document: those of one row as an object, others as a list, in the order of all their
    values; ``failures`` names the checks that failed."""
    document: dict = {}
    for name, df in tables.items():
        rows = [r.asDict() for r in df.collect()]  # a row per check, entity or frequent token
        one = name in ("summary", "schedule_and_features", "duplicate_update_keys")
        document[name] = rows[0] if one else sorted(rows, key=lambda r: (-(r.get("n_updates") or 0), *map(str, r.values())))
    return document | {"failures": sorted(r["name"] for r in document.get("checks", []) if not r["passed"])}


def eligible_prevalence(features: DataFrame, by: str) -> DataFrame:
    """Rows, positives and prevalence of eligible hours by an entity or calendar column."""
    return features.filter("is_eligible = 1").groupBy(by).agg(F.count(F.lit(1)).alias("n_hours"), _long(F.sum("label")).alias("n_positive"), F.avg(F.col("label").cast("double")).alias("prevalence")).orderBy(F.desc("prevalence"), by)


def prevalence_by_hour(features: DataFrame) -> DataFrame:
    """All 24 hours of the day with the prevalence on weekdays and weekends, 0 if there are no rows."""
    rates = features.filter("is_eligible = 1").groupBy("hour_of_day").pivot("is_weekend", [0, 1]).agg(F.avg(F.col("label").cast("double")))
    rates = rates.select("hour_of_day", F.col("0").alias("weekday_rate"), F.col("1").alias("weekend_rate"))
    hours = features.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    return hours.join(rates, "hour_of_day", "left").fillna(0.0, ["weekday_rate", "weekend_rate"])


def top_tokens(tokens: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most frequent tokens; of equals the first by name."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_updates")).orderBy(F.desc("n_updates"), "token").limit(n)


def eligible_entities(features: DataFrame) -> DataFrame:
    return features.filter("is_eligible = 1").select("entity").distinct().orderBy("entity")


def check_policy(policy_tokens: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(problem, value): tokens that are significant and planned, aliases to no entity."""
    both = policy_tokens.filter("is_significant = 1").select("token").intersect(policy_tokens.filter("is_planned = 1").select("token"))
    lost = aliases.join(entities, aliases["target"] == entities["entity"], "left_anti")
    return both.select(F.lit("token in both sets").alias("problem"), F.col("token").alias("value")).union(lost.select(F.lit("alias of no entity"), F.col("alias")))
