"""Features of an entity's hour, made of strictly earlier hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.columns import hours_between
from hourgrid.functions.frames import CHUNK_HOURS, trailing_mean, trailing_sum, with_halo

#: Frames of sums, and of rates, in rows (hours of the dense grid).
SUMS, RATES, SYSTEM_RATE = (1, 3, 6, 24), {"7d": 168, "30d": 720}, 168

#: The model's numeric columns.
NUMERIC = (
    "year", "month", "weekday", "hour_of_day", "is_weekend", "scheduled_departures", "history_hours", *[f"starts_prior_{k}h" for k in SUMS],
    *[f"rate_prior_{n}" for n in RATES], "hours_since_start", *[f"system_starts_prior_{k}h" for k in SUMS], "system_rate_prior_7d",
)


def system_hours(targets: DataFrame) -> DataFrame:
    """Per hour the starts of all entities, and the share of entities with label 1."""
    return targets.groupBy("hour").agg(F.sum("n_starts").alias("system_starts"), F.sum("label").alias("__pos"), F.count(F.lit(1)).alias("__n"), F.avg(F.col("label").cast("double")).alias("system_rate"))


def system_history(hours: DataFrame, chunk: int = CHUNK_HOURS) -> DataFrame:
    """Trailing sums and the trailing mean of hourly rates over all entities, before each hour.
    One row per hour comes in; long histories are dealt to chunks of a year."""
    df = with_halo(hours, "hour", SYSTEM_RATE, chunk)
    order = Window.partitionBy("__chunk").orderBy("hour")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__c", F.sum("system_starts").over(upto))
    df = df.withColumns({f"system_starts_prior_{k}h": F.coalesce(trailing_sum("__c", k, order), F.lit(0)) for k in SUMS})
    # Rates are no integers: their mean is taken over the frame itself.
    df = df.withColumn("system_rate_prior_7d", F.avg("system_rate").over(order.rowsBetween(-SYSTEM_RATE, -1)))
    return df.filter(~F.col("__halo")).select("hour", *[f"system_starts_prior_{k}h" for k in SUMS], "system_rate_prior_7d")


def entity_history(targets: DataFrame, chunk: int = CHUNK_HOURS) -> DataFrame:
    """Targets with history length, trailing sums and rates, and the last earlier start.

    Frames come from running sums and ``lag``. An entity's series is dealt to chunks of time
    that repeat the hours before them as far as frames reach; what reaches further back
    (history length, last start) is carried over from totals per chunk."""
    halo = max(RATES.values())
    df = with_halo(targets, "hour", halo, chunk)
    totals = df.filter(~F.col("__halo")).groupBy("entity", "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("label") == 1, F.col("hour"))).alias("__last"))
    before = Window.partitionBy("entity").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("entity", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"), F.max("__last").over(before).alias("__prev"))
    order = Window.partitionBy("entity", "__chunk").orderBy("hour")
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"__row": F.row_number().over(order), "__c": F.sum("n_starts").over(upto), "__p": F.sum("label").over(upto), "__seen": F.sum(F.when(F.col("__halo"), 0).otherwise(1)).over(past), "__near": F.max(F.when(F.col("label") == 1, F.col("hour"))).over(past)})
    frames = {f"starts_prior_{k}h": F.coalesce(trailing_sum("__c", k, order), F.lit(0)) for k in SUMS} | {f"rate_prior_{n}": F.when(F.col("__row") > 1, trailing_mean("__p", "__row", k, order)) for n, k in RATES.items()}
    df = df.withColumns(frames).filter(~F.col("__halo")).join(carry, ["entity", "__chunk"])
    df = df.withColumn("history_hours", (F.col("__rows") + F.coalesce("__seen", F.lit(0))).cast("long"))
    df = df.withColumn("last_start_hour", F.coalesce("__near", "__prev"))
    return df.drop("__chunk", "__halo", "__row", "__c", "__p", "__seen", "__near", "__rows", "__prev")


def build_features(targets: DataFrame, schedule: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row per entity and hour: calendar, schedule, own and system history, label.

    ``service_active`` is 1 or 0 on dates that a schedule covers and null elsewhere;
    ``is_eligible`` marks hours with scheduled service. System history and coverage have a
    row per hour or date, and Spark broadcasts them while they are small."""
    own = entity_history(targets).withColumn("hours_since_start", hours_between(F.col("last_start_hour"), F.col("hour"))).withColumn("service_date", F.to_date("hour"))
    df = own.join(system_history(system_hours(targets)), "hour").join(coverage.select("service_date", F.lit(1).alias("__known")), "service_date", "left")
    df = df.join(schedule.select("entity", "hour", F.col("departures").alias("scheduled_departures")), ["entity", "hour"], "left")
    known, active = F.col("__known").isNotNull(), F.col("scheduled_departures").isNotNull()
    return df.withColumns({"coverage_known": known.cast("int"), "service_active": F.when(known, active.cast("int")), "is_eligible": active.cast("int")}).drop("__known", "service_date")


def model_rows(features: DataFrame) -> DataFrame:
    """Eligible rows with 0 for missing numbers."""
    return features.filter("is_eligible = 1").fillna(0, list(NUMERIC))
