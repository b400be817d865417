"""Schedules: from stop departures to scheduled service per entity and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import date_hour, fold_alias
from hourgrid.policy import Policy


def month_slice(departures: DataFrame, year: int, month: int, col: str = "departure_time") -> DataFrame:
    """Departures of one month, as a half-open range that reaches the scan."""
    lo, hi = f"{year:04d}-{month:02d}-01", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    return departures.filter(f"{col} >= timestamp_ntz'{lo} 00:00:00' and {col} < timestamp_ntz'{hi} 00:00:00'")


def schedule_line_hours(departures: DataFrame) -> DataFrame:
    """Revenue stop departures of regular trips per date, hour and line; rows without a time
    drop out. Counts combine before the shuffle."""
    rows = departures.filter("departure_time is not null and trip_type = '0' and revenue_service = '1'")
    keys = [F.to_date("departure_time").alias("service_date"), F.hour("departure_time").alias("service_hour"), F.col("trip_line").alias("line")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("departures"))


def schedule_coverage(schedule: DataFrame) -> DataFrame:
    """Dates that any schedule row covers, with their least year and dataset id."""
    return schedule.groupBy("service_date").agg(F.min("dataset_year").alias("dataset_year"), F.min("dataset_id").alias("dataset_id"))


def unmapped_schedule(schedule: DataFrame, policy: Policy) -> DataFrame:
    """Rows whose line is no entity, no alias and not ignored."""
    known = F.broadcast(schedule.sparkSession.createDataFrame([(x,) for x in (*policy.canonical, *policy.aliases, *policy.ignored)], "line string"))
    return schedule.join(known, "line", "left_anti")


def schedule_fact(schedule: DataFrame, policy: Policy) -> DataFrame:
    """Scheduled departures per entity and hour, aliases folded; ignored lines drop out."""
    known = F.broadcast(policy.entity_table(schedule.sparkSession))
    rows = schedule.withColumn("entity", fold_alias(F.col("line"), policy)).join(known, "entity", "left_semi")
    sums = rows.groupBy("entity", "service_date", "service_hour").agg(F.sum("departures").alias("departures"))
    return sums.select("entity", date_hour(F.col("service_date"), F.col("service_hour")).alias("hour"), "departures")
