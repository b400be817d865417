"""The dense grid of entities and hours, and its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.columns import hour_ceil, hour_floor
from hourgrid.policy import Policy


def coverage_bounds(updates: DataFrame) -> DataFrame:
    """(first_hour, end_hour): from the first full hour to the hour of the last update,
    exclusive. One row."""
    span = updates.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    return span.select(hour_ceil(F.col("lo")).alias("first_hour"), hour_floor(F.col("hi")).alias("end_hour"))


def with_calendar(df: DataFrame, col: str = "hour") -> DataFrame:
    """Adds year, month, Monday-0 weekday, hour of the day, weekend flag and the hour's end."""
    c = F.col(col)
    return df.withColumns({"year": F.year(c), "month": F.month(c), "weekday": F.weekday(c), "hour_of_day": F.hour(c), "is_weekend": (F.weekday(c) >= 5).cast("int"), "hour_end": c + F.expr("interval 1 hour")})


def hours_covered(updates: DataFrame) -> DataFrame:
    """One row per covered hour; ValueError if there is none."""
    bounds = coverage_bounds(updates).filter("end_hour > first_hour")
    lo_hi = bounds.first()  # one row
    if lo_hi is None:
        raise ValueError("the updates cover no full hour")
    hours = updates.sparkSession.createDataFrame([(lo_hi.first_hour, lo_hi.end_hour)], "lo timestamp_ntz, hi timestamp_ntz")
    return hours.select(F.explode(F.sequence("lo", F.expr("hi - interval 1 hour"), F.expr("interval 1 hour"))).alias("hour"))


def entity_hour_grid(updates: DataFrame, policy: Policy) -> DataFrame:
    """(entity, hour) for every entity and covered hour, with calendar columns. Hours are dealt
    to tasks first; each is then exploded to the policy's entities."""
    hours = hours_covered(updates).repartition("hour")
    grid = hours.withColumn("entity", F.explode(F.array(*[F.lit(e) for e in policy.canonical])))
    return with_calendar(grid.select("entity", "hour"))


def positive_counts(starts: DataFrame) -> DataFrame:
    """Distinct instances that start per entity and hour."""
    return starts.groupBy("entity", hour_floor(F.col("start_at")).alias("hour")).agg(F.countDistinct("instance_id").alias("n_starts"))


def label_grid(grid: DataFrame, starts: DataFrame) -> DataFrame:
    """The grid with ``n_starts`` (0 if none) and the 0/1 ``label``; starts outside it drop out."""
    df = grid.join(positive_counts(starts), ["entity", "hour"], "left").withColumn("n_starts", F.coalesce("n_starts", F.lit(0)).cast("long"))
    return df.withColumn("label", (F.col("n_starts") > 0).cast("int"))
