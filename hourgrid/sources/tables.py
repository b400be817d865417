"""The library's inputs as views of a star schema with ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.policy import Policy

#: The policy of the events table.
EVENTS = Policy(scope="events", canonical=tuple(f"L{i}" for i in range(25)), aliases={f"L{i}X": f"L{i}" for i in range(25)}, ignored=("L26",), significant=("error",), planned=("planned-work",), datasets={2024: "d2024"})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """Events as typed updates: a user's events are an incident that a signup resets."""
    k, user = F.col("k"), F.col("user_id")
    second = F.concat(F.lit(" | L"), (k % 25).cast("string"), F.when(k % 4 == 0, "X").otherwise(""), F.when(k == 99, " | ZZ").otherwise(""))
    return _events(spark, folder).select(
        F.col("event_id").alias("update_id"), user.alias("event_id"), F.when(F.col("event_type") == "signup", 0).otherwise(1 + k % 5).cast("long").alias("revision"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("published_at"), F.lit("events").alias("agency"),
        F.concat("event_type", F.when(k % 10 == 3, " | planned-work").otherwise("")).alias("status_label"), F.concat(F.lit("L"), (user % 25).cast("string"), second).alias("affected"),
        F.when(k % 7 != 0, F.concat(F.lit("k="), k.cast("string"))).alias("header"),
    )


def raw_updates(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as text, with an error in some: offsets, another agency, bad numbers."""
    k = F.col("k")
    df = updates(spark, folder).join(_events(spark, folder).select(F.col("event_id").alias("update_id"), "k"), "update_id")
    return df.select(
        F.when(k == 17, "x1").otherwise(F.col("update_id").cast("string")).alias("alert_id"), F.col("event_id").cast("string").alias("event_id"),
        F.when(k == 13, "-1").otherwise(F.col("revision").cast("string")).alias("update_number"),
        F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250"), F.when(k == 7, "+05:00").otherwise("")).alias("date"),
        F.when(k == 11, "other").otherwise(F.lit(" events")).alias("agency"), "status_label", "affected", F.coalesce("header", F.lit(" ")).alias("header"), F.lit("").alias("description"),
    )


def departures(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stop departures; every seventh day of a month has none."""
    return _events(spark, folder).filter(F.dayofmonth("ts") % 7 != 0).select(
        F.when(F.col("k") != 50, F.col("ts")).alias("departure_time"), F.concat(F.lit("L"), (F.col("k") % 27).cast("string")).alias("trip_line"),
        F.when(F.col("event_type") == "click", "1").otherwise("0").alias("trip_type"), F.when(F.col("value") > 1, "1").otherwise("0").alias("revenue_service"),
    )


def schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Departures per date, hour and line, with year and dataset."""
    from hourgrid.operators.schedules import schedule_line_hours

    rows = schedule_line_hours(departures(spark, folder))
    year = F.year("service_date")
    return rows.select(year.alias("dataset_year"), F.concat(F.lit("d"), year.cast("string")).alias("dataset_id"), "service_date", "service_hour", "line", "departures")


def running_times(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their orders as monthly running times."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    scheduled = F.col("l_extendedprice") / 1000
    late = F.datediff("l_shipdate", "o_orderdate") / 10.0
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("line"), F.col("l_linestatus").alias("direction"), F.col("l_returnflag").alias("time_period"), F.col("o_orderstatus").alias("schedule_day_type"),
        F.trunc("o_orderdate", "month").alias("month_date"), F.col("l_linenumber").alias("number_of_stops"), F.col("l_quantity").alias("distance"), F.col("l_suppkey").alias("scheduled_trains"),
        scheduled.alias("avg_scheduled_runtime"), (scheduled + late).alias("avg_actual_runtime"), "l_orderkey", "l_linenumber",
    )
