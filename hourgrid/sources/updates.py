"""Reading, validating and snapshotting raw updates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions import files
from hourgrid.functions.columns import blank_to_null, naive_timestamp, strip, whole_number

#: Columns of a raw update file.
RAW = ("alert_id", "event_id", "update_number", "date", "agency", "status_label", "affected", "header", "description")


class BadRows(ValueError):
    """Rows that a load refuses."""


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of updates, every field as text; ValueError names missing columns."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in RAW if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*RAW)


def _first_reason(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])


def _split(df: DataFrame, on_error: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects with ``reason``; in ``fail`` mode any reject raises."""
    good, bad = df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())
    if on_error == "fail" and (rows := bad.limit(3).collect()):
        raise BadRows("; ".join(str(r.asDict()) for r in rows))
    return good, bad


def parse_updates(raw: DataFrame, scope: str, on_error: str = "fail", dataset_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed updates, and rejects with the first reason that holds.

    Ids are integers, the revision is one of 0 or more, the time is naive (an offset is an
    error) and cut to seconds, the agency is ``scope``; empty texts become null. Adds
    ``dataset_id`` and ``ingested_at``. One scan, no shuffle."""
    typed = {
        "update_id": whole_number(F.col("alert_id")), "event_id": whole_number(F.col("event_id")), "revision": whole_number(F.col("update_number")),
        "published_at": naive_timestamp(F.col("date")), "agency": strip(F.col("agency")), "status_label": F.coalesce(F.col("status_label"), F.lit("")),
        "affected": F.coalesce(F.col("affected"), F.lit("")), "header": blank_to_null(F.col("header")), "description": blank_to_null(F.col("description")),
    }
    df = raw.select(*[c.alias(n) for n, c in typed.items()])
    checks = {
        "update_id": F.col("update_id").isNull(), "event_id": F.col("event_id").isNull(), "revision": F.col("revision").isNull() | (F.col("revision") < 0),
        "published_at": F.col("published_at").isNull(), "scope": F.col("agency") != scope,
    }
    df = df.withColumns({"reason": _first_reason(checks), "dataset_id": F.lit(dataset_id), "ingested_at": F.current_timestamp()})
    return _split(df, on_error)


def parse_schedule(raw: DataFrame, datasets: dict[int, str], on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Typed schedule rows, and rejects: the year is known and its dataset id matches, the date
    is ISO and of that year, the hour is 0 to 23, the count positive, the line not blank."""
    ids = F.create_map(*[F.lit(x) for pair in sorted(datasets.items()) for x in pair])
    iso = strip(F.col("departure_date"))
    df = raw.select(
        whole_number(F.col("dataset_year")).cast("int").alias("dataset_year"), strip(F.col("dataset_id")).alias("dataset_id"),
        F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), iso.try_cast("date")).alias("service_date"), whole_number(F.col("departure_hour")).cast("int").alias("service_hour"),
        F.upper(strip(F.col("trip_line"))).alias("line"), whole_number(F.col("scheduled_revenue_stop_departures")).alias("departures"),
    )
    checks = {
        "dataset": F.coalesce(F.try_element_at(ids, F.col("dataset_year")) != F.col("dataset_id"), F.lit(True)), "date": F.col("service_date").isNull(),
        "year": F.year("service_date") != F.col("dataset_year"), "hour": ~F.col("service_hour").between(0, 23), "count": F.col("departures") <= 0, "line": F.col("line") == "",
    }
    return _split(df.withColumn("reason", _first_reason(checks)), on_error)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``n_rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def snapshot(df: DataFrame, id_col: str, after: int = 0, cutoff: int | None = None, limit: int | None = None, scope: Column | None = None) -> DataFrame:
    """Rows of the scope with ``after`` < id <= cutoff (default: the largest id of the scope),
    or the first ``limit`` of them by id. Raises if there are fewer than ``limit``."""
    rows = df if scope is None else df.filter(scope)
    if cutoff is None:
        cutoff = rows.agg(F.max(id_col)).first()[0]
    rows = rows.filter((F.col(id_col) > after) & (F.col(id_col) <= F.lit(cutoff)))
    if limit is None:
        return rows
    first = rows.orderBy(id_col).limit(limit)
    if (n := first.count()) < limit:
        raise BadRows(f"{n} rows, {limit} expected")
    return first


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> list[Column]:
    """Aggregates that identify a table's rows whatever their order: count, XOR and sum of
    row hashes."""
    h = F.xxhash64(*[F.col(c) for c in cols or df.columns])
    return [F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum")]


def _hash_sum(total: int) -> int:
    """A sum of 64-bit hashes as a decimal of 38 digits holds it, whatever the number of rows."""
    return total % (1 << 120)


def continue_snapshot(df: DataFrame, path: str, id_col: str, cutoff: int | None = None, scope: Column | None = None, expected: int | None = None) -> dict:
    """Brings a stored snapshot of ``df`` up to ``cutoff`` (default: the largest id of the scope), and returns its manifest.

    The folder holds parts, one for each run, and a manifest beside each: rows, cutoff and fingerprint of all parts so far, which add up from
    those before and the new rows. Only ids after the last cutoff are read and written. A part counts from when its
    manifest is there; what a killed run left is written anew.

    Raises BadRows, and leaves the snapshot as it was, if the source has another number of rows up to the cutoff
    than ``expected`` (default: as it counts itself now) or than the snapshot would hold: rows are missing, or came or went
    below the last cutoff. The first run makes the folder; without new rows nothing is written."""
    spark = df.sparkSession
    rows = df if scope is None else df.filter(scope)
    old = read_snapshot_manifest(spark, path)
    after = -(1 << 63) if old is None else old["cutoff_id"]
    if cutoff is None:
        cutoff = rows.agg(F.max(id_col)).first()[0]
    if cutoff is None or cutoff <= after:
        if old is None:
            raise BadRows("the source has no rows")
        return old
    at_source = rows.filter(F.col(id_col) <= F.lit(cutoff)).count()
    wanted = at_source if expected is None else expected
    part = 0 if old is None else old["parts"]
    new = rows.filter((F.col(id_col) > F.lit(after)) & (F.col(id_col) <= F.lit(cutoff)))
    new.write.mode("overwrite").parquet(f"{path}/part-{part}")
    got = spark.read.schema(new.schema).parquet(f"{path}/part-{part}").agg(*fingerprint(new)).first()
    held = old or {"n_rows": 0, "hash_xor": 0, "hash_sum": 0}
    manifest = {
        "n_rows": held["n_rows"] + got["n_rows"], "hash_xor": held["hash_xor"] ^ (got["hash_xor"] or 0), "hash_sum": _hash_sum(held["hash_sum"] + int(got["hash_sum"] or 0)),
        "cutoff_id": cutoff, "parts": part + 1, "columns": df.columns,
    }
    if manifest["n_rows"] != wanted or at_source != wanted:
        files.delete(spark, f"{path}/part-{part}")
        raise BadRows(f"{wanted} rows expected up to {cutoff}, {at_source} at the source, {manifest['n_rows']} in the snapshot")
    files.write_text(spark, f"{path}/manifest-{part}.json", json.dumps(manifest, sort_keys=True))
    return manifest


def read_snapshot_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the last finished part; None if there is none."""
    found = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in files.names(spark, path) if n.startswith("manifest-")]
    return json.loads(files.read_text(spark, f"{path}/manifest-{max(found)}.json")) if found else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished parts."""
    manifest = read_snapshot_manifest(spark, path)
    if manifest is None:
        raise BadRows(f"no snapshot in {path}")
    return spark.read.parquet(*[f"{path}/part-{i}" for i in range(manifest["parts"])])


def snapshot_manifest(df: DataFrame, id_col: str, time_col: str, source_rows: int | None = None) -> DataFrame:
    """One row: rows, cutoff id, latest time, rows at the source, whether the snapshot was
    limited, columns and the content's fingerprint."""
    n = F.count(F.lit(1))
    total = F.lit(source_rows).cast("long") if source_rows is not None else n
    return df.agg(*fingerprint(df), F.max(id_col).alias("cutoff_id"), F.max(time_col).alias("max_time"), total.alias("source_rows"), (n < total).cast("int").alias("limited"), F.lit(",".join(df.columns)).alias("columns"))


def schedule_manifest(schedule: DataFrame) -> DataFrame:
    """Rows and first and last date of each year and dataset."""
    return schedule.groupBy("dataset_year", "dataset_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("service_date").alias("min_date"), F.max("service_date").alias("max_date"))


def jdbc_options(spark: SparkSession, url: str, table: str, column: str, partitions: int, options: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a JDBC read in ``partitions`` ranges of a numeric, date or time ``column``, between its least and largest
    value at the source. Ranges have equal widths; rows without a value are in the first. An empty table is one range."""
    base = {"url": url, **(options or {})}
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = spark.read.format("jdbc").options(**base, query=f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}").load().first()
    if ends[0] is None or partitions < 2:
        return base | {"dbtable": table}
    return base | {"dbtable": table, "partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(partitions)}


def read_running_times(spark: SparkSession, source: str, options: dict[str, str] | None = None, partition_column: str | None = None, partitions: int = 8) -> DataFrame:
    """Running-time rows from Parquet, or over JDBC (``source`` is the URL) if ``options`` are given. Rows without
    scheduled or actual time, or with an empty line, are left out; the source filters.

    With ``partition_column``, ``options`` name a ``dbtable`` that is read by several tasks at once, each a range of that column."""
    if options and partition_column:
        rest = {k: v for k, v in options.items() if k != "dbtable"}
        df = spark.read.format("jdbc").options(**jdbc_options(spark, source, options["dbtable"], partition_column, partitions, rest)).load()
    else:
        df = spark.read.format("jdbc").options(url=source, **options).load() if options else spark.read.parquet(source)
    return df.filter("avg_scheduled_runtime is not null and avg_actual_runtime is not null and line <> ''")
