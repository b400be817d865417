"""Exact quantiles by brackets against numpy; sources and reports read back."""

import csv
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.functions.quantiles import exact_quantiles
from hourgrid.sources.sinks import write_report
from hourgrid.sources.updates import RAW, read_running_times, read_updates

PROBS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("one_task", [100, 100_000])
def test_quantiles_against_numpy(spark, one_task):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25), rng.integers(-5, 5, 500) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert exact_quantiles(df, F.col("x"), PROBS, one_task=one_task) == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)
    doubled = df.withColumn("w", F.lit(2))
    assert exact_quantiles(doubled, F.col("x"), PROBS, F.col("w"), one_task) == pytest.approx(list(np.quantile(np.repeat(values, 2), PROBS)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, F.col("x"), PROBS) == [] == exact_quantiles(df.limit(0), F.col("x"), PROBS)


def test_running_times_are_filtered_at_the_source(spark, tmp_path):
    rows = [("A", 1.0, 2.0), ("A", None, 2.0), ("B", 1.0, None), ("", 1.0, 1.0), (None, 1.0, 1.0)]
    spark.createDataFrame(rows, "line string, avg_scheduled_runtime double, avg_actual_runtime double").write.parquet(f"{tmp_path}/rt")
    assert [r.line for r in read_running_times(spark, f"{tmp_path}/rt").collect()] == ["A"]


def test_csv_fields_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [["1", "7", "0", "2024-01-01T00:00:00", "a", "s | t", "L1", 'He said "stop", twice', "two\nlines\n\nand, a comma"], ["2", "7", "1", "", "a", "", "", " spaced ", "é"]]
    with open(tmp_path / "in.csv", "w", newline="") as f:
        csv.writer(f).writerows([["extra", *RAW], *[["x", *r] for r in rows]])
    got = [[v or "" for v in r] for r in read_updates(spark, f"{tmp_path}/in.csv").orderBy("alert_id").collect()]
    assert got == rows


def test_reports_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "name string, n int, share double")
    for _ in range(2):  # replaced
        write_report(df, f"{tmp_path}/report")
    lines = [json.loads(x) for p in Path(f"{tmp_path}/report").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"name": "a", "n": 1}, {"name": "b", "n": 2, "share": 0.5}]
