"""Writing layers, review sheets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a reviewer fills in.
REVIEWER_COLUMNS = ("reviewer", "is_significant_yes_no_uncertain", "is_unplanned_yes_no_uncertain", "policy_label_correct_yes_no_uncertain", "review_notes")


def write_layer(df: DataFrame, path: str, replace: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet at ``path``, which must not exist unless ``replace``."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def review_sheet(sample: DataFrame) -> DataFrame:
    """The sample with blank columns for the reviewer."""
    return sample.withColumns({c: F.lit("") for c in REVIEWER_COLUMNS})


def write_review(sample: DataFrame, path: str, replace: bool = False) -> None:
    """The review sheet as one CSV file; a sample is a few hundred rows."""
    review_sheet(sample).coalesce(1).write.mode("overwrite" if replace else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_report(rows: DataFrame, path: str, replace: bool = True) -> None:
    """A small result as JSON lines."""
    rows.coalesce(1).write.mode("overwrite" if replace else "errorifexists").json(path)
