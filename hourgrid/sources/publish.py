"""Layers that are published together, after their checks, or not at all.

A run writes its layers to a staging folder beside the published one. Checks read what was
written; only then the staging folder takes the published name, by renames. Folders beside ``out`` are
named ``.<out>.staging-<id>`` and ``.<out>.previous-<id>``; what a killed run leaves is put right by the
next one, and :func:`published` finds the whole old version meanwhile.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from hourgrid.functions import files
from hourgrid.operators.quality import assert_quality
from hourgrid.sources.sinks import write_layer

#: Seconds after which a staging folder is taken to be of a run that has died.
ABANDONED = 24 * 3600
REPORT = "report.json"


def _beside(spark: SparkSession, out: str, kind: str) -> list[str]:
    folder, _, name = out.rstrip("/").rpartition("/")
    return [f"{folder}/{n}" for n in files.names(spark, folder or ".") if n.startswith(f".{name}.{kind}-")]


def published(spark: SparkSession, out: str) -> str | None:
    """The folder that holds the published version: ``out``, or, if a run was killed between its two
    renames, where that run had put the old one. None if nothing was ever published."""
    if files.exists(spark, out):
        return out
    return max(_beside(spark, out, "previous"), key=lambda p: files.changed_at(spark, p), default=None)


def recover(spark: SparkSession, out: str) -> None:
    """Puts right what killed runs left: an old version moved aside comes back if no new one took its
    place, else it goes; staging folders go after :data:`ABANDONED` seconds."""
    kept = published(spark, out)
    if kept is not None and kept != out:
        files.move(spark, kept, out)
    for path in _beside(spark, out, "previous"):
        files.delete(spark, path)
    for path in _beside(spark, out, "staging"):
        if time.time() - files.changed_at(spark, path) > ABANDONED:
            files.delete(spark, path)


class Publication:
    """A run that publishes layers at ``out``; as a context manager it drops its staging folder
    unless :meth:`publish` was reached.

    ``out`` must not exist unless ``replace``. Of two runs that replace at once one fails, and leaves
    the other's version."""

    def __init__(self, spark: SparkSession, out: str, replace: bool = False) -> None:
        self.spark, self.out = spark, out.rstrip("/")
        recover(spark, self.out)
        if not replace and files.exists(spark, self.out):
            raise FileExistsError(f"{self.out} already exists")
        folder, _, name = self.out.rpartition("/")
        self._named = lambda kind: f"{folder}/.{name}.{kind}-{uuid.uuid4().hex}" if folder else f".{name}.{kind}-{uuid.uuid4().hex}"
        self.staging = self._named("staging")

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, *error: object) -> None:
        files.delete(self.spark, self.staging)

    def write(self, layer: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write a layer to the staging folder, and read it from there."""
        write_layer(df, f"{self.staging}/{layer}", partition_by=partition_by)
        return self.read(layer)

    def read(self, layer: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.staging}/{layer}")

    def publish(self, checks: DataFrame, report: dict | None = None) -> None:
        """Give the staged layers the published name, if all ``checks`` passed (else QualityError). A
        ``report`` goes with them as one JSON document."""
        assert_quality(checks)
        if report is not None:
            files.write_text(self.spark, f"{self.staging}/{REPORT}", json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")
        old = None
        if files.exists(self.spark, self.out):
            old = self._named("previous")
            files.move(self.spark, self.out, old)
        try:
            files.move(self.spark, self.staging, self.out)
        except BaseException:
            recover(self.spark, self.out)
            raise
        if old is not None:
            files.delete(self.spark, old)


def read_report(spark: SparkSession, out: str) -> dict:
    """The report of the published version."""
    return json.loads(files.read_text(spark, f"{published(spark, out)}/{REPORT}"))
