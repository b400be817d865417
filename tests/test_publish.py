"""Layers are published whole after their checks; failed and killed runs leave the old version."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import files
from hourgrid.jobs import workloads
from hourgrid.operators.quality import QualityError
from hourgrid.sources import publish
from hourgrid.sources.publish import Publication, published, read_report, recover
from tests.test_workloads import folder  # noqa: F401


def checks(spark, *passed):
    return spark.createDataFrame([(f"check {i}", p) for i, p in enumerate(passed)], "name string, passed boolean")


def release(spark, out, rows, ok=True, replace=True):
    with Publication(spark, out, replace) as new:
        a = new.write("a", spark.range(rows).withColumn("year", F.lit(2024)), ("year",))
        new.write("b", a.select((F.col("id") * 2).alias("twice")))
        new.publish(checks(spark, True, ok), {"rows": a.count()})


def rows(spark, out):
    path = published(spark, out)
    return spark.read.parquet(f"{path}/a").count(), spark.read.parquet(f"{path}/b").count(), read_report(spark, out)["rows"]


def beside(tmp_path):
    return sorted(n for n in os.listdir(tmp_path) if n.startswith("."))


def test_versions_replace_each_other(spark, tmp_path):
    out = f"{tmp_path}/out"
    assert published(spark, out) is None
    release(spark, out, 3, replace=False)
    assert rows(spark, out) == (3, 3, 3)
    with pytest.raises(FileExistsError, match="already exists"):
        release(spark, out, 4, replace=False)
    release(spark, f"{out}/", 5)
    assert rows(spark, out) == (5, 5, 5) and beside(tmp_path) == []


def test_a_failed_check_publishes_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    for old in (None, (3, 3, 3)):
        with pytest.raises(QualityError, match="check 1"):
            release(spark, out, 9, ok=False)
        assert (rows(spark, out) if old else published(spark, out)) == old and beside(tmp_path) == []
        release(spark, out, 3)


def test_a_run_that_stops_midway(spark, tmp_path):
    out = f"{tmp_path}/out"
    release(spark, out, 3)
    with pytest.raises(KeyboardInterrupt), Publication(spark, out, True) as new:
        new.write("a", spark.range(9))
        raise KeyboardInterrupt
    assert rows(spark, out) == (3, 3, 3) and beside(tmp_path) == []


@pytest.mark.parametrize("renames", [0, 1, 2])
def test_a_run_that_is_killed_while_it_publishes(spark, tmp_path, monkeypatch, renames):
    """After each rename of publish() nothing more runs: no cleaning, no recovery, as when the driver is killed."""
    out = f"{tmp_path}/out"
    release(spark, out, 3)
    left = [renames]

    class Killed(BaseException):
        pass

    def move(*a, real=files.move):
        if not left[0]:
            raise Killed
        left[0] -= 1
        real(*a)

    def gone(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(publish.files, "move", move)
        m.setattr(publish.files, "delete", gone)
        m.setattr(publish, "recover", lambda *_: None)
        with pytest.raises(Killed):
            release(spark, out, 7)
    whole = (7, 7, 7) if renames == 2 else (3, 3, 3)
    assert rows(spark, out) == whole
    recover(spark, out)
    assert rows(spark, out) == whole and published(spark, out) == out and not any("previous" in n for n in beside(tmp_path))
    monkeypatch.setattr(publish, "ABANDONED", -1)
    release(spark, out, 8)
    assert rows(spark, out) == (8, 8, 8) and beside(tmp_path) == []


def test_staging_of_a_running_job_stays(spark, tmp_path):
    out = f"{tmp_path}/out"
    with Publication(spark, out) as slow:
        slow.write("a", spark.range(2))
        release(spark, out, 4)
        assert len(beside(tmp_path)) == 1
        slow.write("b", spark.range(2))
        slow.publish(checks(spark, True), {"rows": 2})  # a version came meanwhile; this one replaces it
    assert rows(spark, out) == (2, 2, 2) and beside(tmp_path) == []


def test_moves_do_not_go_into_a_folder(spark, tmp_path):
    for n in "ab":
        os.mkdir(tmp_path / n)
    with pytest.raises(FileExistsError):
        files.move(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert os.listdir(tmp_path / "b") == [] and files.names(spark, f"{tmp_path}/none") == []


def test_build_checks_before_it_publishes(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    out = f"{tmp_path}/out"
    with pytest.raises(QualityError, match="schedule_entities_mapped"):
        workloads.build(spark, folder, out, waived=())
    assert published(spark, out) is None
    report = workloads.build(spark, folder, out)
    assert report["failures"] == report["waived"] == ["schedule_entities_mapped"] and len(report["checks"]) == 9 and json.loads(json.dumps(report, default=str)) == read_report(spark, out)
    assert report["summary"]["n_updates"] == 3000 and report["schedule_and_features"]["n_feature_rows"] == report["summary"]["n_grid_rows"]
    assert len(report["prevalence_by_entity"]) == 25 and report["top_status_tokens"][0]["n_updates"] == max(t["n_updates"] for t in report["top_status_tokens"])
    before = spark.read.parquet(f"{out}/labels").count()

    def lossy(*a, real=workloads.feature_job):
        return real(*a).filter("entity <> 'L3'")

    def stops(*_):
        raise RuntimeError("stopped midway")

    for broken, error, said in ((lossy, QualityError, "feature_target_row_parity"), (stops, RuntimeError, "midway")):
        monkeypatch.setattr(workloads, "feature_job", broken)
        with pytest.raises(error, match=said):
            workloads.build(spark, folder, out, replace=True)
        assert spark.read.parquet(f"{out}/labels").count() == before == spark.read.parquet(f"{out}/features").count() and beside(tmp_path) == []
