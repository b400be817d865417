"""Partitioned JDBC reads, snapshots that continue, and the bounded sample."""

import os
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from hourgrid.functions import files
from hourgrid.operators import review
from hourgrid.sources import updates as up

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "RUNNING"}


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/times"
    rows = [(i, "" if i % 10 == 0 else f"L{i % 7}", None if i % 9 == 0 else float(i), None if i % 8 == 0 else i + 0.5) for i in range(100, 500)]
    df = spark.createDataFrame(rows, "id int, line string, avg_scheduled_runtime double, avg_actual_runtime double")
    df.write.format("jdbc").options(url=f"{url};create=true", driver=DERBY["driver"], dbtable="RUNNING", createTableColumnTypes="line VARCHAR(32)").save()
    yield url, rows
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")


def kept(rows):
    return sorted(r for r in rows if r[1] and r[2] is not None and r[3] is not None)


def test_jdbc_in_partitions_with_filters_at_the_source(spark, database):
    url, rows = database
    df = up.read_running_times(spark, url, DERBY, "id", 4)
    assert df.rdd.getNumPartitions() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=4" in plan and "PushedFilters" in plan and "Filter (" not in plan.replace("PushedFilters", "")
    for column in ("avg_scheduled_runtime", "avg_actual_runtime", "line"):
        assert column.lower() in plan[plan.index("PushedFilters") :].lower()
    assert sorted(map(tuple, df.collect())) == kept(rows)
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_jdbc_in_one_partition_and_of_nothing(spark, database):
    url, rows = database
    assert sorted(map(tuple, up.read_running_times(spark, url, DERBY).collect())) == kept(rows)
    spark.createDataFrame([], "id int, line string, avg_scheduled_runtime double, avg_actual_runtime double").write.format("jdbc").options(url=url, driver=DERBY["driver"], dbtable="NOTHING", createTableColumnTypes="line VARCHAR(32)").save()
    assert up.read_running_times(spark, url, DERBY | {"dbtable": "NOTHING"}, "id", 4).count() == 0


def source(spark, ids, scope="a"):
    return spark.createDataFrame([(i, f"text {i}", scope) for i in ids], "id long, t string, agency string")


def test_two_increments_give_the_manifest_of_one_load(spark, tmp_path):
    ids = random.Random(1).sample(range(1, 1000), 300)
    full = up.continue_snapshot(source(spark, ids), f"{tmp_path}/full", "id")
    early = [i for i in ids if i <= 400]
    first = up.continue_snapshot(source(spark, early), f"{tmp_path}/parts", "id")
    assert first["n_rows"] == len(early) and first["parts"] == 1
    again = up.continue_snapshot(source(spark, early), f"{tmp_path}/parts", "id")
    assert again == first and not files.exists(spark, f"{tmp_path}/parts/part-1")
    both = up.continue_snapshot(source(spark, ids), f"{tmp_path}/parts", "id", expected=300)
    same = ("n_rows", "hash_xor", "hash_sum", "cutoff_id", "columns")
    assert [both[c] for c in same] == [full[c] for c in same] and both["parts"] == 2
    assert sorted(r.id for r in up.read_snapshot(spark, f"{tmp_path}/parts").collect()) == sorted(ids)
    # The same aggregates as of the table itself.
    whole = source(spark, ids).agg(*up.fingerprint(source(spark, ids))).first()
    assert (both["n_rows"], both["hash_xor"], both["hash_sum"]) == (whole.n_rows, whole.hash_xor, int(whole.hash_sum) % (1 << 120))


@pytest.mark.parametrize("changed", ["late", "gone", "short"])
def test_a_row_that_is_missing_raises(spark, tmp_path, changed):
    path = f"{tmp_path}/s"
    up.continue_snapshot(source(spark, range(1, 51)), path, "id")
    before = up.read_snapshot_manifest(spark, path)
    rows, expected = {"late": ([0, *range(1, 80)], None), "gone": ([i for i in range(1, 80) if i != 7], None), "short": (range(1, 80), 80)}[changed]
    with pytest.raises(up.BadRows, match="expected up to 79"):
        up.continue_snapshot(source(spark, rows), path, "id", expected=expected)
    assert up.read_snapshot_manifest(spark, path) == before and up.read_snapshot(spark, path).count() == 50
    assert up.continue_snapshot(source(spark, range(1, 80)), path, "id", expected=79)["n_rows"] == 79


def test_a_killed_run_and_an_empty_source(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    with pytest.raises(up.BadRows, match="no rows"):
        up.continue_snapshot(source(spark, []), path, "id")
    with pytest.raises(up.BadRows, match="no snapshot"):
        up.read_snapshot(spark, path)
    with monkeypatch.context() as m:
        m.setattr(up.files, "write_text", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            up.continue_snapshot(source(spark, range(5)), path, "id")
    assert up.read_snapshot_manifest(spark, path) is None and os.listdir(path) == ["part-0"]
    other = source(spark, range(5)).unionByName(source(spark, range(90, 95), "b"))
    assert up.continue_snapshot(other, path, "id", scope=F.col("agency") == "a")["n_rows"] == 5


def test_the_sample_is_kept_before_the_shuffle(spark):
    rows = [(s, 0, f"{i}:1", i, f"L{i % 5}") for s, n in ((review.POSITIVE, 900), (review.PLANNED, 30), (review.OTHER, 3), ("unknown", 5)) for i in range(n)]
    cands = spark.createDataFrame(rows, "stratum string, assigned_label int, instance_id string, event_id long, entity string").repartition(6)
    sample = review.review_sample(cands, 40, strict=False)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Scan") == 1  # in tasks, then after the shuffle
    got = [(r.stratum, r.instance_id, r.entity) for r in sample.collect()]
    want = []
    for s, k in review.quotas(40).items():
        ranked = cands.filter(F.col("stratum") == s).withColumn("order_key", review.stable_rank(F.col("stratum"), F.col("instance_id"), F.col("entity")))
        want += [(r.stratum, r.instance_id, r.entity) for r in ranked.orderBy("order_key").limit(k).collect()]
    assert sorted(got) == sorted(want) and len(got) == 20 + 10 + 3


def test_fingerprints_match_a_plain_computation(spark):
    """XXH64 of the columns in turn, each seeded by the one before; nulls leave the seed as it is."""
    rows = [(1, "one", None), (2, "zwei é", 5), (-3, None, 7), (1 << 40, "", 0), (2, "zwei é", 5)]
    df = spark.createDataFrame(rows, "id long, t string, n int")

    def hashed(row):
        h = 42
        for value, size in zip(row, (8, 0, 4)):
            if value is not None:
                h = xxhash.xxh64(value.encode() if size == 0 else (value % (1 << 8 * size)).to_bytes(size, "little"), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    values = [hashed(r) for r in rows]
    xor = 0
    for v in values:
        xor ^= v
    got = df.agg(*up.fingerprint(df)).first()
    assert (got.n_rows, got.hash_xor, int(got.hash_sum)) == (5, xor, sum(values))
