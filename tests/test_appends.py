"""A retried or interrupted append leaves one copy, and reads few files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import appends


def some(spark, first, last):
    return spark.range(first, last).select(F.sha2(F.col("id").cast("string"), 256).alias("episode_id"), (F.col("id") * 3).alias("body"))


def ids(spark, path, schema):
    return sorted(r.body // 3 for r in appends.appended(spark, path, schema).collect())


def test_retries_leave_one_copy(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = some(spark, 0, 500)
    assert appends.append_once(rows, path, "a") == 500
    assert appends.append_once(rows, path, "a") == 0
    assert appends.append_once(some(spark, 300, 800), path, "b") == 300
    assert appends.append_once(some(spark, 0, 800), path, "c") == 0
    twice = some(spark, 790, 805).unionByName(some(spark, 790, 805)).unionByName(spark.createDataFrame([(None, 1)], rows.schema))
    assert appends.append_once(twice, path, "d") == 5
    assert ids(spark, path, rows.schema) == list(range(805))
    assert appends.append_once(rows.limit(0), path, "e") == 0 and appends.append_once(rows, path, "e") == 0


def test_a_batch_that_died_is_not_seen_and_is_taken_later(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    rows = some(spark, 0, 100)
    appends.append_once(rows, path, "a")
    more = some(spark, 50, 200)
    found = appends._stored_ids
    # Dies after some of its data is written: files without a manifest.
    some(spark, 100, 160).withColumn("_slot", appends._slot("episode_id")).write.parquet(f"{path}/data/batch=b")
    assert ids(spark, path, rows.schema) == list(range(100))
    # Dies before anything is written.
    monkeypatch.setattr(appends, "_stored_ids", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        appends.append_once(more, path, "b")
    monkeypatch.setattr(appends, "_stored_ids", found)
    assert appends.append_once(more, path, "b") == 100
    assert ids(spark, path, rows.schema) == list(range(200))


def test_few_rows_read_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = some(spark, 0, 20_000)
    for i in range(4):  # many files of each batch
        part = rows.where(F.col("body") / 3 % 4 == i)
        laid = part.withColumn("_slot", appends._slot("episode_id"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        try:
            assert appends.append_once(laid.drop("_slot"), path, f"b{i}") == 5000
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = appends.manifest(spark, path).count()
    assert files >= 40 and len(glob.glob(f"{tmp_path}/table/data/*/*.parquet")) >= files
    few = some(spark, 7, 10)
    read = appends.candidate_files(few, path, "episode_id")
    assert 4 <= len(read) <= 3 * 4 + 4 < files / 2
    stored = appends._stored_ids(few, path, "episode_id")
    assert sorted(os.path.basename(f) for f in stored.inputFiles()) == sorted(os.path.basename(f) for f in read)
    assert "PushedFilters: [In(episode_id" in stored._jdf.queryExecution().toString() and stored.count() == 3
    assert appends.append_once(some(spark, 19_998, 20_002), path, "late") == 2
