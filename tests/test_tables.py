"""Tables that are written and read back are stored densely."""

from palimpsest.sources.appends import append_once, manifest
from palimpsest.sources.tables import written


def test_written_parquet_is_dense(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id as string) episode_id")
    assert all(f.endswith(".zstd.parquet") for f in written(rows, "dense").inputFiles())
    append_once(rows, f"file://{tmp_path}/t", "one")
    files = [r.file for r in manifest(spark, f"file://{tmp_path}/t").collect()]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert written(rows, "plain", kind="json").count() == 10
