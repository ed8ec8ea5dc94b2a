"""Steps of a stream keep their partitions and lose no row."""

from palimpsest import registry
from palimpsest.plans import stream_queries as S


def test_a_step_keeps_its_partitions_and_is_one_batch(spark, tmp_path):
    seen, step = [], spark.range(60, numPartitions=3)
    job = lambda: S.J.run(S._source(spark, f"{tmp_path}/in", step.schema).writeStream.foreachBatch(lambda b, n: seen.append((n, b.count()))).option("checkpointLocation", f"{tmp_path}/check"))
    S._steps(f"{tmp_path}/in", job, step, step)
    assert seen == [(0, 60), (1, 60)] and len(list((tmp_path / "in").glob("part-*.parquet"))) == 6


def test_counters_keep_null_and_negative_ids(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (-3, 0, "user", "b"), (-3, 1, "assistant", "c"), (2, 0, "user", "d"), (5, 0, "user", "e")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, registry.queries()["o_t6_live_counters"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, 1, 1), (-3, 2, 2), (2, 1, 1), (5, 1, 1)], key=str)
