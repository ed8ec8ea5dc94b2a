"""A resumable batch scorer: prompts are sent to a model, their answers kept in a table, and only what is open is asked.

A prompt is known by its digest, so equal prompts are asked once, whoever sends them. Prompts without an answer are
dealt into rounds, all that are open at once (a pass), and asked round by round; a round is one job of at most `parallel` tasks, each asking one prompt at a time, which bounds the calls
that run at once, and is committed when it ends. A run that dies loses the round it was in and no other. A prompt whose call
raises is open again, in a later round of the same run or in another run; after `max_attempts` it is a dead letter,
with the last error.

The table of outcomes takes each attempt once (`sources.appends`): (outcome_id, digest, attempt, answer, error, status), where
status is answered, failed or dead. A lost task makes Spark call the scorer again for the prompts of that task; their
outcomes are written once all the same.

Bounds: a round holds `parallel` times `per_task` prompts. Null prompts are not asked and have no answer; an empty text is a
prompt like others; a scorer that gives None has failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources.appends import _slot, append_once, appended, manifest
from palimpsest.sources.tables import written

ANSWERED, FAILED, DEAD = "answered", "failed", "dead"
OUTCOME = "outcome_id string, digest string, attempt int, answer string, error string, status string"


def digest(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt at each prompt."""
    rows = appended(spark, path, spark.createDataFrame([], OUTCOME).schema)
    last = F.max_by(F.struct("answer", "error", "status"), "attempt").alias("_last")
    return rows.groupBy("digest").agg(F.max("attempt").alias("attempts"), last).select("digest", "attempts", "_last.*")


def _asked(scorer: Callable[[str, int], str | None], max_attempts: int):
    names = [c.split()[0] for c in OUTCOME.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, prompt, before in zip(*(b.column(c).to_pylist() for c in ("digest", "prompt", "attempts"))):
                answer = error = None
                try:
                    answer = scorer(prompt, before + 1)
                    error = None if answer is not None else "no answer"
                except Exception as e:  # whatever a model's client raises is this prompt's own failure
                    error = f"{type(e).__name__}: {e}"
                status = ANSWERED if error is None else DEAD if before + 1 >= max_attempts else FAILED
                rows.append((f"{key}:{before + 1}", key, before + 1, answer, error, status))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def score(prompts: DataFrame, scorer: Callable[[str, int], str | None], path: str, prompt: str = "prompt", parallel: int = 8, per_task: int = 1000, max_attempts: int = 3, rounds: int | None = None) -> int:
    """Asks scorer(prompt, attempt) for all prompts that have no answer and are no dead letters, until none is open or
    `rounds` are over; the number of rounds that ran."""
    spark = prompts.sparkSession
    texts = written(prompts.where(F.col(prompt).isNotNull()).select(digest(F.col(prompt)).alias("digest"), F.col(prompt).cast("string").alias("prompt")).dropDuplicates(["digest"]), "prompts")
    ran = 0
    while rounds is None or ran < rounds:
        # A pass starts from what is committed and deals what is open into rounds: prompts asked the fewest times come first.
        open_ = texts.select("digest").join(outcomes(spark, path).select("digest", "attempts", "status"), "digest", "left").where(F.col("status").isNull() | (F.col("status") == FAILED))
        dealt = _dealt(open_.select("digest", F.coalesce("attempts", F.lit(0)).alias("attempts")), parallel * per_task, None if rounds is None else rounds - ran)
        chosen = written(texts.join(dealt, "digest").repartition("_round"), "rounds", ("_round",))
        numbers = sorted(r[0] for r in dealt.select("_round").distinct().collect())  # a row for each round
        if not numbers:
            break
        first = manifest(spark, path).select("batch").distinct().count()
        for n in numbers:
            asked = chosen.where(F.col("_round") == n).drop("_round").repartition(parallel, "digest").mapInArrow(_asked(scorer, max_attempts), OUTCOME)
            append_once(written(asked, "outcomes"), path, f"round-{first + n:08d}", "outcome_id")
            ran += 1
    return ran


def _dealt(open_: DataFrame, size: int, most: int | None) -> DataFrame:
    """(digest, attempts, _round) of the first `most` rounds of `size` prompts, by attempts and then by the slot of the outcome, so
    what a round appends meets few files of the table. Places are counted within slots; how many prompts are in the slots
    before is one number for each slot and attempt."""
    rows = written(open_.withColumn("outcome_id", F.concat("digest", F.lit(":"), (F.col("attempts") + 1).cast("string"))).withColumn("_slot", _slot("outcome_id")).drop("outcome_id"), "open")
    counts = rows.groupBy("attempts", "_slot").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("attempts", "_slot")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("attempts", "_slot").orderBy("digest")) - 1
    found = rows.withColumn("_place", place).join(counts.drop("n"), ["attempts", "_slot"])
    found = found.select("digest", "attempts", F.floor((F.col("_before") + F.col("_place")) / size).cast("int").alias("_round"))
    return written(found if most is None else found.where(F.col("_round") < most), "dealt")


def answers(prompts: DataFrame, path: str, prompt: str = "prompt") -> DataFrame:
    """prompts with attempts, answer, error and status; status is null for a prompt that has not been asked."""
    found = outcomes(prompts.sparkSession, path).withColumnRenamed("digest", "_digest")
    return prompts.join(found, digest(F.col(prompt)) == F.col("_digest"), "left").drop("_digest")
