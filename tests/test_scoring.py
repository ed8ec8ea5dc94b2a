"""The batch scorer asks what is open, once, and ends with an answer or a dead letter for each prompt."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import scoring

ROWS = [(i, f"prompt {i % 40}") for i in range(60)] + [(100, None), (101, "")]


def logged(folder):
    """Fails by the digest of prompt and attempt, at random as it were, and notes each call."""
    def scorer(prompt, attempt):
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{prompt}|{attempt}\n")
        if int(hashlib.md5(f"{prompt}{attempt}".encode()).hexdigest(), 16) % 3 == 0:
            raise OSError("busy")
        return None if prompt == "prompt 7" else prompt.upper()

    return scorer


def calls(folder):
    return sorted(line for f in os.listdir(folder) for line in open(f"{folder}/{f}").read().splitlines())


def expected(prompt):
    for attempt in (1, 2, 3):
        if int(hashlib.md5(f"{prompt}{attempt}".encode()).hexdigest(), 16) % 3:
            if prompt != "prompt 7":
                return attempt, prompt.upper(), "answered"
    return 3, None, "dead"


def test_a_second_run_asks_only_what_is_open(spark, tmp_path):
    path, log = f"file://{tmp_path}/outcomes", tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame(ROWS, "id long, prompt string").repartition(3)
    options = {"parallel": 2, "per_task": 8}
    assert scoring.score(prompts, logged(log), path, rounds=1, **options) == 1
    first = calls(log)
    assert len(first) == 16 and scoring.outcomes(spark, path).count() == 16
    assert scoring.answers(prompts, path).where("status is null").select("prompt").distinct().count() == 41 - 16 + 1
    scoring.score(prompts, logged(log), path, **options)
    every = calls(log)
    assert len(every) == len(set(every)) and sorted(set(first)) == first  # no attempt twice
    got = scoring.answers(prompts, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.prompt is None:
            assert r.status is None and r.attempts is None
        else:
            attempts, answer, status = expected(r.prompt)
            assert (r.attempts, r.answer, r.status) == (attempts, answer, status)
            assert (r.error is None) == (status == "answered")
    assert {r.error for r in got if r.prompt == "prompt 7"} <= {"no answer", "OSError: busy"}
    assert scoring.score(prompts, logged(log), path, **options) == 0 and calls(log) == every


def test_a_run_that_dies_loses_its_round_only(spark, tmp_path, monkeypatch):
    path, log = f"file://{tmp_path}/outcomes", tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame(ROWS, "id long, prompt string")
    scoring.score(prompts, logged(log), path, rounds=1, parallel=2, per_task=10)
    append = scoring.append_once
    monkeypatch.setattr(scoring, "append_once", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        scoring.score(prompts, logged(log), path, rounds=1, parallel=2, per_task=10)
    assert scoring.outcomes(spark, path).count() == 20
    monkeypatch.setattr(scoring, "append_once", append)
    scoring.score(prompts, logged(log), path, parallel=2, per_task=10)
    assert scoring.answers(prompts, path).where("prompt is not null and status not in ('answered', 'dead')").isEmpty()


def test_nothing_to_ask(spark, tmp_path):
    prompts = spark.createDataFrame([(1, None)], "id long, prompt string")
    path = f"file://{tmp_path}/outcomes"
    assert scoring.score(prompts, str, path) == 0 and scoring.answers(prompts, path).where(F.col("status").isNull()).count() == 1


def test_rounds_do_not_read_all_that_went_before(spark, tmp_path, monkeypatch):
    """What is open is looked for once a pass, and an append meets few of the files of the rounds before it."""
    from palimpsest.sources import appends

    looked, met = [], []
    outcomes, files = scoring.outcomes, appends.candidate_files
    monkeypatch.setattr(scoring, "outcomes", lambda *a: looked.append(1) or outcomes(*a))
    monkeypatch.setattr(appends, "candidate_files", lambda *a: met.append(len(f := files(*a))) or f)
    prompts = spark.createDataFrame([(f"prompt {i}",) for i in range(240)], "prompt string")
    assert scoring.score(prompts, lambda p, n: p, str(tmp_path / "o"), parallel=2, per_task=10) == 12
    stored = scoring.manifest(spark, str(tmp_path / "o")).groupBy("batch").agg({"n": "sum"}).collect()
    assert [r[1] for r in stored] == [20] * 12
    assert len(looked) == 2 and max(met) <= 4
    assert scoring.outcomes(spark, str(tmp_path / "o")).where("status = 'answered'").count() == 240
