"""As-of and interval joins and rolling coherence against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import states, temporal

BASE = datetime.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else BASE + datetime.timedelta(hours=hours)


def test_as_of(spark):
    rng = random.Random(1)
    keys = ["hot"] * 6 + ["b", "c", None]
    known = [(rng.choice(keys), at(rng.choice([None, *range(0, 300)] if rng.random() < 0.1 else range(0, 300))), f"s{i}", {"joy": float(i)}) for i in range(400)]
    asked = [(i, rng.choice([*keys, "nobody"]), at(rng.choice([*range(-5, 310), None]))) for i in range(500)] + [(0, "hot", at(50)), (0, "hot", at(50))]
    states_ = spark.createDataFrame(known, "character_id string, observed_at timestamp, state_id string, emotions map<string,double>").repartition(3)
    requests = spark.createDataFrame(asked, "request_id long, character_id string, requested_at timestamp").repartition(3)
    for tasks in (1, 13):
        got = temporal.as_of(requests, states_, tasks=tasks).select("request_id", "character_id", "requested_at", "state.state_id").collect()

        def expected(key, when):
            own = [(t, s) for k, t, s, _ in known if k is not None and k == key and t is not None and when is not None and t <= when]
            return max(own)[1] if own else None

        assert sorted(map(repr, got)) == sorted(repr(spark_row) for spark_row in [type(got[0])(request_id=i, character_id=k, requested_at=t, state_id=expected(k, t)) for i, k, t in asked])


def test_as_of_cuts_hot_keys(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("character_id"), F.timestamp_seconds(F.col("id") * 60).alias("requested_at"), "id")
    state = spark.createDataFrame([("hot", datetime.datetime(1970, 1, 1), "s")], "character_id string, observed_at timestamp, state_id string")
    ranges = temporal.in_ranges(rows, "character_id", "requested_at", tasks=10).groupBy("_range").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) <= 600
    assert temporal.as_of(rows, state, tasks=10).where("state.state_id = 's'").count() == 2000


def test_as_of_of_nothing(spark):
    state = "character_id string, observed_at timestamp, state_id string"
    request = "character_id string, requested_at timestamp"
    one = [("a", BASE)]
    assert temporal.as_of(spark.createDataFrame([], request), spark.createDataFrame([], state)).count() == 0
    assert [r.state for r in temporal.as_of(spark.createDataFrame(one, request), spark.createDataFrame([], state)).collect()] == [None]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_holding(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), at(rng.choice([*range(0, 700), None]))) for i in range(300)]
    spans = []
    for i in range(200):
        since = rng.choice([*range(-100, 800), None])
        until = rng.choice([None, -50, since, (since or 0) - 5, (since or 0) + 1, (since or 0) + rng.randint(1, 900)])
        spans.append((i, rng.choice(["x", "x", "y", "z", None]), at(since), at(until)))
    left = spark.createDataFrame(rows, "row_id long, key string, ts timestamp").repartition(3)
    right = spark.createDataFrame(spans, "span_id long, key string, valid_from timestamp, valid_until timestamp").repartition(3)
    holds = lambda t, s, u: t is not None and s is not None and s <= t and (u is None or t < u)
    got = sorted(tuple(r) for r in temporal.holding(left, right, ["key"], "ts", levels=levels).select("row_id", "span_id").collect())
    assert got == sorted((i, j) for i, k, t in rows for j, k2, s, u in spans if k is not None and k == k2 and holds(t, s, u))
    free = sorted(tuple(r) for r in temporal.holding(left.drop("key"), right.drop("key"), [], "ts", levels=levels).select("row_id", "span_id").collect())
    assert free == sorted((i, j) for i, _, t in rows for j, _, s, u in spans if holds(t, s, u))


def test_open_intervals_are_few_rows(spark):
    rows = spark.range(5000).select("id", F.timestamp_seconds(F.col("id") * 977).alias("ts"))
    spans = spark.range(50).select(F.col("id").alias("span"), F.timestamp_seconds(F.col("id") * 1000).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    pieces = spans.select(F.lit(3).cast("long").alias("_lo"), F.lit(4095).cast("long").alias("_hi")).select(F.size(temporal._pieces(4)).alias("n")).first()
    assert pieces.n <= 2 + 14 * 5
    met = temporal.holding(rows, spans, [], "ts")
    assert met.count() == rows.crossJoin(spans).where("valid_from <= ts").count()


def test_intervals_are_written_whole_and_dealt_out(spark, monkeypatch):
    """One written row for each interval that can meet a row, in several files, however many bins it is cut into."""
    tables = []
    monkeypatch.setattr(temporal, "written", lambda df, name, write=temporal.written: tables.append(write(df, name)) or tables[-1])
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.col("id") * 977).alias("ts"))
    spans = spark.range(0, 400, 1, 1).select(F.col("id").alias("span"), F.timestamp_seconds(F.col("id") * 1000).alias("valid_from"), F.timestamp_seconds(F.col("id") * 1000 + 700_001).alias("valid_until"))
    assert temporal.holding(rows, spans, [], "ts").count() == rows.join(spans, F.expr("valid_from <= ts and ts < valid_until")).count()
    assert sum(t.count() for t in tables) == 400
    assert tables[0].select(F.input_file_name()).distinct().count() > 1


def test_intervals_cut_into_bins_are_not_broadcast(spark):
    """The written table of intervals is small enough for Spark's default limit; the rows that each of them is cut into are not measured."""
    rows = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 977).alias("ts"))
    spans = spark.range(100).select(F.col("id").alias("span"), F.timestamp_seconds(F.col("id") * 1000).alias("valid_from"), F.timestamp_seconds(F.col("id") * 1000 + 300_001).alias("valid_until"))
    met = temporal.holding(rows, spans, [], "ts")
    assert len(met.collect()) == rows.join(spans, F.expr("valid_from <= ts and ts < valid_until")).count()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("levels", [1, 2])
def test_whole_bins_are_those_between_the_ends(spark, levels):
    n = 8**levels
    ends = spark.range(n).select(F.col("id").alias("_lo")).crossJoin(spark.range(n).select(F.col("id").alias("_hi"))).where("_lo <= _hi")
    for lo, hi, pieces in ends.select("_lo", "_hi", temporal._pieces(levels)).collect():
        bins = [b for p in pieces for level, at in [(p % temporal.STRIDE, p // temporal.STRIDE)] for b in range(at << 3 * level, (at + 1) << 3 * level)]
        assert sorted(bins) == list(range(lo + 1, hi)) and len(pieces) <= 14 * (levels + 1)


def test_interval_joins_of_nothing(spark):
    rows, spans = spark.createDataFrame([], "row_id long, ts timestamp"), spark.createDataFrame([], "span_id long, valid_from timestamp, valid_until timestamp")
    assert temporal.holding(rows, spans, [], "ts").count() == 0
    assert temporal.holding(spark.createDataFrame([(1, BASE)], rows.schema), spans, [], "ts").count() == 0
    assert temporal.holding(rows, spark.createDataFrame([(1, BASE, None)], spans.schema), [], "ts").count() == 0


def some_states(spark, seed):
    rng = random.Random(seed)
    out = []
    for who in ("a", "a", "a", "b", "c"):
        for _ in range(40):
            names = rng.sample(["joy", "calm", "anxious"], rng.randint(0, 3))
            out.append((who, f"s{len(out):04d}", at(24 * rng.randint(0, 90) + rng.choice([0, 5])), {"e1": rng.random(), "e2": rng.random()}, {n: rng.random() for n in names}, rng.choice(["x", None]), rng.random(), rng.random(), 0.5))
    out.append(("d", "alone", at(3), {}, {}, None, 0.5, 0.5, 0.5))
    return out, spark.createDataFrame(out, "character_id string, state_id string, observed_at timestamp, emotions map<string,double>, traits map<string,double>, dominant string, stability double, intensity double, arousal double").repartition(3)


@pytest.mark.parametrize("span", [7, 28, 1000])
def test_rolling_coherence_is_that_of_each_time(spark, span):
    rows, table = some_states(spark, span)
    names = ("n_states", "trait_consistency", "emotional_rationality", "behavioral_consistency", "memory_rationality", "overall")
    got = {r.state_id: r for r in states.rolling_coherence(table, span=span).collect()}
    assert len(got) == len(rows)
    for state_id in random.Random(span).sample(sorted(got), 6):
        who, when = got[state_id].character_id, got[state_id].observed_at
        (one,) = states.coherence(table.where(F.col("character_id") == who), str(when), limit=10_000).collect()
        assert [one[c] for c in names] == pytest.approx([got[state_id][c] for c in names], abs=1e-9)


def test_states_that_are_no_longer_valid_are_left_out(spark):
    rows = spark.createDataFrame([("a", at(1), None), ("a", at(2), at(3)), ("a", at(3), at(500))], "character_id string, observed_at timestamp, valid_until timestamp")
    assert states.look_back(rows, str(at(10))).count() == 2
    assert states.look_back(rows.drop("valid_until"), str(at(10))).count() == 3


def test_counts_of_what_intervals_hold(spark):
    """Against all pairs: equal times, ends at a row, open, empty and turned intervals, repeated ids, one key in all ranges."""
    r = random.Random(9)
    at = lambda: r.choice([None, *range(12)]) if r.random() < 0.3 else r.randrange(1000)
    stamp = lambda t: None if t is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t)
    events = [(r.choice("aaaabc") if i % 20 else None, at()) for i in range(600)]
    spans = [(r.choice("aaaabd") if i % 20 else None, i // 2, at(), at()) for i in range(200)]
    rows = spark.createDataFrame([(k, stamp(t)) for k, t in events], "k string, ts timestamp")
    intervals = spark.createDataFrame([(k, i, stamp(s), stamp(e)) for k, i, s, e in spans], "k string, id int, valid_from timestamp, valid_until timestamp")
    want = {}
    for k, i, s, e in spans:
        mine = [t for j, t in events if k is not None and j == k and None not in (t, s) and s <= t and (e is None or t < e)]
        want.setdefault(i, []).extend(mine)
    want = {i: (len(v), stamp(min(v, default=None))) for i, v in want.items()}
    for tasks in (1, 7):
        assert {x.id: (x.n, x.first) for x in temporal.held(rows, intervals, ["k"], "ts", ["id"], tasks=tasks).collect()} == want
