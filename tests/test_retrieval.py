"""The vector index, the graph leg and fused search against brute force."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import memory_graph, memory_index, recall

MEMORY = "memory_id long, group_id string, embedding array<float>"


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, 64))
    return [(i, "ab"[i % 2], [float(v) for v in row]) for i, row in enumerate(x)]


def test_index_finds_what_the_exact_way_finds(spark):
    odd = [(9000, "a", None), (9001, "a", [0.0] * 64), (9002, "b", [1.0] * 3), (9003, "b", [float("nan")] * 64), (9004, None, [1.0] * 64), (9005, "a", [1.0] * 63 + [None])]
    memories = spark.createDataFrame(clustered(1500, 1) + odd, MEMORY).repartition(4)
    queries = memories.where("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id")
    index = memory_index.build(memories)
    assert index.rows.count() == 1506 and index.rows.where("_list < 0").count() == 5
    for grouped in (True, False):
        own = memory_index.calibrated(index, grouped=grouped)
        assert own.probes < len(index.centroids) / 2 and own.radius < memory_index.BITS / 2
        total = memory_index.recall(own, queries, memories, grouped=grouped).agg(F.sum("n_true"), F.sum("n_found"), F.sum("n_scored"), F.sum("n_memories")).first()
        assert total[1] >= 0.9 * total[0] and 5 * total[2] <= total[3]
    found = memory_index.search(index, queries, grouped=False)  # not calibrated: all lists, all signatures
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in memory_index.exact(queries, memories, grouped=False).where("query_id < 9000").collect()}
    assert not {9000, 9001, 9002, 9003, 9005} & {r[0] for r in found.select("memory_id").collect()} and found.where("query_id = memory_id").count() == 0


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], MEMORY)
    index = memory_index.calibrated(memory_index.build(none))
    assert index.rows.count() == 0 and memory_index.search(index, none.withColumnRenamed("memory_id", "query_id")).count() == 0


def test_index_on_the_tables(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    from palimpsest.plans.recall_queries import o_r1_index_recall

    total = o_r1_index_recall(spark, path).agg(F.count("*"), F.sum("n_true"), F.sum("n_found"), F.sum("n_scored"), F.sum("n_memories")).first()
    assert total[0] == 40 and total[2] >= 0.9 * total[1] and 5 * total[3] <= total[4]


def brute_walk(starts, mentions, visits, restart):
    graph = {m for m in mentions if None not in m}
    of_entity, of_memory = collections.defaultdict(list), collections.defaultdict(list)
    for m, g, e in graph:
        of_entity[g, e].append((m, g))
        of_memory[m, g].append((g, e))
    out = {}
    for q, g in {(q, g) for q, g, _ in starts}:
        own = sorted({(g2, e) for q2, g2, e in starts if q2 == q and (g2, e) in of_entity})
        first = {e: 1 / len(own) for e in own}
        here = dict(first)
        for visit in range(visits):
            if visit:
                back = {e: restart * p for e, p in first.items()}
                for m, p in at.items():
                    for e in of_memory[m]:
                        back[e] = back.get(e, 0) + (1 - restart) * p / len(of_memory[m])
                here = back
            at = collections.defaultdict(float)
            for e, p in here.items():
                for m in of_entity[e]:
                    at[m] += p / len(of_entity[e])
        out |= {(q, m): p for (m, _), p in at.items() if m != q}
    return out


@pytest.mark.parametrize("visits", [1, 2, 3])
def test_walks(spark, visits):
    rng = random.Random(visits)
    mentions = [(m, "xy"[m % 2], rng.choice(["hub"] * 5 + list("abcdefgh"))) for m in range(40) for _ in range(3)] + [(None, "x", "a"), (50, None, "a"), (51, "x", None), (1, "y", "a"), (1, "y", "a")]
    starts = [(0, "x", "hub"), (0, "x", "a"), (0, "x", "a"), (7, "y", "b"), (100, "x", "nowhere"), (101, None, "a"), (102, "x", "c")]
    got = memory_graph.walk(spark.createDataFrame(starts, "query_id long, group_id string, entity string"), spark.createDataFrame(mentions, "memory_id long, group_id string, entity string"), visits=visits, split=4).collect()
    expected = brute_walk(starts, mentions, visits, 0.3)
    assert {(r.query_id, r.memory_id): pytest.approx(r.mass, abs=1e-9) for r in got} == expected
    none = spark.createDataFrame([], "memory_id long, group_id string, entity string")
    assert memory_graph.walk(none.withColumnRenamed("memory_id", "query_id"), none, visits=visits).count() == 0


@pytest.mark.parametrize("visits", [1, 2, 3])
def test_best_of_walks(spark, visits, monkeypatch):
    monkeypatch.setattr(memory_graph, "LEAST", 3)
    monkeypatch.setattr(memory_graph, "WORDS", 4)
    rng = random.Random(visits)
    mentions = [(m, "xy"[m % 2], rng.choice(["hub"] * 9 + [f"n{i}" for i in range(30)])) for m in range(200) for _ in range(4)] + [(None, "x", "a"), (50, None, "a"), (51, "x", None), (1, "y", "hub"), (1, "y", "hub")]
    starts = [(q, "xy"[q % 2], rng.choice(["hub", "n1", "n2", "nowhere"])) for q in range(0, 60, 2) for _ in range(3)] + [(7, "y", "hub"), (7, "x", "n3"), (300, "x", "nowhere"), (301, None, "hub"), (302, "z", "hub")]
    asked, named = (spark.createDataFrame(x, f"{id} long, group_id string, entity string") for x, id in ((starts, "query_id"), (mentions, "memory_id")))
    shown = lambda df: {(r.query_id, r["rank"]): (r.memory_id, pytest.approx(r.mass, abs=1e-11)) for r in df.collect()}
    assert shown(memory_graph.best(asked, named, 15, visits, cells=1)) == shown(memory_graph.leg(memory_graph.walk(asked, named, visits), 15))
    none = named.limit(0)
    assert memory_graph.best(none.withColumnRenamed("memory_id", "query_id"), none, 5, visits).count() == 0 and memory_graph.best(asked, none, 5).count() == 0


def test_best_of_walks_makes_no_row_for_a_pair(spark, monkeypatch):
    counts = []
    write = memory_graph.written
    monkeypatch.setattr(memory_graph, "written", lambda df, name: counts.append(write(df, name).count()) or write(df, name))
    n = 600
    named = spark.createDataFrame([(m, "x", e) for m in range(n) for e in ("hub", f"n{m % 7}")], "memory_id long, group_id string, entity string")
    asked = named.where("memory_id % 5 = 0").withColumnRenamed("memory_id", "query_id")
    assert memory_graph.best(asked, named, 5).count() == 5 * n // 5 and max(counts) <= n  # pairs: n * n / 5


def test_fused(spark):
    legs = spark.createDataFrame([(1, 10, "cosine", 1), (1, 10, "graph", 3), (1, 11, "cosine", 2), (1, 12, "lexical", 1), (1, 12, "graph", 1), (2, 5, "graph", 1)], "query_id long, memory_id long, leg string, rank int")
    got = [(r.query_id, r.memory_id, r.n_legs, r["rank"]) for r in recall.fused(legs, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 12, 2, 1), (1, 10, 2, 2), (2, 5, 1, 1)]


def test_search_of_all_groups(spark):
    rows = [(i, g, f"word{i % 3} text", [float(i % 4), 1.0, -1.0]) for i, g in enumerate("aabbc")]
    memories = spark.createDataFrame(rows, "memory_id long, group_id string, fact string, embedding array<float>").withColumn("created_at", F.lit("now"))
    queries = memories.select(F.col("memory_id").alias("query_id"), "group_id", F.col("fact").alias("query"), "embedding")
    found = recall.search(queries, memories, grouped=False, also=("created_at",)).collect()
    assert len(found) == 20 and {r.created_at for r in found} == {"now"} and all(r.query_id != r.memory_id for r in found)
    assert {(r.query_id, r.memory_id) for r in recall.search(queries, memories).collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
