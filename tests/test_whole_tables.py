"""Queries read whole tables, also where the given ones lack the hard cases."""

import hashlib
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import registry
from palimpsest.functions import text as T
from palimpsest.operators import recall
from tests.test_registry import SF


def test_ranks_equal_brute_force(spark, monkeypatch):
    """Groups beyond the ranks that are read off, equal vectors and texts, null vectors and blocks of queries."""
    monkeypatch.setattr(recall, "BLOCK_QUERIES", 3)
    r = random.Random(7)
    cells = [(i, i % 7 // 6, " ".join(r.choices("abcdefgh", k=r.randint(0, 6))), r.choice([[1.0, 0.0], [0.0, 0.0], [r.random(), r.random() - 0.5]])) for i in range(1500)]
    rows = spark.createDataFrame(cells, "memory_id long, group_id long, fact string, embedding array<float>").repartition(5)
    queries = rows.where("memory_id % 150 = 0").withColumnsRenamed({"memory_id": "query_id", "fact": "query"})
    got = {}
    for x in recall.search(queries, rows, k=4).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.memory_id))
    pairs = reduce(DataFrame.unionByName, recall.pairs(queries, rows))
    pairs = pairs.select("query_id", "memory_id", F.round(recall.cosine(F.col("_q"), F.col("_m")), 9).alias("c"), F.round(T.set_jaccard(F.col("_x"), F.col("_y")), 9).alias("l")).collect()
    assert len(pairs) == sum(g == h for i, g, _, _ in cells if i % 150 == 0 for j, h, _, _ in cells if i != j)
    for q in {p.query_id for p in pairs}:
        own = [p for p in pairs if p.query_id == q]
        a = {p.memory_id: n for n, p in enumerate(sorted(own, key=lambda p: (p.c is None, -(p.c or 0), p.memory_id)), 1)}
        b = {p.memory_id: n for n, p in enumerate(sorted(own, key=lambda p: (-p.l, p.memory_id)), 1)}
        best = sorted(a, key=lambda m: (-round(1 / (60 + a[m]) + 1 / (60 + b[m]), 9), m))[:4]
        assert sorted(got[q]) == list(enumerate(best, 1))
    assert len(got) == 10


def test_windows_of_later_dates_are_closed(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts") + F.expr("interval 400 days")).write.parquet(f"{tmp_path}/events.parquet")
    name = "o_t7_windowed_coherence"
    assert registry.queries()[name](spark, str(tmp_path)).count() == registry.queries()[name](spark, SF).count() > 0


def test_hashes_of_documents_with_blank_lines(spark, tmp_path):
    texts = {1: "a\n\n\nb", 2: "a\n\nb", 3: "\n\n\n\n# t\n\n\n\n- x：\n", 4: None, 5: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    punct = {i: md5(t) for i, t in {1: "a\n\nb", 2: "a\n\nb", 3: "# t\n\n- x:", 4: "", 5: "plain"}.items()}
    ws = {i: md5(" ".join((t or "").split())) for i, t in texts.items()}
    marks = {i: md5(t) for i, t in {1: "text\n\n\ntext", 2: "text\n\ntext", 3: "\n\n\n\n#\n\n\n\n-\n", 4: "", 5: "text"}.items()}
    get = lambda name: {r.doc_id: tuple(r)[1:] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert get("o_c4_content_hash") == {i: (punct[i], ws[i]) for i in texts}
    assert get("o_c5_multi_hash") == {i: (punct[i], marks[i]) for i in texts}
