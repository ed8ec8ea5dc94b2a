"""Forms that were made to scale give what their plain forms give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import causal, changes, shred, versions
from palimpsest.plans import stream_queries as Q
from palimpsest.sources.tables import shared_dir
from palimpsest.streaming import jobs as J


def test_name_match_equals_all_pairs(spark):
    r = random.Random(1)
    name = lambda: "".join(r.choices("abö", k=r.randint(0, 9)))
    store = [(r.choice("st"), r.choice("xy"), name(), i, None if i % 5 else "2024-02-01") for i in range(150)] + [("s", "x", None, 900, None)]
    wanted = [(r.choice("st"), r.choice("xy"), name()) for _ in range(60)] + [("s", "x", None), ("s", "x", "")]
    a = spark.createDataFrame(store, "session_id string, entry_type string, name string, entry_id long, valid_until string")
    b = spark.createDataFrame(wanted, "session_id string, entry_type string, name string")
    got = sorted((x.entry_id, x.wanted) for x in versions.fuzzy_match(a, b).collect())
    assert got == sorted({(i, w) for s, t, n, i, end in store for p, q, w in wanted if end is None and (s, t) == (p, q) and n is not None and w is not None and w in n})
    assert versions.fuzzy_match(a, b.limit(0)).count() == 0


def test_properties_equal_a_fold(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(['["x"]', '["y z"]', "k: v", "k:w", "a b:c", ":", "\n", " ", "é: ß ", "k:\n\n", '"']) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", shred.properties(F.col("t")).alias("p")).collect()
    for i, p in rows:
        want = {("primary_description" if n == 0 else f"attribute_{n}"): v for n, v in enumerate(re.findall(r'\["([^"]+)"\]', texts[i]))}
        want |= {k.strip(): v.strip() for k, v in re.findall(r"([^\s:]+):\s*([^\n]+)", texts[i])}
        assert p == want, texts[i]


def test_character_sets(spark):
    df = spark.createDataFrame([("abc", "bcd"), ("", ""), (None, "a"), ("漢字", "字")], "a string, b string")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(T.char_jaccard("a", "b")).collect()] == [0.5, 0.0, None, 0.5]


def entries(spark, rows):
    texts = spark.createDataFrame([(s, "\n\n".join(f'概念("{n}")["{c}"]' for n, c in items)) for s, items in rows], "session_id string, text string")
    return changes.first_of_id(shred.entries(texts))


def test_syncs_keep_all_versions(spark):
    r = random.Random(3)
    snapshots = [[("s", [(f"n{i}", r.choice("abc")) for i in range(12) if r.random() < 0.8])] for _ in range(4)]
    now = entries(spark, snapshots[0])
    store = versions.initial(now, "2024-01-01")
    for day, snapshot in enumerate(snapshots[1:], 2):
        new = entries(spark, snapshot)
        after = versions.sync(store, changes.change_feed(now, new), f"2024-01-0{day}")
        store = spark.createDataFrame(after.collect(), store.schema)
        now = new
    for day, snapshot in enumerate(snapshots, 1):
        active = versions.active(store, f"2024-01-0{day} 12:00:00")
        assert sorted((x.name, x.content) for x in active.collect()) == sorted((n, f'概念("{n}")["{c}"]') for n, c in snapshot[0][1])
    rows = store.collect()
    ids = {x.episode_id for x in rows}
    assert len(ids) == len(rows) and all(x.superseded_by in ids for x in rows if x.superseded_by)
    by = {}
    for x in rows:
        by.setdefault(x.entry_id, []).append(x.version)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_world_state_counts_on(spark):
    old, new = (entries(spark, [("s", [("a", "1"), ("b", c)]), *more]) for c, more in (("1", []), ("2", [("t", [("a", "1")])])))
    state = changes.world_state(old.withColumn("state_version", F.lit(4)), new)
    assert sorted((r.session_id, r.name, r.state_version) for r in state.collect()) == [("s", "a", 5), ("s", "b", 5), ("t", "a", 1)]
    assert {r.n_entries for r in changes.hash_index(state).collect()} == {1}


def test_trails_end_in_one_session(spark):
    found = spark.createDataFrame([("a", ["a", "b"]), ("a", ["a", "c"]), ("a", ["a", "gone"])], "start string, nodes array<string>")
    active = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "event_id string, group_id int")
    assert [r.nodes for r in causal.active_ends(found, active).collect()] == [["a", "b"]]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    full = entries(spark, [(f"s{i}", [("a", "1"), ("b", "1")]) for i in range(20)])
    part = entries(spark, [("s3", [("a", "2")])])
    at = str(tmp_path)
    job = lambda: J.run(J.sync_entries(Q._source(spark, f"{at}/in", full.schema), f"{at}/store", f"{at}/check"))
    Q._steps(f"{at}/in", job, full, part)
    before, after = J._manifest(spark, f"{at}/store", 0), J._manifest(spark, f"{at}/store", 1)
    assert set(before) == set(after) and len({b for b, n in after.items() if n == 1}) == 1
    rows = J.store(spark, f"{at}/store", 1).collect()
    assert len(rows) == 41 and sorted((r.entry_id, r.status, r.version) for r in rows if r.session_id == "s3") == [("concept:a", "active", 2), ("concept:a", "superseded", 1), ("concept:b", "deleted", 1)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
