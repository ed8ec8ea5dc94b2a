"""A request's parts from one projection, a context from columns, and change kinds that move no contents."""

from pyspark.sql import functions as F

from palimpsest.operators import changes, recall, shred

PROMPT = "<核心指导> be kind </核心指导><基础风格>short</基础风格><相关资料>地点(\"a\")[\"x\"]\n\n角色(\"b\")[\"y\"]</相关资料><互动历史>\nUser: one\nAssistant: two\n</互动历史><无关>z</无关><相关资料>more</相关资料>"


def test_parts_agree_with_the_tables(spark):
    rows = [("a", PROMPT), ("b", "User: alone\nAssistant: yes"), ("c", "only a note"), ("d", ""), ("e", None), ("f", PROMPT + "\nUser: tail"), ("g", PROMPT)]
    prompts = spark.createDataFrame(rows, "session_id string, prompt string")
    parts = {r.session_id: r for r in shred.request_parts(prompts).collect()}
    assert len(parts) == len(rows)
    for s, _ in rows:
        own = prompts.where(F.col("session_id") == s)
        first = own.transform(shred.instructions).orderBy("pos").collect()
        assert parts[s].instruction == (first[0].content if first else None)
        assert parts[s].reference == [r.body for r in shred.tagged(own).where("type = 'world_info'").orderBy("section").collect()]
        assert [(t.role, t.content) for t in parts[s].turns] == [(r.role, r.content) for r in shred.dialog_turns(own).orderBy("section", "pos").collect()]
        assert parts[s].n_narratives == shred.narratives(own).count()
    assert [len(parts[s].turns) for s in "abcdefg"] == [2, 2, 0, 0, 0, 3, 2]


def test_recalled_is_summary_and_count(spark):
    found = spark.createDataFrame([(1, 2, "b", 2), (1, 3, "a", 1), (2, 1, "c", 9)], "query_id int, memory_id int, fact string, rank int")
    assert sorted(map(tuple, recall.recalled(found).collect())) == [(1, "- a\n- b", 2), (2, "", 1)]


def test_a_context_without_parts_is_the_last_message(spark):
    row = spark.range(1).select(recall.messages(F.lit(None).cast("string"), F.array().cast(recall.MESSAGES), F.lit(None).cast("string"), F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("m")).first()
    assert [(m.role, m.content) for m in row.m] == [("user", "hi")]


def test_kinds_of_change_move_no_contents(spark):
    schema = "session_id string, entry_id string, entry_type string, name string, content string, content_hash string"
    old = spark.createDataFrame([("s", "a", "t", "n", "x", "1"), ("s", "b", "t", "n", "y", "2"), ("s", "c", None, None, None, None)], schema)
    new = spark.createDataFrame([("s", "a", "t", "n", "x", "1"), ("s", "b", "t", "m", "yz", "3"), ("s", "d", "t", "n", "w", "4"), ("s", "c", None, None, None, None)], schema)
    feed = changes.change_feed(old, new)
    plan = feed.groupBy("change").count()._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join FullOuter") :]
    assert "content_hash" in joined and "_old_content#" not in joined and "_new_content#" not in joined
    rows = {r.entry_id: r for r in feed.collect()}
    assert {k: r.change for k, r in rows.items()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "added"}
    assert rows["d"].old is None and rows["d"].new.content == "w" and rows["c"].old is not None and rows["c"].old.content is None
    assert (rows["b"].diff.name_changed, rows["b"].diff.content_changed, rows["b"].diff.change_percentage) == (True, True, 0.5) and rows["a"].diff.change_type is None
