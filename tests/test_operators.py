"""Hand-worked cases and properties of the conversational-memory operators."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import causal, changes, quality, shred, states, versions
from palimpsest.streaming.jobs import classify

FULL = '<核心指导>\n你是助手\n</核心指导>\n<相关资料>\n地点("北港")["城市"]\n地点("石桥")["办公室"]\n角色("小林")["学生"]\n角色("阿禾")["会计"]\n</相关资料>\n<互动历史>\nUser: 你好\nAssistant: 您好\nUser: 走吗\nAssistant: 走吧\n</互动历史>'


@pytest.mark.parametrize("prompt,expected", [
    ("", (0, 0, 0)), ("just a sentence", (0, 1, 0)), (FULL, (1, 1, 4)), ("<|User|>hi\n{{user}} there", (0, 1, 0)), ("<核心指导>never closed", (0, 1, 0)),
    ("<核心指导>a</核心指导>\nparagraph\nUser: x\nAssistant: y", (1, 0, 2)), ("<相关资料><核心指导>内容</核心指导></相关资料>", (0, 1, 0)), ("<未知>x</未知>", (0, 0, 0)),
])
def test_shred_counts(spark, prompt, expected):
    row = shred.shredded(spark.createDataFrame([(1, prompt)], "session_id long, prompt string")).first()
    assert (row.n_instructions, row.n_narratives, row.n_turns) == expected and row.original_length == len(prompt)


def test_shred_details(spark):
    df = spark.createDataFrame([(1, FULL), (2, "plain")], "session_id long, prompt string")
    first, second = shred.narratives(df).orderBy("session_id").collect()
    assert first.metadata["location"] == '"北港"' and first.confidence == 1.0
    assert (second.content, second.block_type, second.confidence) == ("plain", "general", 0.8)
    assert shred.instructions(df).first().priority == 0
    nested = spark.createDataFrame([(1, "<相关资料><核心指导>内容</核心指导></相关资料>")], "session_id long, prompt string")
    assert shred.narratives(nested).first().content == "<核心指导>内容</核心指导>"
    two = spark.createDataFrame([(1, "<相关资料>a\n\n \nb</相关资料>")], "session_id long, prompt string")
    assert [r.content for r in shred.narratives(two).orderBy("block").collect()] == ["a", "b"]


def entries(spark, text):
    return shred.entries(spark.createDataFrame([("s", text)], "session_id string, text string"))


def test_entries_and_properties(spark):
    row = entries(spark, '地点("石桥")["办公室"]["大"]\nkey: a\nkey: b').first()
    assert (row.entry_type, row.name, row.entry_id) == ("location", "石桥", "location:石桥")
    assert row.properties == {"primary_description": "办公室", "attribute_1": "大", "key": "b"}
    assert entries(spark, "Character_Profile_of: 小林\nx").first().source == "character_profile"
    assert entries(spark, "some line\nmore").first().name == "some line"
    assert entries(spark, "").count() == 0


@pytest.mark.parametrize("old,new,expected", [
    ('地点("a")["x"]', "", {"removed": 1}), ("", '地点("a")["x"]', {"added": 1}), ('地点("石桥")["旧"]', '地点("石桥")["新的描述"]', {"modified": 1}), ('地点("a")["x"]', '地点("a")["x"]', {"unchanged": 1}),
])
def test_change_feed(spark, old, new, expected):
    feed = changes.change_feed(entries(spark, old), entries(spark, new))
    assert {r.change: r["count"] for r in feed.groupBy("change").count().collect()} == expected


def test_store_keeps_every_version_and_reads_as_of(spark):
    old, new = (entries(spark, t) for t in ('地点("a")["1"]\n\n地点("b")["1"]\n\n地点("c")["1"]', '地点("a")["1"]\n\n地点("b")["2"]\n\n地点("d")["1"]'))
    store = versions.initial(old, "2024-01-01")
    after = versions.sync(store, changes.change_feed(old, new), "2024-02-01")
    hashes = lambda df: sorted(r.content_hash for r in df.select("content_hash").collect())
    assert hashes(versions.active(after, "2024-01-15")) == hashes(old) and hashes(versions.active(after, "2024-03-01")) == hashes(new)
    assert after.count() == 5 and after.where("superseded_by is not null").count() == 1


@pytest.mark.parametrize("old,new,expected", [
    ([], ["a"] * 4, ("append", 0)), (["a"], ["a"], ("no_change", None)), (["a", "b"], ["x", "b"], ("modification", 0)), (["a"], ["a", "b"], ("append", 1)),
    (["a", "b"], ["a"], ("truncation", 1)), (["a", "b"], [], ("truncation", 0)), (["a", "b"], ["a", "c"], ("modification", 1)), (["a", "b"], ["a", "c", "d"], ("modification", 1)),
])
def test_chat_change(spark, old, new, expected):
    df = spark.createDataFrame([(old, new)], "o array<string>, n array<string>")
    columns = changes.chat_change(F.col("o"), F.col("n"))
    row = df.select(columns["change"].alias("c"), columns["diff_index"].alias("d")).first()
    assert (row.c, row.d) == expected == classify(old, new)


def state(cid, sid, emotions, traits, stability, dominant="joy", intensity=0.6):
    return (cid, sid, f"2024-01-0{sid} 00:00:00", emotions, traits, dominant, stability, intensity, 0.5)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "character_id long, state_id string, observed_at string, emotions map<string,double>, traits map<string,double>, dominant string, stability double, intensity double, arousal double")
    return df.withColumn("observed_at", F.to_timestamp("observed_at"))


@pytest.mark.parametrize("a,b,kind,score", [
    (({"joy": 0.6}, 0.8), ({"joy": 0.6}, 0.8), "stable", 1.0), (({"joy": 0.6}, 0.9), ({"joy": 0.7}, 0.5), "sudden_shift", 0.8), (({"joy": 0.6}, 0.7), ({"joy": 0.7}, 0.5), "gradual_change", 1.0),
    (({"joy": 0.6}, 0.7), ({"joy": 0.7}, 0.75), "evolution", 1.0), (({"joy": 0.1}, 0.9), ({"joy": 0.8}, 0.4), "sudden_shift", 0.3),
])
def test_transitions(spark, a, b, kind, score):
    row = states.transitions(frame(spark, [state(1, "1", a[0], {}, a[1]), state(1, "2", b[0], {}, b[1])]), digits=6).first()
    assert row.transition_type == kind and round(row.rationality_score, 6) == score


def test_coherence_formulas(spark):
    strengths = [0.2, 0.4, 0.6, 0.8, 1.0]
    df = frame(spark, [state(1, str(i + 1), {"joy": 0.6}, {"t": s}, 0.7 + 0.05 * i) for i, s in enumerate(strengths)])
    assert round(states.trait_consistency(df).first().trait_consistency, 6) == 0.84
    jump = frame(spark, [state(1, "1", {"joy": 0.6}, {}, 0.8), state(1, "2", {"anger": 0.9}, {}, 0.8)])
    assert states.emotion_rationality(jump, 6).first().emotional_rationality == 0.4
    one = states.coherence(frame(spark, [state(1, "1", {}, {}, 0.1)]), "2024-01-05").first()
    assert one.overall == one.trait_consistency == 1.0
    assert states.history(df, 2).count() == 2


def test_trails_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "a", 0.9), ("a", "c", 0.4)], "src string, dst string, strength double")
    edges = edges.withColumns({"relation_type": F.lit("causes"), "conditions": F.array().cast("array<string>"), "exceptions": F.array().cast("array<string>")})
    starts = spark.createDataFrame([("a",)], "start string")
    assert sorted("".join(r.nodes) for r in causal.trails(edges, starts).collect()) == ["ab", "abc", "abca"]
    forward = {tuple(r.nodes) for r in causal.trails(edges, edges.select(F.col("src").alias("start")).distinct(), 3).collect()}
    backward = {tuple(reversed(r.nodes)) for r in causal.trails(edges, edges.select(F.col("dst").alias("start")).distinct(), 3, backward=True).collect()}
    assert forward == backward


@pytest.mark.parametrize("conditions,scenario,met", [([], {}, True), (["角色:小林"], {"character_小林": "x"}, False), (["角色 小林"], {"character_小林": "x"}, True), (["状态 ok"], {"state_ok": "true"}, True), (["时间 noon"], {}, True), (["other"], {}, True)])
def test_conditions(spark, conditions, scenario, met):
    df = spark.createDataFrame([(conditions, scenario)], "c array<string>, s map<string,string>")
    assert df.select(causal.conditions_met(F.col("c"), F.col("s"))).first()[0] == met


def test_text_functions(spark):
    df = spark.createDataFrame([("测试  内容", "测试 内容", " 石桥 ", "a b", "b c", "")], "a string, b string, n string, x string, y string, e string")
    row = df.select(
        (T.content_hash(F.col("a"), "ws") == T.content_hash(F.col("b"), "ws")).alias("ws"), (T.content_hash(F.col("a")) == T.content_hash(F.col("b"))).alias("punct"), T.entry_id(F.lit("location"), F.col("n"), "ws").alias("id"),
        T.word_jaccard(F.col("x"), F.col("y")).alias("j"), T.word_jaccard(F.col("x"), F.col("e")).alias("none"), T.char_jaccard(F.col("e"), F.col("e")).alias("empty"), T.structural_fingerprint(F.lit("# t\n- a\n\nword")).alias("f"),
    ).first()
    assert (row.ws, row.punct, row.id, round(row.j, 6), row.none, row.empty, row.f) == (True, False, "location:石桥", 0.333333, 0.0, 0.0, "#\n-\n\ntext")


def test_quarantine(spark):
    df = spark.createDataFrame([(0.5, "a"), (1.5, "b"), (None, None)], "intensity double, dominant string")
    good, bad = quality.quarantine(df, {"intensity": (0, 1)}, ("dominant",))
    assert good.count() == 1 and sorted(map(tuple, (r.violations for r in bad.collect()))) == [("dominant: missing",), ("intensity: out of range",)]
