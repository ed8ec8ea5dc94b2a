"""Structured model responses (JSON text) as tables, and the tables' sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = """emotional_mix array<struct<emotion_type string, intensity double, duration double, triggers array<string>, manifestations array<string>>>,
dominant_emotion string, trait_manifestations map<string, struct<strength double, consistency double, behavior_examples array<string>, situational_context string>>,
stability_score double, intensity_level double, arousal_level double, analysis_confidence double"""
CAUSAL = """events array<struct<event_name string, event_type string, participants array<string>, location string, significance string, scope string, status string>>,
causal_relations array<struct<cause_event string, effect_event string, relation_type string, causal_strength double, necessity_score double, sufficiency_score double, evidence string, confidence double, conditions array<string>, exceptions array<string>>>"""


def parsed(responses: DataFrame, schema: str, text: str = "response") -> DataFrame:
    """Adds `value`; null for text that is no JSON object."""
    return responses.withColumn("value", F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).withColumn("value", F.when(F.col("value._corrupt").isNull(), F.col("value")))


def states(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """State rows with defaults, and `ok`: false for corrupt text or a missing required value (to be set aside)."""
    rows = parsed(responses, STATE, text)
    v = F.col("value")
    empty = F.array().cast("array<string>")
    mix = F.transform(F.coalesce(v["emotional_mix"], F.array().cast("array<struct<emotion_type:string,intensity:double,duration:double,triggers:array<string>,manifestations:array<string>>>")), lambda e: F.struct(e["emotion_type"].alias("emotion_type"), e["intensity"].alias("intensity"), e["duration"].alias("duration"), F.coalesce(e["triggers"], empty).alias("triggers"), F.coalesce(e["manifestations"], empty).alias("manifestations")))
    traits = F.transform_values(F.coalesce(v["trait_manifestations"], F.create_map().cast("map<string,struct<strength:double,consistency:double,behavior_examples:array<string>,situational_context:string>>")), lambda _, t: F.struct(t["strength"].alias("strength"), F.coalesce(t["consistency"], F.lit(0.8)).alias("consistency"), F.coalesce(t["behavior_examples"], empty).alias("behavior_examples"), F.coalesce(t["situational_context"], F.lit("大部分情况")).alias("situational_context")))
    rows = rows.select(
        key, v.isNotNull().alias("parsed"), mix.alias("emotional_mix"), v["dominant_emotion"].alias("dominant_emotion"), traits.alias("trait_manifestations"),
        F.coalesce(v["stability_score"], F.lit(0.8)).alias("stability_score"), F.coalesce(v["intensity_level"], F.lit(0.7)).alias("intensity_level"),
        F.coalesce(v["arousal_level"], F.lit(0.9)).alias("arousal_level"), F.coalesce(v["analysis_confidence"], F.lit(0.85)).alias("confidence"),
    )
    whole = F.forall("emotional_mix", lambda e: e["emotion_type"].isNotNull() & e["intensity"].isNotNull()) & F.forall(F.map_values("trait_manifestations"), lambda t: t["strength"].isNotNull())
    return rows.withColumn("ok", F.col("parsed") & whole).drop("parsed")


def events(responses: DataFrame, key: str = "session_id", text: str = "response", first: str | None = None) -> DataFrame:
    """Event rows with defaults and an id made of session and position; where a session has several responses, `first`
    names the column with the number of events before each."""
    rows = parsed(responses, CAUSAL, text).select(key, *[first] * (first is not None), F.posexplode("value.events").alias("pos", "e"))
    if first is not None:
        rows = rows.withColumn("pos", F.col("pos") + F.col(first))
    number = F.concat(F.lit("Event "), F.col("pos").cast("string"))
    return rows.select(
        key, "pos", F.concat(F.lit("event_"), F.col(key).cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("event_id"), F.coalesce("e.event_name", number).alias("name"),
        F.coalesce("e.event_type", F.lit("action")).alias("event_type"), F.coalesce("e.significance", F.lit("minor")).alias("significance"), F.coalesce("e.scope", F.lit("local")).alias("scope"),
        F.coalesce("e.status", F.lit("planned")).alias("status"), F.coalesce("e.participants", F.array().cast("array<string>")).alias("participants"), F.col("e.location").alias("location"),
    )


def relations(responses: DataFrame, key: str = "session_id", text: str = "response") -> DataFrame:
    return parsed(responses, CAUSAL, text).select(key, F.posexplode("value.causal_relations").alias("pos", "r")).select(key, "pos", "r.*")


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Appends to a table; ids are digests of the content, so a retried write can be told by them."""
    rows.write.mode("append").partitionBy(*partition_by).format(kind).save(path)


def read_messages(spark, path: str, kind: str = "json") -> DataFrame:
    """Requests with messages arrays to one row a message."""
    schema = "request_id string, session_id string, messages array<struct<role: string, content: string, name: string>>"
    rows = spark.read.schema(schema).format(kind).load(path)
    return rows.select("request_id", "session_id", F.posexplode("messages").alias("turn", "m")).select("request_id", "session_id", "turn", "m.role", F.col("m.content").alias("text"), "m.name")
