"""Streaming jobs run over the given tables to completion; each result is compared with its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.plans import bindings as B
from palimpsest.plans.base import CHAT, PSYCH, REASON, WORLD, query
from palimpsest.plans.causal_queries import STATE
from palimpsest.plans.world_queries import T0
from palimpsest.sources import response_files as RF
from palimpsest.sources import responses as R
from palimpsest.sources.tables import CODEC, shared_dir
from palimpsest.streaming import jobs as J

T = TypeVar("T")
#: More files than a step has.
STEP_FILES = 1_000_000


def _at(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _steps(path: str, run: Callable[[], T], *steps: DataFrame) -> T:
    """Writes each step as it is dealt and lets the stream take it, as one batch, before the next one; what the last run returns."""
    for df in steps:
        df.write.mode("append").option("compression", CODEC).parquet(path)
        out = run()
    return out


def _source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All new files in one batch."""
    return J.source(spark, path, schema, STEP_FILES)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60)
    return B.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.md5(F.concat_ws(":", "role", F.coalesce("text", F.lit(""))).cast("binary")).alias("content_hash"), ts.alias("ts"))


@query(f"WITH {WORLD} SELECT o.session_id, status, count(*) AS n FROM (SELECT session_id, CASE WHEN session_id NOT IN (SELECT session_id FROM n) THEN 'active' WHEN change = 'removed' THEN 'deleted' WHEN change = 'modified' THEN 'superseded' ELSE 'active' END AS status FROM feed WHERE change <> 'added' UNION ALL SELECT session_id, 'active' FROM feed WHERE change IN ('added', 'modified')) o GROUP BY 1, 2")
def o_t1_world_stream(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    old, new = (e.select("session_id", "entry_id", "entry_type", "name", "content", "content_hash", F.col("doc_id").alias("pos")) for e in B.world_entries(spark, sf))
    _steps(f"{at}/in", lambda: J.run(J.sync_entries(_source(spark, f"{at}/in", old.schema), f"{at}/store", f"{at}/check", T0)), old, new)
    return J.store(spark, f"{at}/store", 1).groupBy("session_id", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {CHAT} SELECT session_id, len(ol)::BIGINT AS n_before, change, d AS diff_index, len(nl)::BIGINT AS n_messages FROM chat WHERE len(nl) > 0
UNION ALL SELECT session_id, 0, 'append', 0, len(ol) FROM chat WHERE len(ol) > 0""")
def o_t2_chat_stream(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    old, new = (c.select("session_id", "turn", "content_hash") for c in B.chats(spark, sf))
    return _steps(f"{at}/in", lambda: J.to_table(J.chat_changes(_source(J.configure(spark), f"{at}/in", old.schema)), f"{at}/out", f"{at}/check"), old, new)


_HISTORIES = f"""WITH {CHAT}, rows AS (SELECT session_id, 1 AS step, 0 AS n_before, 'append' AS change, 0 AS diff_index, len(ol) AS n_messages FROM chat WHERE len(ol) > 0
UNION ALL SELECT session_id, 2, CASE WHEN session_id % 2 = 0 THEN len(ol) ELSE 0 END, CASE WHEN session_id % 2 = 0 THEN change ELSE 'append' END, CASE WHEN session_id % 2 = 0 THEN d ELSE 0 END, len(nl) FROM chat WHERE len(nl) > 0
UNION ALL SELECT session_id, 3, len(ol), 'ended', NULL, 0 FROM chat WHERE len(ol) > 0 AND len(nl) > 0 AND session_id % 2 <> 0
UNION ALL SELECT session_id, 4, CASE WHEN len(nl) > 0 THEN len(nl) ELSE len(ol) END, 'ended', NULL, 0 FROM chat)
"""


@query(_HISTORIES + "SELECT session_id, n_before::BIGINT AS n_before, change, diff_index::BIGINT AS diff_index, n_messages::BIGINT AS n_messages FROM rows")
def o_t2_chat_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of sessions that end after an hour: those of even number come again in half an hour, others in three."""
    at = _at(spark)
    old, new = (c.select("session_id", "turn", "content_hash") for c in B.chats(spark, sf))
    later = F.when(F.col("session_id") % 2 == 0, 1800).otherwise(10800)
    steps = [c.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + wait)) for c, wait in ((old, F.lit(0)), (new, later))]
    # Two rows of no session: one moves the watermark past all sessions, one makes a batch under it.
    ends = [spark.range(1).select(F.lit(-1).cast(old.schema["session_id"].dataType).alias("session_id"), F.lit(k).cast(old.schema["turn"].dataType).alias("turn"), F.lit("x").alias("content_hash"), F.timestamp_seconds(F.lit(1704067200 + 90_000 * k)).alias("ts")) for k in (1, 2)]
    sessions = lambda: J.to_table(J.chat_sessions(_source(J.configure(spark), f"{at}/in", steps[0].schema)), f"{at}/out", f"{at}/check")
    return _steps(f"{at}/in", sessions, *steps, *ends).where("session_id >= 0")


@query(f"WITH {PSYCH} {REASON} SELECT trn.cid AS user_id, psid AS from_state, trn.sid AS to_state, ds AS stability_change, kind AS transition_type, coalesce(reason, '自然演化') AS transition_reason, score AS rationality_score FROM trn LEFT JOIN reasons USING (cid, sid)")
def o_t3_transition_stream(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    rows = B.psych_states(spark, sf).select("character_id", "state_id", "observed_at", "emotions", "traits", "stability")
    half = F.coalesce(F.col("state_id") < "2024-01-16", F.lit(False))
    out = _steps(f"{at}/in", lambda: J.to_table(J.transitions(_source(J.configure(spark), f"{at}/in", rows.schema), digits=B.DIGITS), f"{at}/out", f"{at}/check"), rows.where(half), rows.where(~half))
    return out.select(F.col("character_id").alias("user_id"), "from_state", "to_state", "stability_change", "transition_type", "transition_reason", F.round("rationality_score", 6).alias("rationality_score"))


@query("SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1")
def o_t4_response_stream(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    rows = _messages(spark, sf).where("role = 'assistant'").select("session_id", F.concat(F.lit("Response "), F.col("turn").cast("string")).alias("name"), "content_hash", F.col("ts").alias("reference_time"))
    _steps(f"{at}/in", lambda: J.run(J.episodes(_source(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/check")), rows)
    return spark.read.parquet(f"{at}/out").groupBy("session_id").agg(F.count_distinct("episode_id").alias("n"))


@query(STATE + "SELECT cid || '|' || sid AS response_id, broken AS set_aside, CASE WHEN NOT broken THEN dominant END AS dominant_emotion, round(CASE WHEN NOT broken AND d % 3 <> 0 THEN stability END + 1e-7, 3)::DOUBLE AS stability_score FROM y")
def o_t4_response_files(spark: SparkSession, sf: str) -> DataFrame:
    """States as files of JSON lines that come in two steps, read by a stream that ends and begins anew between them."""
    at = _at(spark)
    rows = B.state_responses(spark, sf)
    line = F.concat(F.lit('{"response_id":"'), "response_id", F.lit('","state":'), "response", F.lit("}"))
    early = F.coalesce(F.col("state_id") < "2024-01-16", F.lit(False))
    for step, part in enumerate((rows.where(early), rows.where(~early))):
        part.select(line).write.text(f"{at}/in/step={step}")
        out = J.to_table(RF.records(RF.line_stream(spark, f"{at}/in"), f"response_id string, state struct<{R.STATE}>"), f"{at}/out", f"{at}/check")
    bad = F.col("value").isNull()
    name = F.when(bad, F.regexp_extract("text", '"response_id":"([^"]*)"', 1)).otherwise(F.col("value.response_id"))
    return out.select(name.alias("response_id"), bad.alias("set_aside"), "value.state.dominant_emotion", F.round(F.col("value.state.stability_score") + 1e-7, 3).alias("stability_score"))


@query("SELECT conv_id AS session_id, count(DISTINCT md5(role || ':' || coalesce(text, ''))) AS n FROM conversations GROUP BY 1")
def o_t5_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    rows = _messages(spark, sf)
    out = _steps(f"{at}/in", lambda: J.to_table(J.distinct_content(_source(spark, f"{at}/in", rows.schema)), f"{at}/out", f"{at}/check"), rows)
    return out.groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS session_id, count(*) AS n, count(DISTINCT role) AS n_roles FROM conversations GROUP BY 1")
def o_t6_live_counters(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    rows = _messages(spark, sf)
    counters = lambda: J.live_counters(_source(spark, f"{at}/in", rows.schema))
    even = F.coalesce(F.col("session_id") % 2 == 0, F.lit(False))
    _steps(f"{at}/in", lambda: J.run(counters().writeStream.outputMode("update").option("checkpointLocation", f"{at}/check").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))), rows.where(even), rows.where(~even))
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("session_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("n_roles", "batch").alias("n_roles"))


@query(f"""WITH {PSYCH}, b AS (SELECT cid, sid, CASE WHEN name IN ('joy', 'happiness') THEN 1.0 WHEN name IN ('optimistic', 'enthusiastic', 'anxious', 'aggressive', 'stubborn') THEN 0.9 ELSE 0.7 END AS s FROM tra QUALIFY row_number() OVER (PARTITION BY cid, sid ORDER BY v DESC, name) = 1)
, tw AS (SELECT cid, w, avg(greatest(0, 1 - 2 * v)) FILTER (n > 1) AS s FROM (SELECT cid, strftime(CAST(sid AS DATE) - k::INTEGER, '%Y-%m-%d') AS w, name, var_pop(v) AS v, count(*) AS n FROM tra, range(7) t(k) GROUP BY 1, 2, 3) GROUP BY 1, 2),
sw AS (SELECT tot.cid, strftime(CAST(sid AS DATE) - k::INTEGER, '%Y-%m-%d') AS w, avg(b.s) AS s, round(avg(intensity), 6) AS i, round(avg(stability), 6) AS st, count(*) AS n FROM tot JOIN b USING (cid, sid), range(7) t(k) GROUP BY 1, 2)
SELECT cid AS user_id, w AS window_start, round(coalesce(tw.s, 1), 6)::DOUBLE AS trait_consistency, round(sw.s, 6)::DOUBLE AS behavioral_consistency, (CASE WHEN i > 0.7 AND st < 0.5 THEN 0.6 WHEN i > 0.5 AND st < 0.7 THEN 0.8 ELSE 0.9 END)::DOUBLE AS memory_rationality, n AS n_states FROM sw LEFT JOIN tw USING (cid, w)""")
def o_t7_windowed_coherence(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark)
    rows = B.psych_states(spark, sf).select("character_id", "observed_at", "traits", "dominant", "intensity", "stability")
    # End rows at a time whose watermark lies past the windows of all states: one to move it, one more to make a batch under it.
    last = rows.agg(F.max("observed_at").alias("last")).where("last is not null")
    end = rows.limit(1).drop("observed_at").crossJoin(last).withColumn("observed_at", F.col("last") + F.expr("interval 9 days")).select(rows.columns)
    run = lambda: J.to_table(J.windowed_scores(_source(spark, f"{at}/in", rows.schema), digits=B.DIGITS), f"{at}/out", f"{at}/check")
    half = F.coalesce(F.col("observed_at") < F.lit("2024-01-16").cast("timestamp"), F.lit(False))
    out = _steps(f"{at}/in", run, rows.where(half), rows.where(~half), end, end)
    real = out.crossJoin(F.broadcast(last)).where("window_start <= last")  # windows of end rows start later
    return real.select(F.col("character_id").alias("user_id"), F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.round("trait_consistency", 6).alias("trait_consistency"), F.round("behavioral_consistency", 6).alias("behavioral_consistency"), "memory_rationality", "n_states")
