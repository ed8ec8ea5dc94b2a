"""Queries over character states (events by user and day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import epoch_text
from palimpsest.operators import states as S
from palimpsest.operators import temporal
from palimpsest.plans.base import PSYCH, REASON, query
from palimpsest.plans.bindings import AS_OF, DIGITS, psych_states, state_responses, table
from palimpsest.sources import responses
from palimpsest.sources.tables import written

_P = f"WITH {PSYCH} "
_WINDOW = f"sid >= '2024-01-24' AND sid <= '2024-01-31'"


def _id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("character_id", "user_id")


@query(_P + "SELECT cid AS user_id, sid AS state_id, psid AS prev_state, pstab AS prev_stability FROM seq")
def o_w1_previous_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.previous(psych_states(spark, sf)).select(F.col("character_id").alias("user_id"), "state_id", F.col("prev.state_id").alias("prev_state"), F.col("prev.stability").alias("prev_stability"))


def _long(spark: SparkSession, sf: str, column: str) -> DataFrame:
    rows = S.differences(psych_states(spark, sf), DIGITS)
    return rows.select(F.col("character_id").alias("user_id"), F.col("to_state").alias("state_id"), F.explode(column).alias("c")).select("user_id", "state_id", "c.name", F.round("c.old", 6).alias("old_value"), F.round("c.new", 6).alias("new_value"), F.col("c.delta").alias("delta"))


@query(_P + "SELECT cid AS user_id, sid AS state_id, name, old::DOUBLE AS old_value, new::DOUBLE AS new_value, delta::DOUBLE AS delta FROM emoc")
def o_j6_emotion_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spark, sf, "emotion_changes")


@query(_P + "SELECT cid AS user_id, sid AS state_id, name, old AS old_value, new AS new_value, delta FROM trac")
def o_j7_trait_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spark, sf, "trait_changes")


@query(_P + "SELECT cid AS user_id, psid AS from_state, sid AS to_state, ne AS n_emotion_changes, nt AS n_trait_changes, ds AS stability_change FROM tr")
def o_d8_state_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.differences(psych_states(spark, sf), DIGITS)).select("user_id", "from_state", "to_state", F.size("emotion_changes").cast("long").alias("n_emotion_changes"), F.size("trait_changes").cast("long").alias("n_trait_changes"), "stability_change")


@query(_P + "SELECT kind AS transition_type, count(*) AS n FROM trn GROUP BY 1")
def o_c12_transition_type(spark: SparkSession, sf: str) -> DataFrame:
    return S.transitions(psych_states(spark, sf), digits=DIGITS).groupBy("transition_type").agg(F.count("*").alias("n"))


@query(_P.rstrip() + REASON + "SELECT trn.cid AS user_id, trn.sid AS to_state, coalesce(reason, '自然演化') AS transition_reason FROM trn LEFT JOIN reasons USING (cid, sid)")
def o_c13_transition_reason(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.transitions(psych_states(spark, sf), digits=DIGITS)).select("user_id", "to_state", "transition_reason")


@query(_P + "SELECT cid AS user_id, sid AS to_state, score AS rationality_score FROM trn")
def o_a9_transition_rationality(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.transitions(psych_states(spark, sf), digits=DIGITS)).select("user_id", "to_state", F.round("rationality_score", 6).alias("rationality_score"))


@query(_P.rstrip() + REASON + "SELECT trn.cid AS user_id, psid AS from_state, trn.sid AS to_state, kind AS transition_type, coalesce(reason, '自然演化') AS transition_reason, score AS rationality_score FROM trn LEFT JOIN reasons USING (cid, sid)")
def o_d9_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.transitions(psych_states(spark, sf), digits=DIGITS)).select("user_id", "from_state", "to_state", "transition_type", "transition_reason", F.round("rationality_score", 6).alias("rationality_score"))


def _two(c: str) -> str:
    """SQL of a number with two decimals, halves rounded up."""
    return f"round({c}::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR"


@query(_P.rstrip() + REASON + f"""SELECT trn.cid AS user_id, trn.sid AS to_state, '转移类型: ' || kind || chr(10) || '触发事件: 对话' || chr(10) || '转移原因: ' || coalesce(reason, '自然演化') || chr(10) || '合理性得分: ' || {_two("score")} || chr(10)
  || '转移时间: ' || trn.sid || 'T00:00:00' || chr(10) || '从状态: ' || psid || chr(10) || '到状态: ' || trn.sid AS description FROM trn LEFT JOIN reasons USING (cid, sid)""")
def o_p17_transition_description(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.transitions(psych_states(spark, sf), digits=DIGITS)).select("user_id", "to_state", "description")


_LISTED = "(SELECT string_agg(name || '(' || {two} || ')', ', ' ORDER BY name) FROM (SELECT name, v FROM {table} x WHERE x.cid = dom.cid AND x.sid = dom.sid ORDER BY name LIMIT 5))"


@query(_P + f"""SELECT cid AS user_id, sid AS state_id, '主导情绪: ' || dominant || chr(10) || '情绪混合: ' || {_LISTED.format(two=_two("v"), table="emo")} || chr(10) || '特质表现: ' || {_LISTED.format(two=_two("v"), table="tra")} || chr(10)
  || '稳定性: ' || {_two("stability")} || ', 强度: ' || {_two("intensity")} || ', 唤醒: ' || {_two("arousal")} AS description FROM dom JOIN tot USING (cid, sid)""")
def o_p16_state_description(spark: SparkSession, sf: str) -> DataFrame:
    return _id(psych_states(spark, sf)).select("user_id", "state_id", S.state_description().alias("description"))


@query(_P + f"SELECT cid AS user_id, sid AS state_id FROM tot WHERE {_WINDOW}")
def o_f4_look_back(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.look_back(psych_states(spark, sf), AS_OF)).select("user_id", "state_id")


@query(_P + "SELECT cid AS user_id, sid AS state_id, row_number() OVER (PARTITION BY cid ORDER BY sid DESC) AS rank FROM tot QUALIFY rank <= 5")
def o_w5_state_history(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.history(psych_states(spark, sf), 5)).select("user_id", "state_id", F.col("rank").cast("long").alias("rank"))


@query(_P + "SELECT cid AS user_id, max(sid) AS state_id FROM tot GROUP BY 1")
def o_j13_tracked_state(spark: SparkSession, sf: str) -> DataFrame:
    return psych_states(spark, sf).groupBy(F.col("character_id").alias("user_id")).agg(F.max_by("state_id", "observed_at").alias("state_id"))


@query(_P + "SELECT event_id, s.sid AS state_id, s.stability FROM events e ASOF LEFT JOIN (SELECT cid, sid, stability, CAST(sid AS TIMESTAMP) + INTERVAL 1 DAY AS seen FROM tot) s ON e.user_id = s.cid AND e.ts >= s.seen")
def o_j13_state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The state that is known of a user when an event comes, for each event; a day's state is known when the day ends."""
    known = psych_states(spark, sf).withColumn("observed_at", F.col("observed_at") + F.make_dt_interval(days=F.lit(1)))
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("character_id"), F.col("ts").alias("requested_at"))
    return temporal.as_of(events, known).select("event_id", "state.state_id", "state.stability")


_A4 = "SELECT cid, avg(greatest(0, 1 - 2 * v)) AS s FROM (SELECT cid, name, var_pop(v) AS v, count(*) AS n FROM tra GROUP BY 1, 2) WHERE n > 1 GROUP BY 1"
_A5 = "SELECT cid, avg(CASE WHEN coalesce(et, 0) < 0.3 THEN 1.0 WHEN et < 0.6 THEN 0.7 ELSE 0.4 END) AS s FROM tr GROUP BY 1"
_A6 = "SELECT cid, avg(CASE WHEN name IN ('joy', 'happiness') THEN 1.0 WHEN name IN ('optimistic', 'enthusiastic', 'anxious', 'aggressive', 'stubborn') THEN 0.9 ELSE 0.7 END) AS s FROM (SELECT cid, sid, name FROM tra QUALIFY row_number() OVER (PARTITION BY cid, sid ORDER BY v DESC, name) = 1) GROUP BY 1"
_A7 = "SELECT cid, CASE WHEN i > 0.7 AND t < 0.5 THEN 0.6 WHEN i > 0.5 AND t < 0.7 THEN 0.8 ELSE 0.9 END AS s FROM (SELECT cid, round(avg(intensity), 6) AS i, round(avg(stability), 6) AS t FROM tot GROUP BY 1)"


@query(_P + f"SELECT cid AS user_id, round(s, 6)::DOUBLE AS score FROM ({_A4})")
def o_a4_trait_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.trait_consistency(psych_states(spark, sf))).select("user_id", F.round("trait_consistency", 6).alias("score"))


@query(_P + f"SELECT cid AS user_id, round(s, 6)::DOUBLE AS score FROM ({_A5})")
def o_a5_emotion_rationality(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.emotion_rationality(psych_states(spark, sf), DIGITS)).select("user_id", F.round("emotional_rationality", 6).alias("score"))


@query(_P + f"SELECT cid AS user_id, round(s, 6)::DOUBLE AS score FROM ({_A6})")
def o_a6_behavior_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.behavior_consistency(psych_states(spark, sf))).select("user_id", F.round("behavioral_consistency", 6).alias("score"))


@query(_P + f"SELECT cid AS user_id, s::DOUBLE AS score FROM ({_A7})")
def o_a7_memory_rationality(spark: SparkSession, sf: str) -> DataFrame:
    return _id(S.memory_rationality(psych_states(spark, sf), DIGITS)).select("user_id", F.col("memory_rationality").alias("score"))


# The window is cut out of the events themselves, so that differences start inside it.
_PW = "WITH " + PSYCH.replace("FROM events)", "FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-31')")


@query(_PW + f""", k AS (SELECT cid, count(*) AS n FROM tot GROUP BY 1)
SELECT k.cid AS user_id, n AS n_states, round(CASE WHEN n < 2 THEN 1 ELSE coalesce(a.s, 1) END, 6)::DOUBLE AS trait_score, round(CASE WHEN n < 2 THEN 1 ELSE coalesce(b.s, 1) END, 6)::DOUBLE AS emotion_score,
  round(CASE WHEN n < 2 THEN 1 ELSE c.s END, 6)::DOUBLE AS behavior_score, round(CASE WHEN n < 2 THEN 1 ELSE d.s END, 6)::DOUBLE AS memory_score,
  round(CASE WHEN n < 2 THEN 1 ELSE 0.3 * coalesce(a.s, 1) + 0.3 * coalesce(b.s, 1) + 0.2 * c.s + 0.2 * d.s END, 6)::DOUBLE AS overall
FROM k LEFT JOIN ({_A4}) a USING (cid) LEFT JOIN ({_A5}) b USING (cid) LEFT JOIN ({_A6}) c USING (cid) LEFT JOIN ({_A7}) d USING (cid)""")
def o_a8_coherence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _id(S.coherence(psych_states(spark, sf), AS_OF, digits=DIGITS))
    names = {"trait_score": "trait_consistency", "emotion_score": "emotional_rationality", "behavior_score": "behavioral_consistency", "memory_score": "memory_rationality", "overall": "overall"}
    return rows.select("user_id", "n_states", *[F.round(v, 6).alias(k) for k, v in names.items()])


_SEVEN = "RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW"


@query(_P + f""", behaved AS (SELECT cid, sid, CASE WHEN name IN ('joy', 'happiness') THEN 1.0 WHEN name IN ('optimistic', 'enthusiastic', 'anxious', 'aggressive', 'stubborn') THEN 0.9 ELSE 0.7 END AS b FROM tra QUALIFY row_number() OVER (PARTITION BY cid, sid ORDER BY v DESC, name) = 1),
moved AS (SELECT cid, sid, CASE WHEN coalesce(et, 0) < 0.3 THEN 1.0 WHEN et < 0.6 THEN 0.7 ELSE 0.4 END AS e FROM tr),
st AS (SELECT tot.cid, tot.sid, CAST(tot.sid AS TIMESTAMP) AS t, intensity, stability, b::DOUBLE AS b, e::DOUBLE AS e FROM tot JOIN behaved USING (cid, sid) LEFT JOIN moved USING (cid, sid)),
whole AS (SELECT cid, sid, count(*) OVER w AS n, sum(e) OVER w - coalesce(first_value(e) OVER w, 0) AS e, avg(b) OVER w AS b, round(avg(intensity) OVER w, 6) AS i, round(avg(stability) OVER w, 6) AS s FROM st WINDOW w AS (PARTITION BY cid ORDER BY t {_SEVEN})),
grid AS (SELECT st.cid, st.sid, count(v) OVER w AS n, var_pop(v) OVER w AS v FROM st JOIN (SELECT DISTINCT cid, name FROM tra) x ON x.cid = st.cid LEFT JOIN tra ON tra.cid = st.cid AND tra.sid = st.sid AND tra.name = x.name WINDOW w AS (PARTITION BY st.cid, x.name ORDER BY t {_SEVEN})),
a AS (SELECT cid, sid, avg(greatest(0, 1 - 2 * v)) FILTER (n > 1) AS s FROM grid GROUP BY 1, 2),
scores AS (SELECT cid, sid, n, CASE WHEN n < 2 THEN 1 ELSE coalesce(a.s, 1) END AS t, CASE WHEN n < 2 THEN 1 ELSE e / (n - 1) END AS e, CASE WHEN n < 2 THEN 1 ELSE b END AS b, CASE WHEN n < 2 THEN 1 WHEN i > 0.7 AND whole.s < 0.5 THEN 0.6 WHEN i > 0.5 AND whole.s < 0.7 THEN 0.8 ELSE 0.9 END AS m FROM whole JOIN a USING (cid, sid))
SELECT cid AS user_id, sid AS state_id, n AS n_states, round(t, 5)::DOUBLE AS trait_score, round(e, 5)::DOUBLE AS emotion_score, round(b, 5)::DOUBLE AS behavior_score, m::DOUBLE AS memory_score, round(0.3 * t + 0.3 * e + 0.2 * b + 0.2 * m, 5)::DOUBLE AS overall FROM scores""")
def o_a8_rolling_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """The coherence of each user's last seven days at every one of its states."""
    rows = _id(S.rolling_coherence(psych_states(spark, sf), digits=DIGITS))
    names = {"trait_score": "trait_consistency", "emotion_score": "emotional_rationality", "behavior_score": "behavioral_consistency", "overall": "overall"}
    return rows.select("user_id", "state_id", "n_states", F.col("memory_rationality").alias("memory_score"), *[F.round(v, 5).alias(k) for k, v in names.items()])


_STORED = _P + """, y AS (SELECT cid, sid, (cid + CAST(substr(sid, 9, 2) AS INTEGER)) % 97 = 0 AS broken FROM tot)
SELECT cid AS user_id, sid AS state_id, CASE WHEN NOT broken THEN 'psych_state_' || cid || '_' || CAST(epoch(CAST(sid AS TIMESTAMP)) AS BIGINT) END AS stored_id, 'psychological_state:' || cid AS source_description, NOT broken AS success,
  CASE WHEN broken THEN 'unreadable state' END AS error, CASE WHEN NOT broken THEN 1 ELSE 0 END AS n_episodes FROM y"""


@query(_STORED)
def o_d10_state_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with states, stored as episodes; n_episodes is read back from the sink."""
    own = F.split("response_id", r"\|")
    rows = responses.states(state_responses(spark, sf)).select(
        own[0].cast("long").alias("character_id"), own[1].alias("state_id"), own[1].cast("timestamp").alias("observed_at"), "ok",
        F.map_from_entries(F.transform("emotional_mix", lambda e: F.struct(e["emotion_type"], e["intensity"]))).alias("emotions"), F.transform_values("trait_manifestations", lambda _, t: t["strength"]).alias("traits"),
        F.col("dominant_emotion").alias("dominant"), F.col("stability_score").alias("stability"), F.col("intensity_level").alias("intensity"), F.col("arousal_level").alias("arousal"),
    )
    answers = S.stored(rows.withColumn("body", F.when(F.col("ok"), S.state_description())))
    kept = written(answers.where("success").select("episode_id", "episode_name", "body", "source_description", "observed_at", "character_id"), "state_episodes")
    found = kept.groupBy("episode_id").agg(F.count("*").cast("int").alias("n_episodes"))
    rows = answers.join(found, "episode_id", "left")
    return rows.select(F.col("character_id").alias("user_id"), "state_id", "stored_id", "source_description", "success", "error", F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"))


@query(_P + "SELECT sid AS state_id, stability FROM tot WHERE cid = 7")
def o_f3_source_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = psych_states(spark, sf).withColumn("source_description", F.concat(F.lit("psychological_state:"), F.col("character_id").cast("string")))
    return rows.where("source_description = 'psychological_state:7'").select("state_id", "stability")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """States of the characters that are known: users who signed up."""
    characters = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("character_id")).distinct()
    return psych_states(spark, sf).join(characters, "character_id", "left_semi").select("character_id", "state_id", F.col("observed_at").alias("relation_started"))


_KNOWN = "cid IN (SELECT user_id FROM events WHERE event_type = 'signup')"


@query(_P + f"SELECT cid AS user_id, count(*) AS n_states, min(sid) AS first_state FROM tot WHERE {_KNOWN} GROUP BY 1")
def o_j12_state_attach(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).groupBy(F.col("character_id").alias("user_id")).agg(F.count("*").alias("n_states"), F.min("state_id").alias("first_state"))


@query(_P + f"SELECT cid AS user_id, sid AS state_id FROM tot WHERE {_KNOWN}")
def o_s6_state_link_sink(spark: SparkSession, sf: str) -> DataFrame:
    return written(_links(spark, sf), "state_links").select(F.col("character_id").alias("user_id"), "state_id")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at_text FROM events")
def o_c11_epoch_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", epoch_text(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at_text"))
