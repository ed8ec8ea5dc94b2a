"""Queries over the event graph: edges from each event to the same user's next two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import causal as G
from palimpsest.plans import bindings as B
from palimpsest.plans.base import CAUSAL, PSYCH, query
from palimpsest.sources import responses as R
from palimpsest.sources.tables import written


def _trails(depth: int, strength: float, start: str, backward: bool = False) -> str:
    """Recursive trails; the graph has no cycles and no parallel edges, so edge lists need no check."""
    near, far = ("dst", "src") if backward else ("src", "dst")
    return f"""WITH RECURSIVE {CAUSAL}, strong AS (SELECT * FROM edges WHERE strength >= {strength}),
t AS (SELECT {near} AS start, {far} AS tip, 1 AS depth, [{near}, {far}] AS nodes, strength, met, hit FROM strong WHERE {near} % {start} = 0
  UNION ALL SELECT t.start, e.{far}, t.depth + 1, list_append(t.nodes, e.{far}), e.strength, e.met, e.hit FROM t JOIN strong e ON e.{near} = t.tip WHERE t.depth < {depth})
"""


def _starts(spark: SparkSession, sf: str, every: int = 1) -> DataFrame:
    return B.table(spark, sf, "events").select(F.col("event_id").alias("start")).where(F.col("start") % every == 0)


def _path(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">")


@query(_trails(3, 0.5, "1") + "SELECT start, depth::BIGINT AS depth, list_aggregate(list_transform(nodes, lambda x: x::VARCHAR), 'string_agg', '>') AS path FROM t")
def o_g1_trace_forward(spark: SparkSession, sf: str) -> DataFrame:
    found = G.active_trails(B.causal_edges(spark, sf), _starts(spark, sf), B.causal_events(spark, sf), 3, 0.5, keep="none")
    return found.select("start", F.col("depth").cast("long").alias("depth"), _path("nodes").alias("path"))


@query(_trails(5, 0.5, "1") + "SELECT depth::BIGINT AS depth, count(*) AS n, sum(tip)::BIGINT AS tips FROM t GROUP BY 1")
def o_g1_trace_depth5(spark: SparkSession, sf: str) -> DataFrame:
    found = G.trails(B.causal_edges(spark, sf), _starts(spark, sf), 5, 0.5, keep="none")
    return found.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.sum(F.element_at("nodes", -1)).alias("tips"))


@query(_trails(3, 0.5, "1", True) + "SELECT start, depth::BIGINT AS depth, list_aggregate(list_transform(nodes, lambda x: x::VARCHAR), 'string_agg', '>') AS path FROM t")
def o_g2_trace_backward(spark: SparkSession, sf: str) -> DataFrame:
    found = G.trails(B.causal_edges(spark, sf), _starts(spark, sf), 3, 0.5, backward=True, keep="none")
    return found.select("start", F.col("depth").cast("long").alias("depth"), _path("nodes").alias("path"))


@query(_trails(5, 0.5, "1") + f""", wanted AS (SELECT event_id AS start, lead(event_id, 6) OVER (PARTITION BY gid ORDER BY ts, event_id) AS finish FROM ce)
SELECT start, finish AS "end", depth::BIGINT AS depth, list_aggregate(list_transform(nodes, lambda x: x::VARCHAR), 'string_agg', '>') AS path FROM t JOIN wanted USING (start) WHERE tip = finish""")
def o_g1_between(spark: SparkSession, sf: str) -> DataFrame:
    """The trails of up to five edges from every event to the same user's sixth after it."""
    order = Window.partitionBy("group_id").orderBy("ts", "event_id")
    pairs = B.causal_events(spark, sf).select(F.col("event_id").alias("start"), F.lead("event_id", 6).over(order).alias("end"))
    found = G.between(B.causal_edges(spark, sf), pairs, 5, 0.5, with_edges=False)
    return found.select("start", "end", F.col("depth").cast("long").alias("depth"), _path("nodes").alias("path"))


@query(_trails(2, 0.5, "1") + "SELECT start, list_aggregate(list_transform(nodes, lambda x: 'event ' || x), 'string_agg', '|') AS names, strength AS last_strength FROM t")
def o_g3_path_materialisation(spark: SparkSession, sf: str) -> DataFrame:
    edges = B.causal_edges(spark, sf).drop("conditions", "exceptions")
    rows = G.materialized_trails(edges, _starts(spark, sf), B.causal_events(spark, sf).select("event_id", "name"), 2, 0.5, keep="last")
    return rows.select("start", F.array_join(F.transform("events", lambda e: e["name"]), "|").alias("names"), F.element_at("edges", -1)["strength"].alias("last_strength"))


@query(f"WITH {CAUSAL} SELECT src, dst, strength FROM edges WHERE strength >= 0.5")
def o_f5_strength_filter(spark: SparkSession, sf: str) -> DataFrame:
    return B.causal_edges(spark, sf).where("strength >= 0.5").select("src", "dst", "strength")


@query(f"WITH {CAUSAL} SELECT a.src AS a, a.dst AS b, e.dst AS c FROM edges a JOIN edges e ON e.src = a.dst WHERE a.strength >= 0.9 AND e.strength >= 0.9")
def o_j11_path_step(spark: SparkSession, sf: str) -> DataFrame:
    found = G.trails(B.causal_edges(spark, sf), _starts(spark, sf), 2, 0.9, keep="none").where("depth = 2")
    return found.select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), F.col("nodes")[2].alias("c"))


@query(f"WITH {CAUSAL} SELECT src, dst, src % 4 <> 2 AS met FROM edges")
def o_f7_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return B.causal_edges(spark, sf).select("src", "dst", G.conditions_met(F.col("conditions"), B.scenario()).alias("met"))


@query(f"WITH {CAUSAL} SELECT src, dst, src % 4 = 0 AS hit FROM edges")
def o_f8_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return B.causal_edges(spark, sf).select("src", "dst", G.exception_hit(F.col("exceptions"), B.scenario()).alias("hit"))


_PROB = "round(strength * CASE WHEN met THEN 1.0 ELSE 0.3 END * CASE WHEN hit THEN 0.1 ELSE 1.0 END, 6)"


@query(f"WITH {CAUSAL} SELECT src, dst, {_PROB} AS probability FROM edges")
def o_c14_probability(spark: SparkSession, sf: str) -> DataFrame:
    p = G.probability(F.col("strength"), G.conditions_met(F.col("conditions"), B.scenario()), G.exception_hit(F.col("exceptions"), B.scenario()))
    return B.causal_edges(spark, sf).select("src", "dst", F.round(p, 6).alias("probability"))


@query(_trails(3, 0.6, "1") + f"SELECT start, tip AS event_id, depth::BIGINT AS steps, {_PROB} AS probability FROM t")
def o_g5_consequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.consequences(B.causal_edges(spark, sf), _starts(spark, sf), B.scenario())
    return rows.select("start", "event_id", F.col("steps").cast("long").alias("steps"), F.round("probability", 6).alias("probability"))


@query(_trails(3, 0.6, "1") + f"SELECT start, tip AS event_id, depth::BIGINT AS steps, rank() OVER (PARTITION BY start ORDER BY {_PROB} DESC) AS rank FROM t")
def o_w9_consequence_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.consequences(B.causal_edges(spark, sf), _starts(spark, sf), B.scenario()).withColumn("p", F.round("probability", 6))
    return rows.select("start", "event_id", F.col("steps").cast("long").alias("steps"), F.rank().over(Window.partitionBy("start").orderBy(F.desc("p"))).cast("long").alias("rank"))


@query(f"WITH {CAUSAL} SELECT gid AS group_id, count(*) AS n, round(sum(strength), 4) AS total FROM edges GROUP BY 1")
def o_s5_causal_edge_sink(spark: SparkSession, sf: str) -> DataFrame:
    return written(B.causal_edges(spark, sf), "causal_edges").groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("total"))


_JSON = f"""WITH {CAUSAL}, top AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY k) AS nx FROM (SELECT event_id, gid AS user_id, event_type, value, k FROM ce)),
rel AS (SELECT user_id AS session_id, k - 1 AS pos, event_id, nx, CASE WHEN event_id % 5 = 0 THEN 'nowhere' ELSE 'event ' || nx END AS effect, CASE WHEN event_id % 3 <> 0 THEN round(least(value, 100) / 100, 4) END AS strength FROM top WHERE nx IS NOT NULL),
known AS (SELECT 'event_' || user_id || '_' || (k - 1) AS id, user_id AS session_id, 'event ' || event_id AS name FROM top)
"""


@query(_JSON + "SELECT user_id AS session_id, count(*) AS n_events, count(nx) AS n_relations FROM top GROUP BY 1")
def o_s3_causal_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.causal_responses(spark, sf)
    n = R.events(rows, first="first").groupBy("session_id").agg(F.count("*").alias("n_events"))
    return n.join(R.relations(rows).groupBy("session_id").agg(F.count("*").alias("n_relations")), "session_id", "left").fillna(0, ["n_relations"])


@query(_JSON + "SELECT user_id AS session_id, 'event_' || user_id || '_' || (k - 1) AS event_id, 'event ' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'action' END AS event_type, 'minor' AS significance, 'planned' AS status FROM top")
def o_p18_event_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return R.events(B.causal_responses(spark, sf), first="first").select("session_id", "event_id", "name", "event_type", "significance", "status")


_RESOLVED = _JSON + "SELECT rel.session_id, a.id AS src, b.id AS dst, coalesce(strength, 0.8)::DOUBLE AS strength, 'causes' AS relation_type, 0.8::DOUBLE AS evidence_level FROM rel JOIN known a ON a.session_id = rel.session_id AND a.name = 'event ' || rel.event_id JOIN known b ON b.session_id = rel.session_id AND b.name = rel.effect"


@query(_RESOLVED)
def o_j8_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.causal_responses(spark, sf)
    return G.resolved(R.relations(rows), R.events(rows, first="first")).select("session_id", "src", "dst", "strength", "relation_type", "evidence_level")


@query(f"""SELECT user_id AS session_id, coalesce(n_stored, 0) AS n_stored, coalesce(n_given, 0) AS n_given FROM (SELECT DISTINCT user_id FROM events)
LEFT JOIN (SELECT session_id AS user_id, count(*) AS n_stored FROM ({_RESOLVED}) GROUP BY 1) USING (user_id) LEFT JOIN (SELECT session_id AS user_id, count(*) AS n_given FROM ({_JSON} SELECT * FROM rel) GROUP BY 1) USING (user_id)""")
def o_g4_store_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.causal_responses(spark, sf)
    given = R.relations(rows).groupBy("session_id").agg(F.count("*").alias("n_given"))
    sessions = rows.select("session_id").distinct()
    stored = written(G.resolved(R.relations(rows), R.events(rows, first="first")), "chains").groupBy("session_id").agg(F.count("*").alias("n_stored"))
    return sessions.join(stored, "session_id", "left").join(given, "session_id", "left").fillna(0, ["n_stored", "n_given"])


STATE = f"WITH {PSYCH}, x AS (SELECT *, day_of AS d FROM (SELECT *, CAST(substr(sid, 9, 2) AS INTEGER) AS day_of FROM tot JOIN dom USING (cid, sid))), y AS (SELECT *, (cid + d) % 97 = 0 AS broken FROM x) "


@query(STATE + "SELECT cid || '|' || sid AS response_id, NOT broken AS ok, CASE WHEN NOT broken THEN dominant END AS dominant_emotion, round(CASE WHEN broken OR d % 3 = 0 THEN 0.8 ELSE stability END + 1e-7, 3)::DOUBLE AS stability_score, round(CASE WHEN broken THEN 0.7 ELSE intensity END + 1e-7, 3)::DOUBLE AS intensity_level, 0.9::DOUBLE AS arousal_level, 0.85::DOUBLE AS confidence FROM y")
def o_s2_state_response(spark: SparkSession, sf: str) -> DataFrame:
    return R.states(B.state_responses(spark, sf)).select("response_id", "ok", "dominant_emotion", F.round(F.col("stability_score") + 1e-7, 3).alias("stability_score"), F.round(F.col("intensity_level") + 1e-7, 3).alias("intensity_level"), "arousal_level", "confidence")


@query(STATE + ", z AS (SELECT *, CASE WHEN d % 5 = 0 THEN intensity + 1 ELSE intensity END AS i, CASE WHEN d % 7 <> 0 THEN dominant END AS dm FROM y) SELECT cid AS user_id, sid AS state_id, concat_ws(',', CASE WHEN dm IS NULL THEN 'dominant: missing' END, CASE WHEN i > 1 THEN 'intensity: out of range' END) AS violations FROM z WHERE dm IS NULL OR i > 1")
def o_f6_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.operators import quality as Q

    d = F.dayofmonth("observed_at")
    rows = B.psych_states(spark, sf).withColumns({"intensity": F.when(d % 5 == 0, F.col("intensity") + 1).otherwise(F.col("intensity")), "dominant": F.when(d % 7 != 0, F.col("dominant"))})
    ranges = {k: Q.RANGES[k] for k in ("intensity", "stability", "arousal")}
    return Q.quarantine(rows, ranges, ("dominant",))[1].select(F.col("character_id").alias("user_id"), "state_id", F.array_join("violations", ",").alias("violations"))
