"""Queries of retrieval, document quality and the end-to-end batch."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import changes as C
from palimpsest.operators import memory_graph as MG
from palimpsest.operators import memory_index as MI
from palimpsest.operators import messages as M
from palimpsest.operators import quality as Q
from palimpsest.operators import recall as R
from palimpsest.operators import shred, versions
from palimpsest.operators import states as S
from palimpsest.plans import bindings as B
from palimpsest.plans.base import CHAT, PROMPT, PSYCH, query
from palimpsest.plans.chat_queries import USAGE
from palimpsest.plans.world_queries import T0, T1
from palimpsest.sources.tables import written

_MEM = r"""WITH words AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w, coalesce(text, '') AS fact FROM documents),
mem AS (SELECT vec_id AS id, label AS gid, embedding::DOUBLE[] AS e, w, fact FROM embeddings JOIN words ON doc_id = vec_id),
pairs AS (SELECT q.id AS query_id, m.id AS memory_id, m.fact, round(list_dot_product(q.e, m.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(m.e, m.e))), 9) AS cosine,
  round(CASE WHEN len(q.w) = 0 OR len(m.w) = 0 THEN 0 ELSE len(list_intersect(q.w, m.w)) / len(list_distinct(list_concat(q.w, m.w))) END, 9) AS lexical
  FROM mem q JOIN mem m ON q.gid = m.gid AND q.id <> m.id WHERE q.id % 50 = 0),
ranked AS (SELECT *, round(1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, memory_id)), 9) AS score FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM ranked)
"""


@query(_MEM + "SELECT query_id, memory_id, round(cosine, 6) AS cosine, round(lexical, 6) AS lexical, rank FROM best WHERE rank <= 10")
def o_r1_memory_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(*B.memories(spark, sf)).select("query_id", "memory_id", F.round("cosine", 6).alias("cosine"), F.round("lexical", 6).alias("lexical"), F.col("rank").cast("long").alias("rank"))


_PAIR = r"""round(list_dot_product(q.e, m.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(m.e, m.e))), 9) AS cosine,
  round(CASE WHEN len(q.w) = 0 OR len(m.w) = 0 THEN 0 ELSE len(list_intersect(q.w, m.w)) / len(list_distinct(list_concat(q.w, m.w))) END, 9) AS lexical"""
_FACTS = r"""WITH words AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w, coalesce(text, '') AS fact FROM documents),
mem AS (SELECT vec_id AS id, label AS gid, embedding::DOUBLE[] AS e, w, fact FROM embeddings JOIN words ON doc_id = vec_id)
"""


@query(f"""{_FACTS.rstrip()}, pairs AS (SELECT q.id AS query_id, m.id AS memory_id, {_PAIR} FROM mem q JOIN mem m ON q.id <> m.id WHERE q.id % 50 = 0),
ranked AS (SELECT *, round(1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id)) + 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, memory_id)), 9) AS score FROM pairs)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank, strftime(TIMESTAMP '2024-01-01' + to_hours(memory_id), '%Y-%m-%d %H') AS created FROM ranked QUALIFY rank <= 10""")
def o_r1_all_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Search without the session filter; a memory comes with its time of creation (an hour for each id)."""
    queries, memories = B.memories(spark, sf)
    memories = memories.withColumn("created_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("memory_id").cast("int")))
    found = R.search(queries, memories, grouped=False, also=("created_at",))
    return found.select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), F.date_format("created_at", "yyyy-MM-dd HH").alias("created"))


_WALK = f"""{_FACTS.rstrip()}, men AS (SELECT DISTINCT id, gid, unnest(regexp_extract_all(fact, '{B.ENTITY}')) AS e FROM mem),
named AS (SELECT gid, e, count(*) AS n FROM men GROUP BY 1, 2), names AS (SELECT id, count(*) AS n FROM men GROUP BY 1),
start AS (SELECT id AS q, gid, e, 1 / count(*) OVER (PARTITION BY id) AS p FROM men WHERE id % 50 = 0),
m1 AS (SELECT q, gid, men.id, sum(p / named.n) AS p FROM start JOIN named USING (gid, e) JOIN men USING (gid, e) GROUP BY 1, 2, 3),
e2 AS (SELECT q, gid, e, sum(p) AS p FROM (SELECT q, gid, e, 0.3::DOUBLE * p AS p FROM start UNION ALL SELECT q, m1.gid, men.e, 0.7::DOUBLE * p / names.n FROM m1 JOIN men USING (id) JOIN names USING (id)) GROUP BY 1, 2, 3),
m2 AS (SELECT q AS query_id, men.id AS memory_id, round(sum(p / named.n), 12) AS mass FROM e2 JOIN named USING (gid, e) JOIN men USING (gid, e) GROUP BY 1, 2),
graph AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, memory_id) AS rank FROM m2 WHERE query_id <> memory_id)
"""


def _walked(spark: SparkSession, sf: str, top: int) -> DataFrame:
    named = written(B.mentions(spark, sf), "named")
    return MG.best(named.where("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), named, top)


@query(_WALK + "SELECT query_id, memory_id, rank, round(mass, 9) AS mass FROM graph WHERE rank <= 10")
def o_r1_graph_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten memories that walks from a query's entities reach most."""
    return _walked(spark, sf, 10).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), F.round("mass", 9).alias("mass"))


@query(f"""{_WALK.rstrip()}, pairs AS (SELECT q.id AS query_id, m.id AS memory_id, {_PAIR} FROM mem q JOIN mem m ON q.gid = m.gid AND q.id <> m.id WHERE q.id % 50 = 0),
legs AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS rank FROM pairs
  UNION ALL SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, memory_id) FROM pairs UNION ALL SELECT query_id, memory_id, rank FROM graph),
total AS (SELECT query_id, memory_id, count(*) AS n_legs, round(sum(1 / (60 + rank)), 9) AS score FROM legs WHERE rank <= 100 GROUP BY 1, 2)
SELECT query_id, memory_id, n_legs, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM total QUALIFY rank <= 10""")
def o_r1_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, words and the graph: the hundred best of each, fused."""
    graph = _walked(spark, sf, 100).select("query_id", "memory_id", F.lit("graph").alias("leg"), "rank")
    found = R.fused(R.similar(*B.memories(spark, sf)).unionByName(graph))
    return found.select("query_id", "memory_id", "n_legs", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def o_r1_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What the index finds of the ten nearest memories of all sessions, and how many memories it scores, for each query."""
    queries, memories = B.vectors(spark, sf)
    return MI.recall(MI.calibrated(MI.build(memories), grouped=False), queries, memories, grouped=False)


@query(_MEM + "SELECT query_id, memory_id, rank FROM best WHERE rank <= 5")
def o_w10_top_memories(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(*B.memories(spark, sf), k=5).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query(_MEM + "SELECT query_id, count(*) AS memories_used FROM best WHERE rank <= 10 GROUP BY 1")
def o_r3_memories_used(spark: SparkSession, sf: str) -> DataFrame:
    return R.memories_used(R.search(*B.memories(spark, sf)))


@query(_MEM + "SELECT query_id, memory_id, lexical AS similarity FROM (SELECT query_id, memory_id, round(lexical, 6) AS lexical FROM pairs)")
def o_u5_word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries against all memories of their group."""
    return R.overlaps(*B.memories(spark, sf)).withColumnRenamed("lexical", "similarity")


def _context(spark: SparkSession, sf: str, prompts: DataFrame, found: DataFrame) -> DataFrame:
    turns = shred.dialog_turns(prompts)
    last = M.last_user_message(B.table(spark, sf, "conversations"), "conv_id").select(F.col("conv_id").alias("session_id"), F.lit("user").alias("role"), F.col("text").alias("content"), "error")
    return R.context(shred.instructions(prompts), turns, last, R.memory_summary(found.withColumn("session_id", F.col("query_id")), "session_id"))


def _sizes() -> list[Column]:
    """system_chars and n_messages of contexts."""
    system = F.when(F.col("messages")[0]["role"] == "system", F.length(F.col("messages")[0]["content"])).otherwise(0)
    fine = F.col("messages").isNotNull()
    return [F.when(fine, system).cast("long").alias("system_chars"), F.when(fine, F.size("messages")).cast("long").alias("n_messages")]


_CONTEXT_PARTS = _MEM.replace("WITH ", f"WITH {PROMPT}, ", 1) + """, summary AS (SELECT query_id AS session_id, string_agg('- ' || fact, chr(10) ORDER BY rank) AS s FROM best WHERE rank <= 5 GROUP BY 1),
head AS (SELECT session_id, coalesce(system, '') || coalesce(chr(10) || chr(10) || '相关记忆：' || chr(10) || s, '') AS sys FROM pr LEFT JOIN summary USING (session_id)),
lastu AS (SELECT conv_id AS session_id, arg_max(text, turn) FILTER (role = 'user') AS content, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no user message' END AS error FROM conversations GROUP BY 1)
"""
_SIZES = """CASE WHEN error IS NULL THEN length(sys) END AS system_chars,
  CASE WHEN error IS NULL THEN (CASE WHEN sys = '' THEN 0 ELSE 1 END + least(5, (SELECT count(*) FROM turns t WHERE t.session_id = head.session_id)) + 1)::BIGINT END AS n_messages, error"""
_CONTEXT = _CONTEXT_PARTS + f"SELECT session_id, {_SIZES}, content AS last_content FROM head JOIN lastu USING (session_id)"


@query(_CONTEXT)
def o_r2_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = _context(spark, sf, written(B.prompts(spark, sf), "prompts"), R.search(*B.memories(spark, sf)))
    return rows.select("session_id", *_sizes(), F.element_at("messages", -1)["content"].alias("last_content"), "error")


@query(_MEM.rstrip() + f""", {USAGE}, a AS (SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, 'chatcmpl-' || md5(conv_id::VARCHAR) AS id, content, prompt_tokens + completion_tokens AS total_tokens, (SELECT count(*) FROM best WHERE rank <= 10 AND query_id = conv_id)::INTEGER AS memories_used FROM u JOIN a USING (conv_id)""")
def o_s7_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completion records as JSON, written and read back; the memories used are those that the search found."""
    rows = B.table(spark, sf, "conversations")
    used = R.memories_used(R.search(*B.memories(spark, sf))).select(F.col("query_id").alias("conv_id"), F.col("memories_used").cast("int").alias("memories_used"))
    answers = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content")).join(used, "conv_id", "left").fillna(0, ["memories_used"])
    back = written(M.completions(M.usage(rows, "conv_id"), answers, "conv_id", "any", 1700000000), "completions", kind="json")
    at = lambda p: F.get_json_object("completion", p)
    return back.select("conv_id", at("$.id").alias("id"), at("$.choices[0].message.content").alias("content"), at("$.usage.total_tokens").cast("long").alias("total_tokens"), at("$.extra.memories_used").cast("int").alias("memories_used"))


_E1 = _CONTEXT_PARTS.replace("WITH ", f"WITH {PSYCH}, {CHAT}, ", 1) + """, past AS (SELECT DISTINCT conv_id AS s FROM conversations WHERE conv_id % 11 <> 0),
ow AS (SELECT s, 'location:town_' || ((s + s % 2) % 7) AS e, 'a quiet place' AS t FROM past UNION ALL SELECT s, 'character:hero_' || (s % 5), CASE WHEN s % 3 = 1 THEN 'a shy one' ELSE 'a brave one' END FROM past),
nw AS (SELECT session_id AS s, 'location:town_' || (session_id % 7) AS e, 'a quiet place' AS t FROM pr UNION ALL SELECT session_id, 'character:hero_' || (session_id % 5), 'a brave one' FROM pr),
wf AS (SELECT coalesce(ow.s, nw.s) AS session_id, CASE WHEN ow.s IS NULL THEN 'added' WHEN nw.s IS NULL THEN 'removed' WHEN ow.t = nw.t THEN 'unchanged' ELSE 'modified' END AS k FROM ow FULL JOIN nw ON ow.s = nw.s AND ow.e = nw.e),
wd AS (SELECT session_id, count(*) FILTER (k = 'added') AS n_added, count(*) FILTER (k = 'removed') AS n_removed, count(*) FILTER (k = 'modified') AS n_modified, count(*) FILTER (k = 'unchanged') AS n_unchanged, count(*) FILTER (k <> 'removed') AS n_active,
  count(*) + count(*) FILTER (k = 'modified') AS n_versions, (CASE WHEN session_id % 11 = 0 THEN 1 ELSE 2 END)::BIGINT AS state_version FROM wf GROUP BY 1),
last_move AS (SELECT cid, arg_max(kind, sid) AS transition_type, arg_max(score, sid) AS rationality_score, count(*) AS n_transitions FROM trn GROUP BY 1)
SELECT session_id, (SELECT count(*) FROM narr x WHERE x.session_id = head.session_id) AS n_episodes, (SELECT count(*) FROM turns t WHERE t.session_id = head.session_id) AS n_turns, n_added, n_removed, n_modified, n_unchanged, n_active, n_versions, state_version,
  chat.change AS chat_change, chat.d AS chat_diff_index, transition_type, rationality_score, coalesce(n_transitions, 0) AS n_transitions, (SELECT count(*) FROM best WHERE rank <= 10 AND query_id = head.session_id) AS memories_used, """ + _SIZES + """
FROM head JOIN lastu USING (session_id) LEFT JOIN wd USING (session_id) LEFT JOIN chat USING (session_id) LEFT JOIN last_move ON cid = session_id
"""


KINDS = ("added", "removed", "modified", "unchanged")


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of all requests, the reference entries before them, and how these change, staged."""
    parts = written(shred.request_parts(B.prompts(spark, sf)), "requests")
    texts = parts.select("session_id", F.explode("reference").alias("text"))
    old, new = (C.first_of_id(shred.entries(t)) for t in (B.earlier_worlds(spark, sf), texts))
    return parts, old, written(C.change_feed(old, new).select(*C.KEYS, "change", "old", "new"), "feed")


@query(_E1)
def o_e1_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions' requests at once: prompts to tables, the change of the reference entries and its sync into the store
    of versions, the change of the chat, the character's last transition, recalled memories and the assembled context.

    The character of a session is the user of its number.
    """
    with ThreadPoolExecutor(1) as beside:  # two chains of jobs that do not depend on each other
        searched = beside.submit(lambda: R.search(*B.memories(spark, sf)))
        parts, old, feed = _requests(spark, sf)
        found = R.recalled(searched.result()).withColumnRenamed("query_id", "session_id")
    of = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    world = feed.groupBy("session_id").agg(*[of(c).alias(f"n_{c}") for c in KINDS], of("added", "modified", "unchanged").alias("n_active"), (F.max(F.col("old").isNotNull().cast("long")) + 1).alias("state_version"))
    store = versions.sync(versions.initial(old, T0), feed, T1).groupBy("session_id").agg(F.count("*").alias("n_versions"))
    chat = C.chat_changes(*B.chats(spark, sf)).select("session_id", F.col("change").alias("chat_change"), F.col("diff_index").alias("chat_diff_index"))
    moves = S.transitions(B.psych_states(spark, sf), digits=B.DIGITS).groupBy(F.col("character_id").alias("session_id")).agg(
        F.max_by("transition_type", "observed_at").alias("transition_type"), F.max_by("rationality_score", "observed_at").alias("rationality_score"), F.count("*").alias("n_transitions"))
    last = M.last_user_message(B.table(spark, sf, "conversations"), "conv_id").select(F.col("conv_id").alias("session_id"), F.col("text").alias("last_text"), "error")
    recent = F.transform(F.slice("turns", F.greatest(F.size("turns") - 4, F.lit(1)), 5), lambda t: F.struct(F.lower(t["role"]).alias("role"), t["content"].alias("content")))
    asked = parts.select("session_id", F.lit(True).alias("asked"), "instruction", recent.alias("recent"), F.size("turns").cast("long").alias("n_turns"), F.col("n_narratives").alias("n_episodes"))
    # Each part has at most one row a session, so one grouping of all of them stands for a join of each.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (last, world, store, chat, moves, found), asked)
    rows = rows.groupBy("session_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != "session_id"]).where("asked")
    whole = R.messages(F.col("instruction"), F.col("recent"), F.col("summary"), F.struct(F.lit("user").alias("role"), F.col("last_text").alias("content")))
    rows = rows.withColumn("messages", F.when(F.col("error").isNull(), whole)).fillna(0, ["n_transitions", "memories_used"]).fillna(1, ["state_version"])
    return rows.select("session_id", "n_episodes", "n_turns", *[f"n_{c}" for c in KINDS], "n_active", "n_versions", "state_version", "chat_change", "chat_diff_index", "transition_type", F.round("rationality_score", 6).alias("rationality_score"), "n_transitions", "memories_used", *_sizes(), "error")


_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT source, count(*) AS n, count(*) FILTER (c IS DISTINCT FROM text) AS n_changed, count(*) FILTER (length(c) > 10000) AS n_cut FROM (SELECT source, text, CASE WHEN length(k) > 10000 THEN substr(k, 1, 10000) || '...' ELSE k END AS c FROM (SELECT source, text, {_CLEAN} AS k FROM documents)) GROUP BY 1")
def o_f10_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    return Q.hygiene_profile(B.table(spark, sf, "documents"))


@query(f"SELECT doc_id, md5(CASE WHEN length(k) > 10000 THEN substr(k, 1, 10000) || '...' ELSE k END) AS hash FROM (SELECT doc_id, {_CLEAN} AS k FROM documents)")
def o_c9_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.sanitize(F.col("text")).cast("binary")).alias("hash"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS preview FROM documents")
def o_c10_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 100).alias("preview"))


@query(r"SELECT source, count(*) AS n_tokens, round(avg(CASE WHEN regexp_matches(w, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 1 ELSE 0 END), 6) AS share FROM (SELECT source, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE contains(w, '@') GROUP BY 1")
def o_f9_email_profile(spark: SparkSession, sf: str) -> DataFrame:
    return Q.email_profile(B.table(spark, sf, "documents")).withColumn("share", F.round("share", 6))


_TRIM = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))"
_NORM = f"md5(translate(regexp_replace({_TRIM}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '：，。', ':,.'))"


@query(f"SELECT {_NORM} AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def o_a11_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return Q.duplicate_groups(B.table(spark, sf, "documents"), T.content_hash(F.coalesce("text", F.lit(""))))


_MARK = r"CASE WHEN regexp_matches(l, '^#{1,6}\s') THEN regexp_extract(l, '^#+') WHEN regexp_matches(l, '^\s*[-*+]\s') THEN '-' WHEN trim(l) = '' THEN '' ELSE 'text' END"


@query(f"SELECT md5(list_aggregate(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_MARK}), 'string_agg', chr(10))) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def o_a12_structural_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return Q.duplicate_groups(B.table(spark, sf, "documents"), F.md5(T.structural_fingerprint(F.coalesce("text", F.lit(""))).cast("binary")))
