"""Queries over chat histories, prompts and messages (conversations)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import analysis as A
from palimpsest.operators import changes as C
from palimpsest.operators import messages as M
from palimpsest.operators import scoring, shred
from palimpsest.plans.base import CHAT, PROMPT, query, trimmed
from palimpsest.plans.bindings import chats, flat, prompts, table
from palimpsest.sources.responses import read_messages
from palimpsest.sources.tables import shared_dir, written

_C, _P = f"WITH {CHAT} ", f"WITH {PROMPT} "


@query(_C + "SELECT session_id, change, d AS diff_index, CASE change WHEN 'append' THEN len(nl) - len(ol) ELSE 0 END::BIGINT AS n_new, CASE change WHEN 'truncation' THEN len(ol) - len(nl) ELSE 0 END::BIGINT AS n_removed FROM chat")
def o_d2_chat_change(spark: SparkSession, sf: str) -> DataFrame:
    return C.chat_changes(*chats(spark, sf)).select("session_id", "change", "diff_index", "n_new", "n_removed")


@query(_C + "SELECT session_id, d AS diff_index FROM chat")
def o_w8_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    return C.chat_changes(*chats(spark, sf)).select("session_id", "diff_index")


@query(_C + "SELECT session_id, turn, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new USING (session_id, turn) WHERE old.h IS DISTINCT FROM new.h")
def o_j10_message_diff(spark: SparkSession, sf: str) -> DataFrame:
    return C.message_diff(*chats(spark, sf)).select("session_id", "turn", "change")


@query(_C + "SELECT new.session_id, new.turn, new.h AS content_hash, CASE WHEN change = 'no_change' THEN 1 WHEN len(ol) = 0 THEN 1 ELSE 2 END AS version FROM new JOIN chat USING (session_id)")
def o_d3_chat_state(spark: SparkSession, sf: str) -> DataFrame:
    return C.chat_state(*chats(spark, sf)).select("session_id", "turn", "content_hash", "version")


@query(_C + "SELECT session_id, new.turn, new.h AS content_hash FROM new JOIN chat USING (session_id) WHERE change = 'append'")
def o_u2_append_state(spark: SparkSession, sf: str) -> DataFrame:
    return C.appended(*chats(spark, sf))


@query(_C + "SELECT (SELECT count(DISTINCT source) FROM documents) AS world_states, (SELECT count(DISTINCT session_id) FROM new) AS chat_states, (SELECT count(DISTINCT user_id) FROM events) AS psych_records")
def o_a3_health_counters(spark: SparkSession, sf: str) -> DataFrame:
    world = table(spark, sf, "documents").agg(F.count_distinct("source").alias("world_states"))
    chat = chats(spark, sf)[1].agg(F.count_distinct("session_id").alias("chat_states"))
    psych = table(spark, sf, "events").agg(F.count_distinct("user_id").alias("psych_records"))
    return world.join(chat, F.lit(True)).join(psych, F.lit(True))  # three tables of one row


_SECTIONS = """s AS (SELECT session_id, 0 AS k, '核心指导' AS tag, length(system) AS n FROM pr WHERE system IS NOT NULL
  UNION ALL SELECT session_id, 1, '相关资料', length('地点("town_0")["a quiet place"]' || '角色("hero_0")["a brave one"]') + 4 FROM pr
  UNION ALL SELECT session_id, 2, '互动历史', length(history) + 2 FROM pr UNION ALL SELECT session_id, 3, '补充资料', length('note ' || session_id) FROM pr)"""


@query(_P.rstrip() + f", {_SECTIONS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS pos, tag, n AS n_chars FROM s")
def o_p1_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompts(spark, sf).select("session_id", F.posexplode(shred.sections(F.col("prompt"))).alias("pos", "s"))
    return rows.select("session_id", F.col("pos").cast("long").alias("pos"), "s.tag", F.length("s.body").cast("long").alias("n_chars"))


@query(_P.rstrip() + f", {_SECTIONS} SELECT session_id, tag, CASE tag WHEN '核心指导' THEN 'core_instruction' WHEN '相关资料' THEN 'world_info' WHEN '互动历史' THEN 'dialog' ELSE 'supplementary' END AS kind_type FROM s")
def o_p2_routes(spark: SparkSession, sf: str) -> DataFrame:
    return shred.tagged(prompts(spark, sf)).select("session_id", "tag", F.col("type").alias("kind_type"))


@query(_P + "SELECT session_id, system AS content, 'core_instruction' AS instruction_type, 0 AS priority FROM pr WHERE system IS NOT NULL")
def o_p3_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return shred.instructions(prompts(spark, sf)).select("session_id", "content", "instruction_type", "priority")


@query(_P + "SELECT session_id, content FROM narr WHERE block_type = 'world_info'")
def o_p4_world_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return shred.narratives(prompts(spark, sf)).where("block_type = 'world_info'").select("session_id", "content")


@query(_P + "SELECT session_id, location, hero AS character FROM narr WHERE block_type = 'world_info'")
def o_p5_world_metadata(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return shred.narratives(prompts(spark, sf)).where("block_type = 'world_info'").select("session_id", at("location"), at("character"))


@query(_P + "SELECT session_id, pos, role, content FROM turns")
def o_p6_dialog_turns(spark: SparkSession, sf: str) -> DataFrame:
    return shred.dialog_turns(prompts(spark, sf)).select("session_id", F.col("pos").cast("long").alias("pos"), "role", "content")


@query(_P + "SELECT session_id, history <> '' AS is_dialog FROM pr")
def o_p7_dialog_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("session_id", shred.is_dialog(F.col("prompt")).alias("is_dialog"))


@query(_P + "SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'tail ' || session_id ELSE '' END AS rest FROM pr")
def o_p8_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("session_id", shred.remainder(F.col("prompt")).alias("rest"))


@query(_P + """SELECT session_id, CASE WHEN system IS NULL THEN 0 ELSE 1 END::BIGINT AS n_instructions, (3 + CASE WHEN session_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_narratives,
  (SELECT count(*) FROM turns t WHERE t.session_id = prompts.session_id) AS n_turns, length(prompt) AS original_length FROM prompts""")
def o_p9_shred(spark: SparkSession, sf: str) -> DataFrame:
    return shred.shredded(prompts(spark, sf))


@query(_P + "SELECT session_id, block_type, content, confidence::DOUBLE AS confidence FROM narr")
def o_u3_narratives(spark: SparkSession, sf: str) -> DataFrame:
    return shred.narratives(prompts(spark, sf)).select("session_id", "block_type", "content", "confidence")


@query(_P + f"SELECT session_id, pos AS turn_number, role, md5({trimmed('role || chr(58) || content')}) AS content_hash, 'msg_' || session_id || '_' || pos AS message_id FROM turns WHERE content <> ''")
def o_p12_chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    body = shred.tagged(prompts(spark, sf)).where("kind = 'dialog'").select("session_id", "body")
    return shred.chat_messages(body, text="body").select("session_id", F.col("turn_number").cast("long").alias("turn_number"), "role", "content_hash", "message_id")


@query(_P + """, named AS (SELECT DISTINCT session_id, coalesce(location, hero) AS name FROM narr WHERE coalesce(location, hero) IS NOT NULL)
SELECT session_id, (SELECT count(*) FROM narr x WHERE x.session_id = pr.session_id) AS episodes_added, (SELECT count(*) FROM named x WHERE x.session_id = pr.session_id) AS entities_extracted,
  (SELECT count(*) FROM named x WHERE x.session_id = pr.session_id) AS relationships_created FROM pr""")
def o_a1_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Narratives as episodes, the places and characters that they name as entities, and who is named in which episode
    as relations."""
    rows = written(shred.narratives(prompts(spark, sf)), "narratives")
    named = rows.select("session_id", "section", "block", F.explode(F.map_filter("metadata", lambda k, _: k.isin("location", "character"))).alias("kind", "name"))
    return A.ingest_stats(rows, named.select("session_id", "kind", "name").distinct(), named.distinct())


@query(_P + "SELECT session_id, CASE WHEN block_type = 'world_info' THEN 'World Info - ' || coalesce(location, 'Unknown') ELSE 'General Content - 2024-02-01 00:00:00' END AS episode_name, 'text' AS kind FROM narr")
def o_p15_narrative_names(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.operators import versions

    rows = shred.narratives(prompts(spark, sf))
    return rows.select("session_id", versions.narrative_name(F.lit("2024-02-01 00:00:00")).alias("episode_name"), versions.narrative_kind().alias("kind"))


def _parts(parts: tuple[str, ...], *values: str) -> str:
    """SQL of a prompt."""
    cells = [f"coalesce(nullif({v}, ''), '{A.UNKNOWN}')" for v in values]
    return " || ".join([x for p, c in zip(parts, cells) for x in (f"'{p}'", c)] + [f"'{parts[-1]}'"])


_HEROES = """'"hero_' || (session_id % 5) || '"'"""


_PROMPTS = _P.rstrip() + f""", l AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS dialog FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS k FROM turns) WHERE k <= 5 GROUP BY 1),
asked AS (SELECT session_id, 'state' AS kind, {_parts(A.STATE_PARTS, _HEROES, "''", "dialog")} AS prompt FROM l
UNION ALL SELECT session_id, 'causal', {_parts(A.CAUSAL_PARTS, "content", _HEROES, "location", "''")} FROM narr)
"""


@query(_P.rstrip() + f""", l AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS dialog FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS k FROM turns) WHERE k <= 5 GROUP BY 1)
SELECT session_id, 'state' AS kind, md5({_parts(A.STATE_PARTS, _HEROES, "''", "dialog")}) AS prompt, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT session_id, 'causal', md5({_parts(A.CAUSAL_PARTS, "content", _HEROES, "location", "''")}), count(*) FROM narr GROUP BY ALL""")
def o_p19_analysis_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the texts for an offline batch scorer: one for the dialog of a session, one for each narrative."""
    return _analysis_prompts(spark, sf).groupBy("session_id", "kind", F.md5(F.col("prompt").cast("binary")).alias("prompt")).agg(F.count("*").alias("n"))


def _analysis_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(prompts(spark, sf), "prompts")
    narratives = shred.narratives(rows).select("session_id", "content", F.try_element_at("metadata", F.lit("location")).alias("place"), F.try_element_at("metadata", F.lit("character")).alias("who"))
    heroes = narratives.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("who")), ", ").alias("heroes"))
    turns = shred.dialog_turns(rows).select("session_id", F.col("pos").alias("turn"), "role", F.col("content").alias("text"))
    state = M.recent_dialog(turns, "session_id").join(heroes, "session_id", "left").select("session_id", F.lit("state").alias("kind"), A.state_prompt(F.col("heroes"), F.col("dialog")).alias("prompt"))
    causal = narratives.join(heroes, "session_id", "left").select("session_id", F.lit("causal").alias("kind"), A.causal_prompt(F.col("content"), F.col("heroes"), F.col("place"), F.lit("")).alias("prompt"))
    return state.unionByName(causal)


def _stand_in(prompt: str, attempt: int) -> str:
    """In place of a model: counts characters. A prompt fails as often as the last digit of its length says, from 7 on always."""
    if attempt <= len(prompt) % 10 - 5 or len(prompt) % 10 >= 7:
        raise ValueError(f"attempt {attempt}")
    return str(len(prompt))


@query(_PROMPTS + """SELECT session_id, kind, length(prompt) AS n_chars, CASE WHEN length(prompt) % 10 >= 7 THEN 'dead' ELSE 'answered' END AS status, CASE WHEN length(prompt) % 10 >= 7 THEN 3 ELSE greatest(1, length(prompt) % 10 - 4) END::INTEGER AS attempts,
  CASE WHEN length(prompt) % 10 < 7 THEN length(prompt)::VARCHAR END AS answer, CASE WHEN length(prompt) % 10 >= 7 THEN 'ValueError: attempt 3' END AS error, count(*) AS n FROM asked GROUP BY ALL""")
def o_p19_scored_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """All analysis prompts through the batch scorer, which is cut off after its first round and started again."""
    asked, path = written(_analysis_prompts(spark, sf), "analysis_prompts"), f"{shared_dir(spark)}/outcomes-{uuid.uuid4().hex}"
    scoring.score(asked, _stand_in, path, rounds=1)
    scoring.score(asked, _stand_in, path)
    rows = scoring.answers(asked, path).select("session_id", "kind", F.length("prompt").cast("long").alias("n_chars"), "status", "attempts", "answer", "error")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, length(text) AS n_chars FROM conversations")
def o_s1_message_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with message arrays as JSON, written, scanned with an explicit schema and exploded."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rows = _messages(spark, sf).groupBy("conv_id").agg(messages.alias("messages")).select(F.concat(F.lit("req-"), F.col("conv_id").cast("string")).alias("request_id"), F.col("conv_id").cast("string").alias("session_id"), "messages")
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    rows.write.json(path)
    return read_messages(spark, path).select(F.col("session_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'hdr-' || conv_id WHEN 1 THEN 'body-' || conv_id WHEN 2 THEN CASE WHEN bool_or(role = 'system') THEN 'sys-' || conv_id ELSE 'sess-' || md5(conv_id::VARCHAR) END ELSE 'sess-' || md5(conv_id::VARCHAR) END AS session_id FROM conversations GROUP BY conv_id")
def o_p13_session_id(spark: SparkSession, sf: str) -> DataFrame:
    c, k = F.col("conv_id").cast("string"), F.col("conv_id") % 4
    text = F.when((k == 2) & (F.col("role") == "system"), F.concat(F.lit("SESSION_ID: sys-"), c, F.lit(" "), "text")).otherwise(F.col("text"))
    rows = _messages(spark, sf).withColumns({"header_id": F.when(k == 0, F.concat(F.lit("hdr-"), c)), "body_id": F.when(k == 1, F.concat(F.lit("body-"), c)), "text": text})
    return M.session_ids(rows, "conv_id")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS text, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no user message' END AS error FROM conversations GROUP BY 1")
def o_w3_last_user_message(spark: SparkSession, sf: str) -> DataFrame:
    return M.last_user_message(_messages(spark, sf), "conv_id")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialog FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5 GROUP BY 1")
def o_w2_recent_dialog(spark: SparkSession, sf: str) -> DataFrame:
    return M.recent_dialog(_messages(spark, sf), "conv_id")


_SPEAKER = "'hero_' || ((conv_id + turn) % 3)"


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).withColumn("speaker", F.concat(F.lit("hero_"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")))


@query(f"SELECT conv_id, arg_min({_SPEAKER}, turn) AS character_id FROM conversations WHERE role = 'assistant' GROUP BY 1")
def o_w4_main_character(spark: SparkSession, sf: str) -> DataFrame:
    return M.main_character(_spoken(spark, sf), "conv_id")


@query(f"SELECT conv_id, string_agg(DISTINCT {_SPEAKER}, ',' ORDER BY {_SPEAKER}) AS characters FROM conversations WHERE role = 'assistant' GROUP BY 1")
def o_a10_characters(spark: SparkSession, sf: str) -> DataFrame:
    return M.characters(_spoken(spark, sf), "conv_id").withColumn("characters", F.array_join("characters", ","))


USAGE = r"""u AS (SELECT conv_id, coalesce(sum(w) FILTER (role <> 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum(w) FILTER (role = 'assistant'), 0)::BIGINT AS completion_tokens
  FROM (SELECT conv_id, role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY 1)"""


@query(f"WITH {USAGE} SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM u")
def o_a13_usage(spark: SparkSession, sf: str) -> DataFrame:
    return M.usage(_messages(spark, sf), "conv_id")
