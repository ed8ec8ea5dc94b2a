"""The registry that query modules add to, and the bindings of `bindings` as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives its rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(c: str) -> str:
    return f"trim(translate(coalesce({c}, ''), chr(10) || '\"', ' '''))"


def trimmed(c: str) -> str:
    return f"trim({c}, ' ' || chr(10) || chr(9) || chr(13))"


PSYCH = """
ev AS (SELECT user_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
tot AS (SELECT user_id AS cid, strftime(day, '%Y-%m-%d') AS sid, count(*) AS n, round(1 - least(stddev_pop(value) / 100, 1), 6) AS stability,
  round(least(avg(value) / 100, 1), 6) AS intensity, round(least(count(*) / 10, 1), 6) AS arousal FROM ev GROUP BY user_id, day),
emo AS (SELECT cid, sid, event_type AS name, round(count(*) / any_value(n), 6) AS v, count(*) AS k
  FROM ev JOIN tot ON cid = user_id AND sid = strftime(day, '%Y-%m-%d') GROUP BY cid, sid, event_type),
dom AS (SELECT cid, sid, name AS dominant FROM emo QUALIFY row_number() OVER (PARTITION BY cid, sid ORDER BY k DESC, name) = 1),
tra AS (SELECT user_id AS cid, strftime(day, '%Y-%m-%d') AS sid, CASE event_type WHEN 'click' THEN 'joy' WHEN 'view' THEN 'optimistic' WHEN 'purchase' THEN 'enthusiastic' WHEN 'error' THEN 'anxious' WHEN 'signup' THEN 'flexible' ELSE event_type END AS name,
  round(avg(least(value / 100, 1)), 6) AS v FROM ev GROUP BY user_id, day, event_type),
seq AS (SELECT *, lag(sid) OVER w AS psid, lag(stability) OVER w AS pstab FROM tot WINDOW w AS (PARTITION BY cid ORDER BY sid)),
nxt AS (SELECT * FROM seq WHERE psid IS NOT NULL),
emoc AS (SELECT cid, sid, name, coalesce(o.v, 0) AS old, coalesce(c.v, 0) AS new, round(coalesce(c.v, 0) - coalesce(o.v, 0), 6) AS delta
  FROM (SELECT nxt.cid, nxt.sid, e.name, e.v FROM nxt JOIN emo e ON e.cid = nxt.cid AND e.sid = nxt.sid) c
  FULL JOIN (SELECT nxt.cid, nxt.sid, e.name, e.v FROM nxt JOIN emo e ON e.cid = nxt.cid AND e.sid = nxt.psid) o USING (cid, sid, name)
  WHERE coalesce(o.v, 0) <> coalesce(c.v, 0)),
trac AS (SELECT nxt.cid, nxt.sid, a.name, b.v AS old, a.v AS new, round(a.v - b.v, 6) AS delta
  FROM nxt JOIN tra a ON a.cid = nxt.cid AND a.sid = nxt.sid JOIN tra b ON b.cid = nxt.cid AND b.sid = nxt.psid AND b.name = a.name WHERE a.v <> b.v),
ea AS (SELECT cid, sid, count(*) AS n, round(avg(abs(delta)), 6) AS mean, max(abs(delta)) AS top FROM emoc GROUP BY cid, sid),
ta AS (SELECT cid, sid, count(*) AS n, round(avg(abs(delta)), 6) AS mean FROM trac GROUP BY cid, sid),
tr AS (SELECT nxt.cid, nxt.sid, nxt.psid, round(nxt.stability - nxt.pstab, 6) AS ds, coalesce(ea.n, 0) AS ne, coalesce(ta.n, 0) AS nt, coalesce(ea.mean, 0) AS em, coalesce(ea.top, 0) AS et, coalesce(ta.mean, 0) AS tm
  FROM nxt LEFT JOIN ea USING (cid, sid) LEFT JOIN ta USING (cid, sid)),
trn AS (SELECT *, CASE WHEN ne = 0 AND nt = 0 THEN 'stable' WHEN abs(ds) > 0.3 THEN 'sudden_shift' WHEN abs(ds) > 0.1 THEN 'gradual_change' ELSE 'evolution' END AS kind,
  round(greatest(0, least(1, 1 - CASE WHEN em > 0.4 THEN 0.3 WHEN em > 0.2 THEN 0.1 ELSE 0 END - CASE WHEN et > 0.6 THEN 0.2 ELSE 0 END - CASE WHEN tm > 0.3 THEN 0.2 ELSE 0 END - CASE WHEN abs(ds) > 0.2 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM tr)
"""

# After PSYCH.
REASON = """, parts AS (
  SELECT cid, sid, 1 AS g, name, CASE WHEN abs(delta) > 0.3 THEN '情绪''' || name || '''显著' || CASE WHEN delta > 0 THEN '增强' ELSE '减弱' END WHEN abs(delta) > 0.1 THEN '情绪''' || name || '''' || CASE WHEN delta > 0 THEN '增强' ELSE '减弱' END END AS t FROM emoc
  UNION ALL SELECT cid, sid, 2, name, CASE WHEN abs(delta) > 0.2 THEN '特质''' || name || '''强度显著' || CASE WHEN delta > 0 THEN '增强' ELSE '减弱' END END FROM trac
  UNION ALL SELECT cid, sid, 3, '', CASE WHEN abs(ds) > 0.2 THEN '心理稳定性' || CASE WHEN ds > 0 THEN '提升' ELSE '下降' END END FROM tr),
reasons AS (SELECT cid, sid, string_agg(t, '; ' ORDER BY g, name) AS reason FROM parts WHERE t IS NOT NULL GROUP BY cid, sid)
"""

_BODY = flat("text")
WORLD = f"""
d AS (SELECT doc_id, source AS session_id, CASE lang WHEN 'en' THEN 'location' WHEN 'fr' THEN 'character' WHEN 'de' THEN 'concept' ELSE 'general' END AS kind, 'doc_' || doc_id AS name, {_BODY} AS body FROM documents),
edited AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN body || body WHEN 1 THEN substr(body, 1, length(body) // 2) WHEN 2 THEN '0123456789' WHEN 3 THEN body || ' x' ELSE body END AS content FROM d WHERE doc_id % 10 <> 1),
both_sides AS (SELECT 'old' AS side, *, body AS content FROM d WHERE doc_id % 10 <> 0 UNION ALL SELECT 'new' AS side, * FROM edited),
r AS (SELECT side, doc_id, session_id, kind, name, kind || ':' || name AS entry_id, content AS inner_content,
  trim(CASE kind WHEN 'general' THEN name || chr(10) || content ELSE CASE kind WHEN 'location' THEN '地点' WHEN 'character' THEN '角色' ELSE '概念' END || '("' || name || '")["' || content || '"]' END, ' ' || chr(10)) AS content FROM both_sides),
o AS (SELECT * FROM r WHERE side = 'old'), n AS (SELECT * FROM r WHERE side = 'new'),
feed AS (SELECT session_id, entry_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.name, o.name) AS name, o.content AS oc, n.content AS nc,
  CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' WHEN o.content = n.content THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n USING (session_id, entry_id)),
mod AS (SELECT *, round(1 - len(list_intersect(list_distinct(string_split(oc, '')), list_distinct(string_split(nc, '')))) / len(list_distinct(list_concat(string_split(oc, ''), string_split(nc, '')))), 9) AS pct FROM feed WHERE change = 'modified'),
diff AS (SELECT *, CASE WHEN pct > 0.7 THEN 'replacement' WHEN length(nc) > 1.5 * length(oc) THEN 'expansion' WHEN length(nc) < 0.7 * length(oc) THEN 'reduction' ELSE 'update' END AS change_type FROM mod)
"""

_HASH = "md5(" + trimmed("role || ':' || text") + ")"
CHAT = f"""
c AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
old AS (SELECT session_id, turn, role, text, {_HASH} AS h FROM c WHERE session_id % 6 <> 5),
new0 AS (SELECT session_id, turn, role, CASE WHEN (session_id % 6 = 3 AND turn = 0) OR (session_id % 6 = 4 AND turn = n // 2) THEN text || ' edited' ELSE text END AS text FROM c WHERE session_id % 6 <> 2 OR turn < n - 1
  UNION ALL SELECT session_id, n, 'user', 'one more turn' FROM c WHERE session_id % 6 = 1 AND turn = n - 1),
new AS (SELECT session_id, turn, role, text, {_HASH} AS h FROM new0),
lists AS (SELECT session_id, coalesce(a.l, []) AS ol, coalesce(b.l, []) AS nl FROM (SELECT session_id, list(h ORDER BY turn) AS l FROM old GROUP BY 1) a FULL JOIN (SELECT session_id, list(h ORDER BY turn) AS l FROM new GROUP BY 1) b USING (session_id)),
placed AS (SELECT *, CASE WHEN ol = nl THEN NULL ELSE coalesce((SELECT min(i) FROM range(0, least(len(ol), len(nl))) t(i) WHERE ol[i + 1] <> nl[i + 1]), least(len(ol), len(nl))) END AS d FROM lists),
chat AS (SELECT *, CASE WHEN d IS NULL THEN 'no_change' WHEN len(nl) = 0 THEN 'truncation' WHEN len(ol) > 0 AND d = 0 THEN 'modification' WHEN len(nl) > len(ol) AND d >= len(ol) THEN 'append' WHEN len(nl) < len(ol) AND d >= len(nl) THEN 'truncation' ELSE 'modification' END AS change FROM placed)
"""

PROMPT = f"""
m AS (SELECT conv_id AS session_id, turn, role, {flat('text')} AS text FROM conversations),
pr AS (SELECT session_id, arg_min(text, turn) FILTER (role = 'system') AS system, coalesce(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS history FROM m GROUP BY 1),
prompts AS (SELECT session_id, system, coalesce('<核心指导>' || system || '</核心指导>' || chr(10), '') || '<相关资料>' || chr(10) || '地点("town_' || (session_id % 7) || '")["a quiet place"]' || chr(10) || chr(10) || '角色("hero_' || (session_id % 5) || '")["a brave one"]' || chr(10) || '</相关资料>' || chr(10)
  || '<互动历史>' || chr(10) || history || chr(10) || '</互动历史>' || chr(10) || '<补充资料>note ' || session_id || '</补充资料>' || CASE WHEN session_id % 3 = 0 THEN chr(10) || 'tail ' || session_id ELSE '' END AS prompt FROM pr),
turns AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pos, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END AS role, text AS content FROM m WHERE role <> 'system'),
narr AS (SELECT session_id, 'world_info' AS block_type, '地点("town_' || (session_id % 7) || '")["a quiet place"]' AS content, '"town_' || (session_id % 7) || '"' AS location, NULL AS hero, 1.0 AS confidence FROM pr
  UNION ALL SELECT session_id, 'world_info', '角色("hero_' || (session_id % 5) || '")["a brave one"]', NULL, '"hero_' || (session_id % 5) || '"', 1.0 FROM pr
  UNION ALL SELECT session_id, 'supplementary', 'note ' || session_id, NULL, NULL, 1.0 FROM pr
  UNION ALL SELECT session_id, 'general', 'tail ' || session_id, NULL, NULL, 0.8 FROM pr WHERE session_id % 3 = 0)
"""

CAUSAL = """
ce AS (SELECT event_id, user_id AS gid, ts, event_type, value, lead(event_id, 1) OVER w AS n1, lead(event_id, 2) OVER w AS n2, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
edges AS (SELECT gid, event_id AS src, dst, round(1 - least(value, 100) / 100, 4) AS strength,
  CASE event_id % 4 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE TRUE END AS met, event_id % 4 = 0 AS hit
  FROM (SELECT *, n1 AS dst FROM ce UNION ALL SELECT *, n2 AS dst FROM ce) WHERE dst IS NOT NULL)
"""
