"""Queries over reference entries (documents as an old and a new snapshot) and their versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import changes as C
from palimpsest.operators import shred, temporal, versions
from palimpsest.plans.base import WORLD, query
from palimpsest.plans.bindings import SESSIONS, messages_at, table, version_history, world_entries, world_texts
from palimpsest.sources.appends import append_once, appended
from palimpsest.sources.tables import shared_dir, written

_W = f"WITH {WORLD} "
T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    return C.change_feed(*(C.first_of_id(e) for e in world_entries(spark, sf)))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    old, _ = world_entries(spark, sf)
    return versions.initial(C.first_of_id(old), T0)


def _synced(spark: SparkSession, sf: str) -> DataFrame:
    return versions.sync(_store(spark, sf), _feed(spark, sf), T1)


@query(_W + "SELECT doc_id, session_id, kind AS entry_type, name, entry_id, md5(content) AS content_hash, CASE kind WHEN 'general' THEN 'general' ELSE 'world_info' END AS source FROM n")
def o_p10_entry_parse(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entries(world_texts(spark, sf)[1]).select("doc_id", "session_id", "entry_type", "name", "entry_id", "content_hash", "source")


_PAIRED = """CASE WHEN kind <> 'general' THEN nullif(regexp_extract({content}, '([^\\s:]+):\\s*([^\\n]+)', {group}), '') END"""


@query(_W + rf"""SELECT doc_id, CASE WHEN kind <> 'general' AND inner_content <> '' THEN inner_content END AS primary_description, {_PAIRED.format(content="content", group=1)} AS pair_key, trim({_PAIRED.format(content="content", group=2)}) AS pair_value,
  (CASE WHEN kind = 'general' THEN 0 ELSE (inner_content <> '')::INTEGER + ({_PAIRED.format(content="content", group=1)} IS NOT NULL)::INTEGER END)::INTEGER AS n_properties FROM n""")
def o_p11_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = shred.entries(world_texts(spark, sf)[1])
    keys = F.filter(F.map_keys("properties"), lambda k: ~(k == "primary_description") & ~k.startswith("attribute_"))
    key = F.try_element_at(keys, F.lit(1))
    return rows.select("doc_id", F.try_element_at("properties", F.lit("primary_description")).alias("primary_description"), key.alias("pair_key"), F.try_element_at("properties", key).alias("pair_value"), F.size("properties").alias("n_properties"))


@query(_W + "SELECT entry_id, session_id FROM feed WHERE change = 'added'")
def o_j1_added(spark: SparkSession, sf: str) -> DataFrame:
    return C.added(*world_entries(spark, sf)).select("entry_id", "session_id")


@query(_W + "SELECT entry_id, session_id FROM feed WHERE change = 'removed'")
def o_j2_removed(spark: SparkSession, sf: str) -> DataFrame:
    return C.removed(*world_entries(spark, sf)).select("entry_id", "session_id")


@query(_W + "SELECT entry_id, session_id, change FROM feed WHERE change IN ('modified', 'unchanged')")
def o_j3_modified(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(spark, sf).where("change in ('modified', 'unchanged')").select("entry_id", "session_id", "change")


@query(_W + "SELECT feed.session_id, feed.entry_id, feed.change, change_type, round(pct, 6) AS change_percentage FROM feed LEFT JOIN diff USING (session_id, entry_id)")
def o_j4_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(spark, sf).select("session_id", "entry_id", "change", "diff.change_type", F.round("diff.change_percentage", 6).alias("change_percentage"))


@query(_W + "SELECT session_id, entry_id, change_type FROM diff")
def o_c8_entry_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(spark, sf).where("change = 'modified'").select("session_id", "entry_id", "diff.change_type")


@query(_W + "SELECT session_id, entry_id, round(1 - pct, 6) AS similarity FROM diff")
def o_u4_char_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(spark, sf).where("change = 'modified'").select("session_id", "entry_id", F.round(T.char_jaccard(F.col("old.content"), F.col("new.content")), 6).alias("similarity"))


@query(_W + rf""", p AS (SELECT o.session_id, o.entry_id, nullif(o.inner_content, '') AS od, nullif(n.inner_content, '') AS nd, {_PAIRED.format(content="o.content", group=1).replace("kind", "o.kind")} AS ok, trim({_PAIRED.format(content="o.content", group=2).replace("kind", "o.kind")}) AS ov,
  {_PAIRED.format(content="n.content", group=1).replace("kind", "n.kind")} AS nk, trim({_PAIRED.format(content="n.content", group=2).replace("kind", "n.kind")}) AS nv FROM o JOIN n USING (session_id, entry_id) WHERE o.kind <> 'general' AND o.content <> n.content)
SELECT session_id, entry_id, 'primary_description' AS key, od AS old_value, nd AS new_value FROM p WHERE od IS DISTINCT FROM nd
UNION ALL SELECT session_id, entry_id, ok, ov, CASE WHEN nk = ok THEN nv END FROM p WHERE ok IS NOT NULL AND ov IS DISTINCT FROM CASE WHEN nk = ok THEN nv END
UNION ALL SELECT session_id, entry_id, nk, NULL, nv FROM p WHERE nk IS NOT NULL AND nk IS DISTINCT FROM ok""")
def o_j9_property_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feed(spark, sf).where("change = 'modified'").select("session_id", "entry_id", F.explode("diff.properties_changed").alias("key", "v"))
    return rows.select("session_id", "entry_id", "key", F.col("v.old").alias("old_value"), F.col("v.new").alias("new_value"))


@query(_W + "SELECT side, session_id, entry_id, md5(content) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY side, session_id, entry_id ORDER BY doc_id) AS k FROM r) WHERE k = 1")
def o_w6_first_entry(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (C.first_of_id(e) for e in world_entries(spark, sf))
    both = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    return both.select("side", "session_id", "entry_id", "content_hash")


@query(_W + "SELECT entry_id FROM (SELECT entry_id FROM o INTERSECT SELECT entry_id FROM n)")
def o_u1_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    old, new = world_entries(spark, sf)
    return old.select("entry_id").intersect(new.select("entry_id"))


@query(_W + """, before AS (SELECT session_id, max(doc_id % 3 + 1) AS version FROM o GROUP BY 1)
SELECT n.session_id, entry_id, md5(content) AS content_hash, coalesce(version, 0) + 1 AS state_version, max(entry_id) OVER (PARTITION BY n.session_id, md5(content)) AS indexed_id FROM n LEFT JOIN before USING (session_id)""")
def o_d1_world_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state after the change with its version, and the entry that its hash index gives for each hash."""
    old, new = (C.first_of_id(e) for e in world_entries(spark, sf))
    state = written(C.world_state(old.withColumn("state_version", F.col("doc_id") % 3 + 1), new).select("session_id", "entry_id", "content_hash", "state_version"), "world_state")
    index = C.hash_index(state).select("session_id", "content_hash", F.col("entry_id").alias("indexed_id"))
    return state.join(index, ["session_id", "content_hash"])


_STORE = _W.rstrip() + """, store AS (
  SELECT session_id, entry_id, 1 AS version, CASE change WHEN 'removed' THEN 'deleted' WHEN 'modified' THEN 'superseded' ELSE 'active' END AS status, CASE change WHEN 'removed' THEN 'removed_by_user' END AS status_reason, '2024-01-01' AS since, CASE WHEN change IN ('removed', 'modified') THEN '2024-02-01' END AS until, change = 'modified' AS linked, kind, name FROM feed WHERE change <> 'added'
  UNION ALL SELECT session_id, entry_id, CASE change WHEN 'added' THEN 1 ELSE 2 END, 'active', NULL, '2024-02-01', NULL, FALSE, kind, name FROM feed WHERE change IN ('added', 'modified'))
"""


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@query(_STORE + "SELECT session_id, entry_id, version::BIGINT AS version, status, status_reason, since, until, linked FROM store")
def o_d7_sync(spark: SparkSession, sf: str) -> DataFrame:
    return _synced(spark, sf).select("session_id", "entry_id", "version", "status", "status_reason", _day("valid_from").alias("since"), _day("valid_until").alias("until"), F.col("superseded_by").isNotNull().alias("linked"))


@query(_STORE + "SELECT session_id, count(*) AS n FROM store WHERE since = '2024-02-01' AND version = 1 GROUP BY 1")
def o_d4_apply_added(spark: SparkSession, sf: str) -> DataFrame:
    feed = _feed(spark, sf).where("change = 'added'")
    return versions.sync(_store(spark, sf), feed, T1).where(F.col("valid_from") == F.lit(T1).cast("timestamp")).groupBy("session_id").agg(F.count("*").alias("n"))


@query(_STORE + "SELECT session_id, entry_id, until FROM store WHERE status = 'deleted'")
def o_d5_apply_removed(spark: SparkSession, sf: str) -> DataFrame:
    return versions.sync(_store(spark, sf), _feed(spark, sf).where("change = 'removed'"), T1).where("status = 'deleted'").select("session_id", "entry_id", _day("valid_until").alias("until"))


@query(_STORE + "SELECT a.session_id, a.entry_id, a.status AS old_status, b.version::BIGINT AS new_version FROM store a JOIN store b USING (session_id, entry_id) WHERE a.linked AND b.version = 2")
def o_d6_apply_modified(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(versions.sync(_store(spark, sf), _feed(spark, sf).where("change = 'modified'"), T1), "modified")
    old, new = rows.where("superseded_by is not null"), rows.select(F.col("episode_id").alias("superseded_by"), F.col("version").alias("new_version"))
    return old.join(new, "superseded_by").select("session_id", "entry_id", F.col("status").alias("old_status"), "new_version")


@query(_STORE + "SELECT session_id, entry_id, version::BIGINT AS version FROM store WHERE until IS NULL")
def o_f1_active_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.active(_synced(spark, sf), "2024-03-01 00:00:00").select("session_id", "entry_id", "version")


_HISTORY = f"""SELECT doc_id % {SESSIONS} AS session_id, doc_id AS entry_id, v + 1 AS version, TIMESTAMP '2023-12-30' + to_hours(doc_id % 50 + v * (60 + doc_id % 77)) AS since,
  CASE WHEN v < doc_id % 4 THEN TIMESTAMP '2023-12-30' + to_hours(doc_id % 50 + (v + 1) * (60 + doc_id % 77)) WHEN doc_id % 9 = 0 THEN TIMESTAMP '2024-01-25' END AS until
  FROM (SELECT doc_id, unnest(range(0, doc_id % 4 + 1)) AS v FROM documents)"""


@query(f"SELECT event_id, entry_id, version FROM events JOIN ({_HISTORY}) h ON h.session_id = user_id % {SESSIONS} AND since <= ts AND (until IS NULL OR ts < until)")
def o_f1_versions_at(spark: SparkSession, sf: str) -> DataFrame:
    """The versions of its session's entries that hold when a message comes, for each message."""
    return temporal.holding(messages_at(spark, sf), version_history(spark, sf), ["session_id"], "ts").select("event_id", "entry_id", "version")


@query(f"SELECT entry_id, version, count(event_id) AS n, min(ts)::VARCHAR AS first FROM ({_HISTORY}) h LEFT JOIN events ON h.session_id = user_id % {SESSIONS} AND since <= ts AND (until IS NULL OR ts < until) GROUP BY 1, 2")
def o_w11_interval_use(spark: SparkSession, sf: str) -> DataFrame:
    """How many messages each version's interval holds, and the first of them."""
    used = temporal.held(messages_at(spark, sf), version_history(spark, sf), ["session_id"], "ts", ["entry_id", "version"])
    return used.select("entry_id", "version", "n", F.col("first").cast("string").alias("first"))


@query(_STORE + "SELECT entry_id, version::BIGINT AS version FROM store WHERE session_id = 'src3'")
def o_f2_session_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return written(_synced(spark, sf), "store", ("session_id",)).where("session_id = 'src3'").select("entry_id", "version")


@query(_STORE + "SELECT session_id, entry_id, max(version)::BIGINT + 1 AS next_version FROM store GROUP BY 1, 2")
def o_w7_next_version(spark: SparkSession, sf: str) -> DataFrame:
    return _synced(spark, sf).groupBy("session_id", "entry_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


@query(_STORE + "SELECT session_id, entry_id, version::BIGINT AS version, since, lead(since) OVER (PARTITION BY session_id, entry_id ORDER BY version) AS until FROM store")
def o_w11_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return versions.intervals(_synced(spark, sf)).select("session_id", "entry_id", "version", _day("valid_from").alias("since"), _day("valid_until").alias("until"))


@query(_STORE + "SELECT 'World Info - ' || kind || ' - ' || name || CASE WHEN version > 1 THEN ' (v' || version || ')' ELSE '' END AS episode_name, count(*) AS n FROM store GROUP BY 1")
def o_p15_episode_names(spark: SparkSession, sf: str) -> DataFrame:
    return _synced(spark, sf).groupBy(versions.episode_name().alias("episode_name")).agg(F.count("*").alias("n"))


@query(_STORE + "SELECT session_id, status, count(*) AS n FROM store GROUP BY 1, 2")
def o_s4_episode_append(spark: SparkSession, sf: str) -> DataFrame:
    """First versions appended to the table of episodes, that batch again, then all versions, of which only those of the sync are new."""
    path, rows = f"{shared_dir(spark)}/episodes-{uuid.uuid4().hex}", written(_synced(spark, sf), "synced")
    for batch, part in (("first", rows.where("version = 1")), ("first", rows.where("version = 1")), ("sync", rows)):
        append_once(part, path, batch)
    return appended(spark, path, rows.schema).groupBy("session_id", "status").agg(F.count("*").alias("n"))


@query(_W + "SELECT o.session_id, o.entry_id, n.name AS wanted FROM n JOIN feed USING (session_id, entry_id) JOIN o ON o.session_id = n.session_id AND o.kind = n.kind AND contains(o.name, n.name) WHERE feed.change = 'modified'")
def o_j5_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    changed = _feed(spark, sf).where("change = 'modified'").select("session_id", "new.entry_type", "new.name")
    return versions.fuzzy_match(_store(spark, sf), changed).select("session_id", "entry_id", "wanted")


@query(_W + "SELECT session_id, change, count(*) AS n FROM feed GROUP BY ROLLUP (session_id, change)")
def o_a2_sync_totals(spark: SparkSession, sf: str) -> DataFrame:
    return versions.sync_totals(_feed(spark, sf))


@query(_W + "SELECT session_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM feed GROUP BY 1")
def o_a14_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.change_counts(_feed(spark, sf))


# The head of a text as a padded name. White space as scripting languages strip it.
_HEAD = "substr(coalesce(text, ''), 1, 60)"
_FOLD = rf"trim(regexp_replace(lower('  ' || {_HEAD} || '！ '), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ', 'g'))"
_NAME = rf"regexp_replace(translate({_FOLD}, '：（）【】', ':()[]'), '[^\x{{4e00}}-\x{{9fff}}a-zA-Z0-9 :(),.\-_]', '', 'g')"


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    head = F.substring(F.coalesce("text", F.lit("")), 1, 60)
    return table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("kind"), F.concat(F.lit("  "), head, F.lit("！ ")).alias("name"))


@query(f"SELECT doc_id, {_NAME} AS normalized FROM documents")
def o_c1_normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("doc_id", T.normalize_name(F.col("name")).alias("normalized"))


@query(rf"SELECT doc_id, coalesce(lang, '') || ':' || {_NAME} AS id_punct, coalesce(lang, '') || ':' || regexp_replace({_FOLD}, '[^\p{{L}}\p{{N}}_]', '', 'g') AS id_ws FROM documents")
def o_c7_entry_id(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("doc_id", T.entry_id(F.col("kind"), F.col("name")).alias("id_punct"), T.entry_id(F.col("kind"), F.col("name"), "ws").alias("id_ws"))


_TRIM = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))"
_PUNCT = f"md5(translate(regexp_replace({_TRIM}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '：，。', ':,.'))"


@query(f"SELECT doc_id, {_PUNCT} AS hash FROM documents")
def o_c2_normalize_punct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_content(F.coalesce("text", F.lit(""))).cast("binary")).alias("hash"))


@query("SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents")
def o_c3_normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_content(F.coalesce("text", F.lit("")), "ws").cast("binary")).alias("hash"))


@query(f"SELECT doc_id, {_PUNCT} AS punct, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS ws FROM documents")
def o_c4_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", T.content_hash(F.col("text")).alias("punct"), T.content_hash(F.col("text"), "ws").alias("ws"))


_MARK = r"CASE WHEN regexp_matches(l, '^#{1,6}\s') THEN regexp_extract(l, '^#+') WHEN regexp_matches(l, '^\s*[-*+]\s') THEN '-' WHEN trim(l) = '' THEN '' ELSE 'text' END"


@query(f"SELECT doc_id, list_aggregate(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_MARK}), 'string_agg', chr(10)) AS fingerprint FROM documents")
def o_c6_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.structural_fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query(f"SELECT doc_id, {_PUNCT} AS exact, md5(list_aggregate(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_MARK}), 'string_agg', chr(10))) AS structural FROM documents")
def o_c5_multi_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", T.content_hashes(F.col("text")).alias("h")).select("doc_id", "h.exact", "h.structural")
