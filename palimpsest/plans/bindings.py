"""The given tables as inputs of the operators: prompts, entries, chats, states, graphs, memories, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import shred

AS_OF = "2024-01-31 00:00:00"
#: Trait that an event type shows. Fixed values.
TRAITS = (("click", "joy"), ("view", "optimistic"), ("purchase", "enthusiastic"), ("error", "anxious"), ("signup", "flexible"))
DIGITS = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flat(c: Column) -> Column:
    """A text as one line without double quotes."""
    return F.trim(T.replaced(F.coalesce(c, F.lit("")), (("\n", " "), ('"', "'"))))


def psych_states(spark: SparkSession, sf: str) -> DataFrame:
    """events by user and day: emotions are the shares of event types, traits their mean capped values."""
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    per = ev.groupBy("user_id", "day", "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), DIGITS).alias("strength"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    trait = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in TRAITS], F.col("event_type"))
    days = per.groupBy("user_id", "day").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("counts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(trait.alias("t"), F.col("strength").alias("v"))))).alias("traits"),
    )
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    emotions = F.transform_values("counts", lambda _, v: F.round(v / F.col("n"), DIGITS))
    top = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return days.select(
        F.col("user_id").alias("character_id"), F.date_format("day", "yyyy-MM-dd").alias("state_id"), F.col("day").cast("timestamp").alias("observed_at"), emotions.alias("emotions"), "traits", F.element_at(top, 1)["k"].alias("dominant"),
        F.round(1 - F.least(spread / 100, F.lit(1.0)), DIGITS).alias("stability"), F.round(F.least(mean / 100, F.lit(1.0)), DIGITS).alias("intensity"), F.round(F.least(F.col("n") / 10, F.lit(1.0)), DIGITS).alias("arousal"),
    )


def _rendered(kind: str, name: str, content: str) -> Column:
    word = F.when(F.col(kind) == "location", "地点").when(F.col(kind) == "character", "角色").when(F.col(kind) == "concept", "概念")
    return F.when(F.col(kind) == "general", F.concat(F.col(name), F.lit("\n"), F.col(content))).otherwise(F.concat(word, F.lit('("'), F.col(name), F.lit('")["'), F.col(content), F.lit('"]')))


def world_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """documents as rendered entries of an old and a new snapshot: (session_id, doc_id, text)."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("session_id"), F.when(F.col("lang") == "en", "location").when(F.col("lang") == "fr", "character").when(F.col("lang") == "de", "concept").otherwise("general").alias("kind"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), flat(F.col("text")).alias("body"),
    )
    r = F.col("doc_id") % 7
    edited = (
        F.when(r == 0, F.concat("body", "body")).when(r == 1, F.substring(F.col("body"), F.lit(1), F.floor(F.length("body") / 2).cast("int")))
        .when(r == 2, "0123456789").when(r == 3, F.concat("body", F.lit(" x"))).otherwise(F.col("body"))
    )
    old = docs.where("doc_id % 10 <> 0").withColumn("content", F.col("body"))
    new = docs.where("doc_id % 10 <> 1").withColumn("content", edited)
    return tuple(d.select("session_id", "doc_id", _rendered("kind", "name", "content").alias("text")) for d in (old, new))


def world_entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tuple(shred.entries(t) for t in world_texts(spark, sf))


def chats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """conversations as an old and a new history by conv_id % 6: same, one turn more, last turn less, first edited,
    middle edited, new only. Columns: session_id, turn, role, text, content_hash, version (old only)."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("session_id").orderBy("turn")
    rows = rows.withColumns({"turn": F.row_number().over(own).cast("long") - 1, "n": F.count("*").over(Window.partitionBy("session_id"))})
    r = F.col("session_id") % 6
    old = rows.where(r != 5)
    edit = ((r == 3) & (F.col("turn") == 0)) | ((r == 4) & (F.col("turn") == F.floor(F.col("n") / 2)))
    new = rows.where((r != 2) | (F.col("turn") < F.col("n") - 1)).withColumn("text", F.when(edit, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    more = rows.where((r == 1) & (F.col("turn") == F.col("n") - 1)).withColumns({"turn": F.col("n"), "role": F.lit("user"), "text": F.lit("one more turn")})
    new = new.unionByName(more)
    digest = T.content_hash(F.concat_ws(":", "role", "text"))
    old, new = (d.select("session_id", "turn", "role", "text", digest.alias("content_hash")) for d in (old, new))
    return old.withColumn("version", F.lit(1)), new


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as tagged prompts: (session_id, prompt)."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", flat(F.col("text")).alias("text"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    per = rows.groupBy("session_id").agg(
        F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("system"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", line.alias("line"))))).getField("line"), "\n").alias("history"),
    )
    s = F.col("session_id").cast("string")
    town, hero = ((F.col("session_id") % k).cast("string") for k in (7, 5))
    world = F.concat(F.lit('<相关资料>\n地点("town_'), town, F.lit('")["a quiet place"]\n\n角色("hero_'), hero, F.lit('")["a brave one"]\n</相关资料>\n'))
    prompt = F.concat(
        F.when(F.col("system").isNotNull(), F.concat(F.lit("<核心指导>"), "system", F.lit("</核心指导>\n"))).otherwise(""), world,
        F.lit("<互动历史>\n"), "history", F.lit("\n</互动历史>\n"), F.lit("<补充资料>note "), s, F.lit("</补充资料>"),
        F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("\ntail "), s)).otherwise(""),
    )
    return per.select("session_id", prompt.alias("prompt"))


def earlier_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """The reference text of each session's request before, (session_id, text): another town for odd sessions, a hero
    described otherwise for every third; every eleventh session has none."""
    sessions = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct().where("session_id % 11 <> 0")
    s = F.col("session_id")
    town, hero = ((s + s % 2) % 7).cast("string"), (s % 5).cast("string")
    text = F.concat(F.lit('地点("town_'), town, F.lit('")["a quiet place"]\n\n角色("hero_'), hero, F.lit('")["'), F.when(s % 3 == 1, "a shy one").otherwise("a brave one"), F.lit('"]'))
    return sessions.select("session_id", text.alias("text"))


def causal_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("group_id"), "ts", F.col("event_type"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"), "value")


def _chosen(options: dict[int, str]) -> Column:
    out = F.array().cast("array<string>")
    for r, value in options.items():
        out = F.when(F.col("src") % 4 == r, F.array(F.lit(value))).otherwise(out)
    return out


#: Conditions and exceptions by event_id % 4, and the scenario they are judged in. Fixed values.
CONDITIONS = {1: "角色 hero", 2: "地点 town", 3: "状态 ready"}
EXCEPTIONS = {0: "角色 hero", 2: "状态 closed"}
SCENARIO = {"character_hero": "yes", "state_ready": "true"}


def scenario() -> Column:
    return F.create_map(*[F.lit(x) for pair in SCENARIO.items() for x in pair])


def causal_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from each event to the same user's next two."""
    order = Window.partitionBy("group_id").orderBy("ts", "event_id")
    ev = causal_events(spark, sf).withColumns({"n1": F.lead("event_id", 1).over(order), "n2": F.lead("event_id", 2).over(order)})
    rows = ev.select("group_id", F.col("event_id").alias("src"), "value", F.explode(F.array_compact(F.array("n1", "n2"))).alias("dst"))
    strength = F.round(1 - F.least(F.col("value"), F.lit(100.0)) / 100, 4)
    return rows.select("group_id", "src", "dst", F.lit("causes").alias("relation_type"), strength.alias("strength"), _chosen(CONDITIONS).alias("conditions"), _chosen(EXCEPTIONS).alias("exceptions"))


def memories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, memories): embeddings with their documents' texts; queries are those with vec_id % 50 = 0."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("fact"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").alias("group_id"), "embedding").join(docs, "memory_id")
    queries = rows.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "group_id", F.col("fact").alias("query"), "embedding")
    return queries, rows


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, memories) without texts: all embeddings, and those with vec_id % 50 = 0."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").alias("group_id"), "embedding")
    return rows.where("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id"), rows


#: What counts as an entity that a text names. Fixed value.
ENTITY = "[A-Z][a-z]{3,}"


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(memory_id, group_id, entity): the capitalised words of memories."""
    _, rows = memories(spark, sf)
    names = F.regexp_extract_all("fact", F.lit(f"({ENTITY})"), F.lit(1))
    return rows.select("memory_id", "group_id", F.explode(F.array_distinct(names)).alias("entity"))


def version_history(spark: SparkSession, sf: str) -> DataFrame:
    """documents as versions of entries over January: (session_id, entry_id, version, valid_from, valid_until), one to four
    versions of each entry, the last one open or, for every ninth entry, deleted on the 25th. Sessions are those of `messages_at`."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") % SESSIONS).alias("session_id"), F.col("doc_id").alias("entry_id"))
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), (F.col("entry_id") % 4).cast("int"))).alias("v"))
    begins = lambda v: F.lit("2023-12-30").cast("timestamp") + F.make_dt_interval(hours=(F.col("entry_id") % 50 + v * (60 + F.col("entry_id") % 77)).cast("int"))
    ends = F.when(F.col("v") < F.col("entry_id") % 4, begins(F.col("v") + 1)).when(F.col("entry_id") % 9 == 0, F.lit("2024-01-25").cast("timestamp"))
    return rows.select("session_id", "entry_id", (F.col("v") + 1).cast("long").alias("version"), begins(F.col("v")).alias("valid_from"), ends.alias("valid_until"))


#: Sessions of `version_history` and `messages_at`. Fixed value.
SESSIONS = 200


def messages_at(spark: SparkSession, sf: str) -> DataFrame:
    """events as messages: (event_id, session_id, ts)."""
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % SESSIONS).alias("session_id"), "ts")


def state_responses(spark: SparkSession, sf: str) -> DataFrame:
    """States as JSON text: every third without stability, every 97th cut short."""
    rows = psych_states(spark, sf)
    day = F.dayofmonth("observed_at")
    mix = F.transform(F.map_entries("emotions"), lambda e: F.struct(e["key"].alias("emotion_type"), e["value"].alias("intensity")))
    body = F.to_json(F.struct(mix.alias("emotional_mix"), F.col("dominant").alias("dominant_emotion"), F.transform_values("traits", lambda _, v: F.struct(v.alias("strength"))).alias("trait_manifestations"), F.when(day % 3 != 0, F.col("stability")).alias("stability_score"), F.col("intensity").alias("intensity_level")))
    broken = (F.col("character_id") + day) % 97 == 0
    return rows.select("character_id", "state_id", F.concat_ws("|", "character_id", "state_id").alias("response_id"), F.when(broken, F.substring(body, 1, 20)).otherwise(body).alias("response"))


#: Events in one response. Fixed value.
IN_RESPONSE = 20


def causal_responses(spark: SparkSession, sf: str) -> DataFrame:
    """All events of each user, twenty a response, and the relations between neighbours as JSON: (session_id, first,
    response), first the number of the user's events in earlier responses. The last event of a response is related to
    the first of the next one. Every fifth relation names an event that does not exist, every third has no strength."""
    order = Window.partitionBy("group_id").orderBy("ts", "event_id")
    ev = causal_events(spark, sf).withColumns({"n": F.row_number().over(order), "next": F.lead("name").over(order)})
    ev = ev.withColumn("first", (F.floor((F.col("n") - 1) / IN_RESPONSE) * IN_RESPONSE).cast("int"))
    event = F.struct(F.col("name").alias("event_name"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("event_type"))
    relation = F.when(F.col("next").isNotNull(), F.struct(F.col("name").alias("cause_event"), F.when(F.col("event_id") % 5 == 0, "nowhere").otherwise(F.col("next")).alias("effect_event"), F.when(F.col("event_id") % 3 != 0, F.round(F.least(F.col("value"), F.lit(100.0)) / 100, 4)).alias("causal_strength")))
    per = ev.groupBy(F.col("group_id").alias("session_id"), "first").agg(F.array_sort(F.collect_list(F.struct("n", event.alias("e")))).getField("e").alias("events"), F.array_sort(F.collect_list(F.when(relation.isNotNull(), F.struct("n", relation.alias("r"))))).getField("r").alias("causal_relations"))
    return per.select("session_id", "first", F.to_json(F.struct("events", "causal_relations")).alias("response"))
