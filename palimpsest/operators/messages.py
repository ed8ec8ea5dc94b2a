"""Chat requests as rows: session ids, last and recent messages, speakers, usage, completion records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A session id in a system message. Fixed value.
SESSION_ID = r"SESSION_ID\s*[:]\s*([^\s]+)"


def session_ids(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Header, else body field, else SESSION_ID: of the first system message that has one, else one made of the key.

    requests: key, turn, role, text, header_id, body_id (the same on all rows of a request).
    """
    given = F.regexp_extract("text", SESSION_ID, 1)
    own = (F.col("role") == "system") & (given != "")
    system = F.min_by(F.when(own, given), F.when(own, F.col("turn"))).alias("_s")
    rows = requests.groupBy(key).agg(F.max("header_id").alias("_h"), F.max("body_id").alias("_b"), system)
    made = F.concat(F.lit("sess-"), F.md5(F.col(key).cast("string").cast("binary")))
    return rows.select(key, F.coalesce(F.nullif("_h", F.lit("")), F.nullif("_b", F.lit("")), "_s", made).alias("session_id"))


def last_user_message(messages: DataFrame, key: str) -> DataFrame:
    """The last user text of each request; error = 'no user message' where there is none."""
    user = F.col("role") == "user"
    rows = messages.groupBy(key).agg(F.max_by("text", F.when(user, F.col("turn"))).alias("text"), F.count_if(user).alias("_n"))
    return rows.select(key, F.when(F.col("_n") > 0, F.col("text")).alias("text"), F.when(F.col("_n") == 0, "no user message").alias("error"))


def recent_dialog(messages: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The last n turns as `role: content` lines."""
    newest = Window.partitionBy(key).orderBy(F.desc("turn"))
    rows = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("dialog"))


def main_character(messages: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    """The speaker of the first assistant turn."""
    return messages.where("role = 'assistant'").groupBy(key).agg(F.min_by(speaker, "turn").alias("character_id"))


def characters(messages: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    return messages.where("role = 'assistant'").groupBy(key).agg(F.array_sort(F.collect_set(speaker)).alias("characters"))


def usage(messages: DataFrame, key: str) -> DataFrame:
    """Words of prompts and completions, and their sum."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    answer = F.col("role") == "assistant"
    rows = messages.groupBy(key).agg(F.coalesce(F.sum(F.when(~answer, words)), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(answer, words)), F.lit(0)).alias("completion_tokens"))
    return rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def completions(used: DataFrame, answers: DataFrame, key: str, model: str, created: int) -> DataFrame:
    """Completion records as JSON: id, created, model, choices, usage, extra.memories_used."""
    rows = answers.join(used, key)
    choice = F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("content")).alias("message"), F.lit("stop").alias("finish_reason")))
    record = F.struct(
        F.concat(F.lit("chatcmpl-"), F.md5(F.col(key).cast("string").cast("binary"))).alias("id"), F.lit("chat.completion").alias("object"), F.lit(created).alias("created"), F.lit(model).alias("model"), choice.alias("choices"),
        F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("usage"), F.struct("memories_used").alias("extra"),
    )
    return rows.select(key, F.to_json(record).alias("completion"))
