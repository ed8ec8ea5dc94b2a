"""Comparing snapshots: reference entries by id and hash, chat histories by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import shred

KEYS = ("session_id", "entry_id")


def first_of_id(entries: DataFrame) -> DataFrame:
    """The first entry of each (session, id) by position."""
    own = Window.partitionBy(*KEYS).orderBy("pos")
    return entries.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, list(KEYS), "left_anti")


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, list(KEYS), "left_anti")


def property_changes(old: Column, new: Column) -> Column:
    """Map of the keys whose values differ to struct(old, new)."""
    return F.map_filter(F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new"))), lambda _, v: ~v["old"].eqNullSafe(v["new"]))


FIELDS = ("entry_type", "name", "content", "content_hash")


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified and unchanged in one full outer join; both sides have one row an id.

    Columns: session_id, entry_id, change, old, new (structs), diff (its fields are null but for modified entries).
    The columns of both sides go through the join one by one and only as far as they are asked for: kinds and counts of
    changes shuffle ids and hashes, no contents. Properties and similarities are taken behind the join, of modified
    entries only, and only if they are asked for.
    """
    sides = [df.select(*KEYS, F.lit(True).alias(f"_{side}"), *[F.col(c).alias(f"_{side}_{c}") for c in FIELDS]) for df, side in ((old, "old"), (new, "new"))]
    rows = sides[0].join(sides[1], list(KEYS), "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old_content_hash").eqNullSafe(F.col("_new_content_hash")), "unchanged").otherwise("modified")
    )
    rows = rows.withColumns({"change": change, "_similarity": T.char_jaccard(*_modified(change, "content"))})
    whole = {side: F.when(F.col(f"_{side}"), F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in FIELDS])) for side in ("old", "new")}
    return rows.select(*KEYS, "change", *[v.alias(k) for k, v in whole.items()], _difference().alias("diff"))


def _modified(change: Column, field: str) -> list[Column]:
    """A field before and after, of modified entries only."""
    return [F.when(change == "modified", F.col(f"_{side}_{field}")) for side in ("old", "new")]


def _difference() -> Column:
    change = F.col("change")
    modified = change == "modified"
    (a, b), names, kinds = (_modified(change, c) for c in ("content", "name", "entry_type"))
    differ = modified & ~a.eqNullSafe(b)
    share = F.when(differ, 1 - F.col("_similarity"))
    props = [shred.entry_properties(kind, c) for kind, c in zip(kinds, (a, b))]
    return F.struct(
        F.when(modified, ~names[0].eqNullSafe(names[1])).alias("name_changed"), F.when(modified, differ).alias("content_changed"), F.when(modified, property_changes(*props)).alias("properties_changed"),
        F.when(differ, T.change_type(a, b, share)).alias("change_type"), F.when(modified, F.coalesce(share, F.lit(0.0))).alias("change_percentage"),
    )


def next_snapshot(feed: DataFrame) -> DataFrame:
    """The new state after a change feed: everything but what was removed."""
    rows = feed.where("change <> 'removed'").select(*KEYS, "new.*")
    return rows.withColumn("properties", shred.entry_properties(F.col("entry_type"), F.col("content")))


def world_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """The entries after a change and the version of their session's state: one more than that of the old one, which
    its entries carry as state_version; a session without an old state begins with 1."""
    versions = old.groupBy("session_id").agg(F.max("state_version").alias("_before"))
    rows = next_snapshot(change_feed(old, new)).join(versions, "session_id", "left")
    return rows.withColumn("state_version", F.coalesce("_before", F.lit(0)) + 1).drop("_before")


def hash_index(state: DataFrame) -> DataFrame:
    """entry_id by content hash of a state; of entries with one hash the last one that was changed is not known, so the
    greatest id counts."""
    return state.groupBy("session_id", "content_hash").agg(F.max("entry_id").alias("entry_id"), F.count("*").alias("n_entries"))


def message_diff(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Positions at which two histories differ: key, turn, change (added, removed, modified), old_hash, new_hash."""
    sides = [df.select(key, "turn", F.col("content_hash").alias(f"{side}_hash")) for df, side in ((old, "old"), (new, "new"))]
    rows = sides[0].join(sides[1], [key, "turn"], "full_outer").where("not (old_hash <=> new_hash)")
    return rows.withColumn("change", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("modified"))


def _hashes(messages: DataFrame, key: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "content_hash")))
    return messages.groupBy(key).agg(ordered.getField("content_hash").alias(name))


def chat_change(old: Column, new: Column) -> dict[str, Column]:
    """change, diff_index, n_new and n_removed of two hash arrays (empty for a missing side)."""
    at = T.first_difference(old, new)
    n, m = F.size(old), F.size(new)
    prefix = at.isNull() | (at >= F.least(n, m))
    change = (
        F.when(at.isNull(), "no_change").when(m == 0, "truncation").when((n > 0) & (at == 0), "modification")
        .when((m > n) & prefix, "append").when((m < n) & prefix, "truncation").otherwise("modification")
    )
    return {"change": change, "diff_index": at.cast("long"), "n_new": F.when(change == "append", m - n).otherwise(0).cast("long"), "n_removed": F.when(change == "truncation", n - m).otherwise(0).cast("long")}


def chat_changes(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """One row a session with the kind of its change; messages have turn and content_hash."""
    rows = _hashes(old, key, "old").join(_hashes(new, key, "new"), key, "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("old", "new")})
    return rows.select(key, *[v.alias(k) for k, v in chat_change(F.col("old"), F.col("new")).items()], F.size("old").cast("long").alias("n_old"), F.size("new").cast("long").alias("n_messages"))


def chat_state(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """The full new history with the state's version: one more than `version` of the old one unless nothing changed."""
    kinds = chat_changes(old, new, key).select(key, "change")
    versions = old.groupBy(key).agg(F.max("version").alias("version"))
    state = kinds.join(versions, key, "left").select(key, (F.coalesce("version", F.lit(0)) + F.when(F.col("change") == "no_change", 0).otherwise(1)).alias("version"))
    return new.drop("version").join(state, key)


def appended(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """The old history and the new messages behind it, for sessions that were appended to."""
    kinds = chat_changes(old, new, key).where("change = 'append'").select(key, "n_old")
    columns = [key, "turn", "content_hash"]
    tail = new.join(kinds, key).where("turn >= n_old").select(*columns)
    return old.join(kinds, key, "left_semi").select(*columns).unionByName(tail)
