"""A temporal store of entry versions: closing, superseding, appending, reading as of a time. Rows are never deleted.

Episodes: session_id, entry_id, entry_type, name, content, content_hash, version, valid_from, valid_until, status,
status_reason, superseded_by, episode_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id", "entry_id")


def episode_id(*parts: str) -> Column:
    """The same for a retry of the same write."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def episode_name(version: str | None = "version") -> Column:
    name = F.concat(F.lit("World Info - "), "entry_type", F.lit(" - "), "name")
    return name if version is None else F.when(F.col(version) > 1, F.concat(name, F.lit(" (v"), F.col(version).cast("string"), F.lit(")"))).otherwise(name)


def narrative_name(as_of: Column) -> Column:
    return F.when(F.col("block_type") == "world_info", F.concat(F.lit("World Info - "), F.coalesce(F.try_element_at("metadata", F.lit("location")), F.lit("Unknown")))).otherwise(F.concat(F.lit("General Content - "), as_of.cast("string")))


def narrative_kind() -> Column:
    return F.when(F.col("block_type") == "dialog", "message").otherwise("text")


def initial(entries: DataFrame, at: str) -> DataFrame:
    """First versions of entries."""
    rows = entries.select(*KEYS, "entry_type", "name", "content", "content_hash", F.lit(1).cast("long").alias("version"), F.lit(at).cast("timestamp").alias("valid_from"))
    return _open(rows)


def _open(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"valid_until": F.lit(None).cast("timestamp"), "status": F.lit("active"), "status_reason": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string")})
    return rows.withColumn("episode_id", episode_id("session_id", "entry_id", "version", "valid_from"))


def active(store: DataFrame, as_of: str) -> DataFrame:
    """Versions that hold at a time."""
    t = F.lit(as_of).cast("timestamp")
    return store.where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))


def sync(store: DataFrame, feed: DataFrame, at: str) -> DataFrame:
    """The store after a change feed: removed entries are closed as deleted, modified ones superseded by a new
    version, added ones opened. One pass over the store, one over the feed, and one join on the keys, whose shuffle
    the ranking of versions shares; a new version goes out beside the newest one of its entry."""
    t = F.lit(at).cast("timestamp")
    own = Window.partitionBy(*KEYS)
    changes = feed.where("change <> 'unchanged'").select(*KEYS, "change", F.col("new").alias("_new"))
    ranked = store.withColumns({"_last": F.max("version").over(own), "_n": F.row_number().over(own.orderBy(F.desc("version"), F.desc("valid_from")))})
    rows = ranked.withColumn("_kept", F.lit(True)).join(changes, list(KEYS), "full_outer")
    closing = F.col("change").isin("removed", "modified") & F.col("valid_until").isNull()
    closed = {c: F.col(c) for c in store.columns} | {
        "status": F.when(closing, F.when(F.col("change") == "removed", "deleted").otherwise("superseded")).otherwise(F.col("status")),
        "status_reason": F.when(closing & (F.col("change") == "removed"), "removed_by_user").otherwise(F.col("status_reason")),
        "superseded_by": F.when(closing & (F.col("change") == "modified"), _next_id(t)).otherwise(F.col("superseded_by")),
        "valid_until": F.when(closing, t).otherwise(F.col("valid_until")),
    }
    fields = ("entry_type", "name", "content", "content_hash")
    opened = {c: F.lit(None).cast(store.schema[c].dataType) for c in store.columns} | {c: F.col(f"_new.{c}") for c in fields} | {k: F.col(k) for k in KEYS}
    opened |= {"version": (F.coalesce("_last", F.lit(0)) + 1).cast("long"), "valid_from": t, "status": F.lit("active"), "episode_id": _next_id(t)}
    as_row = lambda cells: F.struct(*[v.cast(store.schema[c].dataType).alias(c) for c, v in cells.items()])
    new = F.col("change").isin("added", "modified") & (F.coalesce("_n", F.lit(1)) == 1)
    both = F.array_compact(F.array(F.when(F.col("_kept"), as_row(closed)), F.when(new, as_row(opened))))
    return rows.select(F.explode(both).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in store.columns])


def _next_id(t: Column) -> Column:
    """The episode_id of the version after the last one."""
    version = (F.coalesce(F.col("_last"), F.lit(0)) + 1).cast("string")
    return F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.col("entry_id").cast("string"), version, t.cast("string")).cast("binary"), 256)


def sync_totals(feed: DataFrame) -> DataFrame:
    """Counts of changes by session and kind, by session, and of all (rollup)."""
    return feed.rollup("session_id", "change").agg(F.count("*").alias("n"))


def change_counts(feed: DataFrame) -> DataFrame:
    kinds = ["added", "removed", "modified", "unchanged"]
    return feed.groupBy("session_id").pivot("change", kinds).count().fillna(0, kinds)


def intervals(snapshots: DataFrame) -> DataFrame:
    """valid_until of each version: the next version's valid_from."""
    order = Window.partitionBy(*KEYS).orderBy("version")
    return snapshots.withColumn("valid_until", F.lead("valid_from").over(order))


#: Longest piece of a name that names are looked up by.
GRAM = 6


def _grams(name: Column, sizes: list[int]) -> Column:
    """The different substrings of the given sizes."""
    def of(q: int) -> Column:
        places = F.sequence(F.lit(1), F.length(name) - q + 1)
        return F.when(F.length(name) >= q, F.transform(places, lambda i: name.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def fuzzy_match(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Active versions whose name contains a changed entry's name (`wanted`), within the same session and type.

    The different names are joined through pieces of up to GRAM characters: a wanted name meets only those that have its
    rarest piece, and `contains` decides. An empty name is in every one; null names match nothing.
    """
    same = ["session_id", "entry_type"]
    active_rows = store.where("valid_until is null")
    names = active_rows.select(*same, "name").where("name is not null").distinct()
    wanted = changes.select(*same, F.col("name").alias("wanted")).where("wanted is not null").distinct()
    sizes = sorted(r[0] for r in wanted.where("wanted <> ''").select(F.least(F.length("wanted"), F.lit(GRAM))).distinct().collect())  # at most GRAM
    found = names.withColumn("wanted", F.lit("")).join(wanted.where("wanted = ''"), [*same, "wanted"])
    if sizes:
        pieces = names.select(*same, "name", F.explode(_grams(F.col("name"), sizes)).alias("_gram"))
        counts = pieces.groupBy(*same, "_gram").agg(F.count("*").alias("_n"))
        size = F.least(F.length("wanted"), F.lit(GRAM))
        own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("wanted") - size + 1), lambda i: F.col("wanted").substr(i, size)))
        tried = wanted.where("wanted <> ''").select(*same, "wanted", F.explode(own).alias("_gram")).join(counts, [*same, "_gram"])
        rarest = tried.groupBy(*same, "wanted").agg(F.min(F.struct("_n", "_gram")).getField("_gram").alias("_gram"))
        met = pieces.join(rarest, [*same, "_gram"]).where(F.col("name").contains(F.col("wanted")))
        found = found.unionByName(met.select(*found.columns))
    return active_rows.join(found, [*same, "name"]).select(*store.columns, "wanted")
