"""Structured Streaming jobs: the batch operators fed step by step, with their state in tables or the state store.

Stateful jobs need the RocksDB provider; `configure` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from palimpsest.operators import changes, versions
from palimpsest.operators import states as S
from palimpsest.sources.tables import CODEC

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


# Snapshots of reference entries: the state is a table in buckets of sessions, and a manifest a batch that says in which
# batch each bucket was written last.

#: Buckets of a store. Fixed for its life.
BUCKETS = 64


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))


def sync_entries(entries: DataFrame, store_path: str, checkpoint: str, at: str = "2024-01-01 00:00:00", buckets: int = BUCKETS) -> DataStreamWriter:
    """Each batch holds whole new snapshots of some sessions; these are compared with the store and synced.

    Only buckets with sessions of the batch are read and written; all others stay where they are. A repeated batch
    starts from the same manifest and writes the same folders again, so it never applies its changes twice.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = changes.first_of_id(batch).persist()
        touched = {r[0] for r in _bucketed(new, buckets).select("bucket").distinct().collect()}  # at most `buckets`
        before = _manifest(spark, store_path, number - 1)
        old = _read(spark, store_path, {b: n for b, n in before.items() if b in touched})
        if old is None:
            out = versions.initial(new, at)
        else:
            sessions = new.select("session_id").distinct()
            mine = old.join(sessions, "session_id", "left_semi")
            feed = changes.change_feed(mine.where("valid_until is null"), new)
            moment = spark.range(1).select((F.lit(at).cast("timestamp") + F.make_dt_interval(days=F.lit(number))).cast("string")).first()[0]
            out = old.join(sessions, "session_id", "left_anti").unionByName(versions.sync(mine, feed, moment))
        _bucketed(out, buckets).repartition("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").option("compression", CODEC).parquet(f"{store_path}/data/batch={number}")
        after = before | {b: number for b in touched}
        spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{store_path}/manifest/batch={number}")
        new.unpersist()

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The batch that wrote each bucket, as of batch `number`: at most as many rows as there are buckets."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{path}/manifest/batch={number}").collect()} if number >= 0 else {}


def _read(spark: SparkSession, path: str, where: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(where.items())]) if where else None


def store(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The store as batch `number` left it."""
    return _read(spark, path, _manifest(spark, path, number))


# Chat histories: the hashes of each session are a list in the state store.

ENDED = "ended"


class ChatDiff(StatefulProcessor):
    """Rows (session_id, turn, content_hash, and ms if sessions end) of whole histories, one history of a session in a batch.

    An append adds to the list and leaves what is stored alone. With an idle limit a session ends when its next history
    begins later than the limit after its last message, or when the watermark has passed that time and nothing came: it
    gives a row of its own and its state goes. What comes later is a new session's history.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hashes = handle.getListState("hashes", "hash string")
        if self.idle is not None:
            self.seen = handle.getValueState("seen", "last long")

    @staticmethod
    def _row(key, n_before: int, change: str, at: int | None, n: int) -> Row:
        return Row(session_id=key[0], n_before=n_before, change=change, diff_index=at, n_messages=n)

    # Each call of the state is a message to the JVM, so what is known is not asked for: `seen` says whether a session has
    # any state, and its only timer is at `seen` plus the limit.

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given = sorted(rows, key=lambda r: (r["turn"] is None, r["turn"]))
        new = [r["content_hash"] for r in given]
        if self.idle is None:
            old = self._stored()
        else:
            seen = self.seen.get()
            old = self._stored() if seen is not None else []
            times = [r["ms"] for r in given if r["ms"] is not None]
            if seen is not None and min(times) > seen[0] + self.idle:
                yield self._row(key, len(old), ENDED, None, 0)
                old = []  # the new history, which is not empty, takes the place of what is stored
            last = max(times)
            if seen is None or seen[0] != last:
                if seen is not None:
                    self.handle.deleteTimer(seen[0] + self.idle)
                self.seen.update((last,))
                self.handle.registerTimer(last + self.idle)
        change, at = classify(old, new)
        if old and change == "append":
            self.hashes.appendList([(h,) for h in new[len(old) :]])
        elif new and change != "no_change":
            self.hashes.put([(h,) for h in new])
        yield self._row(key, len(old), change, at, len(new))

    def _stored(self) -> list[str]:
        return [h[0] for h in self.hashes.get()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n = len(self._stored())
        self.seen.clear()
        self.hashes.clear()
        yield self._row(key, n, ENDED, None, 0)

    def close(self) -> None:
        pass


def classify(old: list[str], new: list[str]) -> tuple[str, int | None]:
    """The kind of a history's change and the first index that differs, as the batch operator has them."""
    if old == new:
        return "no_change", None
    at = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
    if not new:
        return "truncation", at
    if old and at == 0:
        return "modification", at
    if len(new) > len(old) and at >= len(old):
        return "append", at
    return ("truncation" if len(new) < len(old) and at >= len(new) else "modification"), at


CHAT_ROW = "session_id long, n_before long, change string, diff_index long, n_messages long"


def chat_changes(messages: DataFrame) -> DataFrame:
    """The change of each history against the session's one before; sessions never end."""
    return messages.groupBy("session_id").transformWithState(ChatDiff(), CHAT_ROW, "Append", "None")


def chat_sessions(messages: DataFrame, idle_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """The same for messages with a time `ts`, and a row `ended` for each session that was idle beyond the limit, whose
    state is dropped. Messages behind the watermark (the latest time less `delay`) come too late and are left out."""
    rows = messages.withWatermark("ts", delay).select("session_id", "turn", "content_hash", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session_id").transformWithState(ChatDiff(idle_minutes * 60_000), CHAT_ROW, "Append", "EventTime")


# Character states: the last one of each character is in the state store.


class Transitions(StatefulProcessor):
    """Rows (character_id, micros, state_id, state as text) to consecutive pairs, by time within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given = sorted(rows, key=lambda r: (r["micros"] is None, r["micros"], r["state_id"] is None, r["state_id"]))
        prev = self.last.get()
        self.last.update((given[-1]["state"],))
        prev = None if prev is None else prev[0]
        for r in given:
            if prev is not None:
                yield Row(character_id=key[0], prev=prev, state=r["state"])
            prev = r["state"]

    def close(self) -> None:
        pass


STATE = "state_id string, micros long, emotions map<string, double>, traits map<string, double>, stability double"


def transitions(states: DataFrame, trigger: str = "对话", digits: int | None = None) -> DataFrame:
    """The transition records of the batch operator, for each state that has one before it.

    The last state of a character is kept as text, so the stateful step only pairs rows; all else is column expressions.
    """
    text = F.to_json(F.struct("state_id", F.unix_micros("observed_at").alias("micros"), "emotions", "traits", "stability"))
    rows = states.select("character_id", F.unix_micros("observed_at").alias("micros"), "state_id", text.alias("state"))
    pairs = rows.groupBy("character_id").transformWithState(Transitions(), "character_id long, prev string, state string", "Append", "None")
    pairs = pairs.select("character_id", F.from_json("prev", STATE).alias("prev"), F.from_json("state", STATE).alias("s"))
    pairs = pairs.select("character_id", "s.state_id", F.timestamp_micros("s.micros").alias("observed_at"), "s.emotions", "s.traits", "s.stability", "prev")
    return S.described(S.compared(pairs, digits), trigger, digits)


# Stateless and built-in ones.


def episodes(responses: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends responses as episodes; the file sink writes each batch once."""
    rows = responses.withColumn("episode_id", versions.episode_id("session_id", "name", "reference_time"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def distinct_content(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal contents of a session within the watermark (our addition)."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "content_hash"])


def live_counters(messages: DataFrame) -> DataFrame:
    """Messages and distinct roles by session, for update mode."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), F.approx_count_distinct("role").alias("n_roles"))


def windowed_scores(states: DataFrame, window: str = "7 days", slide: str = "1 day", delay: str = "1 day", digits: int | None = None) -> DataFrame:
    """Trait, behaviour and memory scores by character and sliding window (the slide is our addition).

    First by trait, beside one row of each state without a trait, then over a window's traits: two aggregations with
    partial results, so no group of states is collected.
    """
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    traits = F.explode(F.concat(F.array(none), F.map_entries("traits"))).alias("t")
    rows = states.withWatermark("observed_at", delay).withColumn("_b", S.behavior_score()).select("character_id", "observed_at", "intensity", "stability", "_b", traits)
    per = rows.groupBy("character_id", F.window("observed_at", window, slide), F.col("t.key").alias("trait")).agg(
        F.avg("_b").alias("_b"), F.avg("intensity").alias("_i"), F.avg("stability").alias("_s"), F.var_pop("t.value").alias("_v"), F.count("*").alias("_n"))
    state = lambda c: F.max(F.when(F.col("trait").isNull(), F.col(c)))
    spread = F.when(F.col("trait").isNotNull() & (F.col("_n") > 1), F.greatest(F.lit(0.0), 1 - 2 * F.col("_v")))
    out = per.groupBy("character_id", "window").agg(F.avg(spread).alias("_t"), state("_b").alias("_b"), state("_i").alias("_i"), state("_s").alias("_s"), state("_n").alias("_n"))
    return out.select(
        "character_id", F.col("window.start").alias("window_start"), F.coalesce("_t", F.lit(1.0)).alias("trait_consistency"), F.col("_b").alias("behavioral_consistency"),
        S.memory_score(F.col("_i"), F.col("_s"), digits).alias("memory_rationality"), F.col("_n").alias("n_states"))


def run(writer: DataStreamWriter) -> None:
    """Everything that is there, then stop."""
    job = writer.trigger(availableNow=True).start()
    job.awaitTermination()
    if job.exception():
        raise job.exception()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all available data into Parquet and reads the result."""
    run(stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
