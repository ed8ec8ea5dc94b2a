"""State that ends: idle sessions are dropped, and the store shows it."""

import collections
import datetime

from pyspark.sql import Row

from palimpsest.streaming import jobs as J

BASE = datetime.datetime(2024, 1, 1)


def history(session, hashes, minutes):
    return [(session, i, h, BASE + datetime.timedelta(minutes=minutes, seconds=i)) for i, h in enumerate(hashes)]


def kept(spark, path, name):
    rows = spark.read.format("statestore").option("path", path).option("stateVarName", name).load()
    return {r.key[0] for r in rows.select("key").collect()}


def test_idle_sessions_end(spark, tmp_path):
    schema = "session_id long, turn long, content_hash string, ts timestamp"
    J.configure(spark)
    seen = collections.Counter()

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = J.source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 100)
        out = J.to_table(J.chat_sessions(source, idle_minutes=60, delay="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
        new = collections.Counter(tuple(r) for r in out.collect()) - seen
        seen.update(new)
        return set(new)

    assert step(history(1, "ab", 0) + history(2, "xy", 0)) == {(1, 0, "append", 0, 2), (2, 0, "append", 0, 2)}
    assert step(history(1, "abc", 30)) == {(1, 2, "append", 2, 3)}
    assert kept(spark, f"{tmp_path}/check", "hashes") == {1, 2}
    # Session 3 moves the watermark past the limit of 1 and 2, which end; 1 comes back later and starts anew.
    new = step(history(3, "q", 300)) | step(history(3, "qr", 301))
    assert new == {(3, 0, "append", 0, 1), (3, 1, "append", 1, 2), (1, 3, "ended", None, 0), (2, 2, "ended", None, 0)}
    assert kept(spark, f"{tmp_path}/check", "hashes") == {3} and kept(spark, f"{tmp_path}/check", "seen") == {3}
    assert step(history(1, "abcd", 310)) == {(1, 0, "append", 0, 4)}
    # A gap beyond the limit ends a session even if its timer has not fired; a message behind the watermark is left out.
    assert step(history(3, "z", 400) + history(2, "late", 5)) == {(3, 2, "ended", None, 0), (3, 0, "append", 0, 1), (1, 4, "ended", None, 0)}
    lists = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "hashes").load()
    assert {r.key[0] for r in lists.select("key").collect()} == {3} and "z" in str(lists.collect())


class Told:
    """A state and its timers in memory, and the messages that it was sent."""

    def __init__(self):
        self.held, self.timers, self.sent = {}, set(), []

    def getListState(self, name, schema):
        return Variable(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.sent.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.sent.append("delete")
        self.timers.remove(at)


class Variable:
    def __init__(self, told, name):
        self.told, self.name = told, name

    def _tell(self, what):
        self.told.sent.append(f"{self.name} {what}")

    def get(self):
        self._tell("get")
        return self.told.held.get(self.name, None if self.name != "hashes" else [])

    def update(self, value):
        self._tell("update")
        self.told.held[self.name] = value

    put = update

    def appendList(self, values):
        self._tell("append")
        self.told.held[self.name] = self.told.held[self.name] + values

    def clear(self):
        self._tell("clear")
        self.told.held.pop(self.name)


def test_a_history_asks_its_state_for_no_more_than_it_needs():
    """Rows in, rows out, and at most six messages for a history; one timer whatever comes."""
    told, chat = Told(), J.ChatDiff(60_000)
    chat.init(told)

    def step(hashes, ms, *expected):
        told.sent.clear()
        rows = [Row(session_id=7, turn=i, content_hash=h, ms=ms + i) for i, h in enumerate(hashes)]
        assert [tuple(r) for r in chat.handleInputRows((7,), iter(rows[::-1]), None)] == list(expected)
        assert told.timers == {ms + len(hashes) - 1 + 60_000} and told.held == {"seen": (ms + len(hashes) - 1,), "hashes": [(h,) for h in hashes]}
        return len(told.sent)

    assert step("ab", 0, (7, 0, "append", 0, 2)) == 4
    assert step("abc", 30_000, (7, 2, "append", 2, 3)) == 6
    assert step("abc", 30_000, (7, 3, "no_change", None, 3)) == 2
    assert step("x", 200_000, (7, 3, "ended", None, 0), (7, 0, "append", 0, 1)) == 6
    assert [tuple(r) for r in chat.handleExpiredTimer((7,), None, None)] == [(7, 1, "ended", None, 0)] and told.held == {}


def test_transitions_pair_rows_by_time_with_two_messages():
    told, job = Told(), J.Transitions()
    job.init(told)

    def step(*rows):
        told.sent.clear()
        out = [(r["prev"], r["state"]) for r in job.handleInputRows((7,), iter([Row(character_id=7, micros=m, state_id=s, state=f"{m}{s}") for m, s in rows]), None)]
        assert told.sent == ["last get", "last update"]
        return out

    assert step((None, "z"), (2, "b"), (2, "a"), (1, None), (1, "c")) == [("1c", "1None"), ("1None", "2a"), ("2a", "2b"), ("2b", "Nonez")]
    assert step((9, "d")) == [("Nonez", "9d")]
    told.held.clear()
    assert step((9, "d")) == []
