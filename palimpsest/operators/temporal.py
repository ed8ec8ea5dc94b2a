"""Joins by time: the last row before a time (as-of), and the rows that hold at a time (intervals).

Both are built so that no task gets all rows of a key. `as_of` sorts rows of both sides together by key and time into
ranges of about equal size; a key with a third of all rows fills a third of the ranges, and what is known at the end of a
range is carried into the next ones of that key. `holding` deals intervals over dyadic bins of time, so that an interval,
however long or open, is a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import written


def in_ranges(rows: DataFrame, key: str, *order: str, tasks: int | None = None) -> DataFrame:
    """rows dealt by key and order into ranges of about equal size, written, with the number of the range as `_range`:
    ranges follow each other in that order, so all rows of a key and range come after those of its earlier ranges."""
    n = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def carried(ends: DataFrame, key: str, value: str) -> DataFrame:
    """(key, _range, _before): the last known `value` of a key's earlier ranges, for keys with several ranges. A key goes on
    only into the next range, so there are at most two rows for each range, which is why they may be broadcast."""
    own = Window.partitionBy(key)
    before = F.last(value, ignorenulls=True).over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    rows = ends.select(key, "_range", before.alias("_before"), F.count("*").over(own).alias("_n"))
    return rows.where("_n > 1 and _before is not null").drop("_n")


def as_of(requests: DataFrame, states: DataFrame, key: str = "character_id", at: str = "requested_at", observed: str = "observed_at", tie: str = "state_id", tasks: int | None = None) -> DataFrame:
    """All requests with `state`, the struct of the last row of `states` with the same key that was observed by then.

    A state at the very time of a request counts; of several at one time that with the greatest `tie` does. `state` is
    null before a key's first state, for a key without states, and for requests without key or time; states without key
    or time are no one's. Repeated requests stay, each with its state.
    """
    fine = F.col(key).isNotNull() & F.col(at).isNotNull()
    names = [f"`{c}`" for c in requests.columns]
    state_type = states.select(F.struct(*states.columns).alias("s")).schema["s"].dataType
    kind = states.schema[key].dataType
    asked = requests.where(fine).select(F.col(key).cast(kind).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(states.schema[tie].dataType).alias("_tie"), F.struct(*names).alias("_request"), F.lit(None).cast(state_type).alias("_state"))
    known = states.where(F.col(key).isNotNull() & F.col(observed).isNotNull()).select(F.col(key).alias("_key"), F.col(observed).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(asked.schema["_request"].dataType).alias("_request"), F.struct(*states.columns).alias("_state"))
    rows = in_ranges(asked.unionByName(known), "_key", "_at", "_side", "_tie", tasks=tasks)
    seen = F.last("_state", ignorenulls=True).over(Window.partitionBy("_range", "_key").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("_key", "_range").agg(F.max_by("_state", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
    found = rows.withColumn("_seen", seen).where("_side = 1").join(F.broadcast(carried(ends, "_key", "_end")), ["_key", "_range"], "left")
    found = found.select("_request.*", F.coalesce("_seen", "_before").alias("state"))
    return found.unionByName(requests.where(~fine | fine.isNull()).withColumn("state", F.lit(None).cast(state_type)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


#: Bins of one level that are one bin of the next, and levels above the first: RADIX ** LEVELS bins in all.
RADIX_BITS, LEVELS = 3, 4


#: A bin of a level as one number: bin * STRIDE + level.
STRIDE = 16


def _node(level: int, b: Column) -> Column:
    return b * STRIDE + level


def _pieces(levels: int) -> Column:
    """The fewest whole bins, as nodes, between the first and last bin of an interval, _lo and _hi, level by level from both sides."""
    size = 1 << RADIX_BITS
    after = lambda l: F.shiftright(F.col("_lo") + (1 << RADIX_BITS * l), RADIX_BITS * l)  # noqa: E731  the level's first bin that begins after _lo
    before = lambda l: F.shiftright("_hi", RADIX_BITS * l)  # noqa: E731  the level's bin that _hi is in, which is no whole one

    spans = []  # (level, first bin, the bin after the last)
    for l in range(levels):
        up = F.least(before(l), after(l + 1) * size)
        spans += [(l, after(l), up), (l, F.greatest(up, before(l + 1) * size), before(l))]
    spans.append((levels, after(levels), before(levels)))
    nodes = lambda s: F.when(s["lo"] < s["hi"], F.sequence(s["lo"], s["hi"] - 1, F.lit(STRIDE).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(*[F.struct(_node(l, lo).alias("lo"), _node(l, hi).alias("hi")) for l, lo, hi in spans]), nodes))


def holding(rows: DataFrame, intervals: DataFrame, on: list[str], at: str, since: str = "valid_from", until: str = "valid_until", levels: int = LEVELS) -> DataFrame:
    """Each row with each interval of the same keys that holds at its time: since <= at < until, a null `until` holds on.

    The time from the first to the last row is cut into 8^levels bins, eight of a level making one of the next. A row is
    in one bin of each level that intervals use; an interval is cut into the two bins at its ends, whose rows are
    compared with its bounds, and the fewest whole bins between them (at most fourteen a level), all of whose rows it holds
    and meets without being compared. These do not overlap, so a pair is met once. Open intervals end with the last row.
    Rows and intervals meet by keys and bin, so neither a key nor a long interval is one task's. Intervals are written
    whole and dealt out before they are cut. Both sides are shuffled: Spark would measure one by the table it was cut from
    and broadcast some thirty rows for each of that table's. There is a row for each pair, which no form of the join makes fewer.

    Rows and intervals without a time or key meet nothing, and neither do intervals that end before they begin. `on`
    may be empty. Columns of both sides stay, but the keys of intervals; other names must differ.
    """
    first, last = rows.agg(F.min(_micros(F.col(at))), F.max(_micros(F.col(at)))).first()
    if first is None:
        first = last = 0
    width = max(-(-(last - first + 1) // (1 << RADIX_BITS * levels)), 1)
    bin_of = lambda c: F.expr(f"({{}} - {first}L) div {width}L".format(c))
    end = F.least(F.coalesce(_micros(F.col(until)), F.lit(last + 1)), F.lit(last + 1))
    kept = intervals.where(F.col(since).isNotNull()).withColumns({"_s": F.greatest(_micros(F.col(since)), F.lit(first)), "_e": end}).where("_s < _e")
    kept = kept.withColumns({"_lo": bin_of("_s"), "_hi": bin_of("(_e - 1)")}).drop("_s", "_e")
    kept = written(kept.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "intervals")
    whole = kept.withColumn("_node", F.explode(_pieces(levels))).drop("_lo", "_hi")
    used = sorted(r[0] for r in whole.select(F.col("_node") % STRIDE).distinct().collect())  # at most levels + 1
    t = F.col(at)
    timed = rows.where(t.isNotNull()).withColumn("_t", _micros(t)).withColumn("_b", bin_of("_t")).drop("_t")
    ends = kept.withColumn("_b", F.explode(F.array_distinct(F.array("_lo", "_hi")))).drop("_lo", "_hi")
    out = timed.join(ends.hint("merge"), [*on, "_b"]).where((F.col(since) <= t) & (F.col(until).isNull() | (t < F.col(until)))).drop("_b")
    if used:
        nodes = F.array(*[_node(l, F.shiftright("_b", RADIX_BITS * l)) for l in used])
        out = out.unionByName(timed.withColumn("_node", F.explode(nodes)).drop("_b").join(whole.hint("merge"), [*on, "_node"]).drop("_node"))
    return out


def held(rows: DataFrame, intervals: DataFrame, on: list[str], at: str, by: list[str], since: str = "valid_from", until: str = "valid_until", tasks: int | None = None) -> DataFrame:
    """(by, n, first): how many of the pairs of `holding` each interval has, and the first time among them, without making
    the pairs. Intervals that agree in `by` are one; one that holds nothing has 0 and null.

    An interval holds the rows before its end less the rows before its beginning, so its two ends and the rows are sorted
    together by key and time into ranges, as in `as_of`; rows are counted along a range, what earlier ranges of the key
    hold is added, and a first row may lie in a later one. Work grows with rows and intervals, not with pairs.
    """
    kind = rows.schema[at].dataType
    key = F.struct(*on) if on else F.lit(0)
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on], F.lit(True))
    none = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in by]
    start, end = F.col(since).cast(kind), F.col(until).cast(kind)
    whole = intervals.where(fine & F.col(since).isNotNull() & (F.col(until).isNull() | (start < end)))
    request = F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.lit(False).alias("late"), start.alias("t"), end.alias("end")),
        F.struct(F.lit(1).alias("sign"), end.isNull().alias("late"), end.alias("t"), F.lit(None).cast(kind).alias("end")),
    ))
    asked = whole.select(key.alias("_key"), request.alias("r"), *by).select("_key", F.col("r.late").alias("_late"), F.col("r.t").alias("_t"), F.lit(0).alias("_side"), F.col("r.sign").alias("_sign"), F.col("r.end").alias("_end"), *by)
    known = rows.where(fine & F.col(at).isNotNull()).select(key.alias("_key"), F.lit(False).alias("_late"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_sign"), F.lit(None).cast(kind).alias("_end"), *none)
    dealt = in_ranges(asked.unionByName(known), "_key", "_late", "_t", "_side", tasks=tasks)
    time = F.when(F.col("_side") == 1, F.col("_t"))
    own, so_far = Window.partitionBy("_range", "_key"), (Window.unboundedPreceding, 0)
    counted = dealt.withColumn("_n", F.sum("_side").over(own.orderBy("_late", "_t", "_side").rowsBetween(*so_far)))
    counted = counted.withColumn("_next", F.last(time, ignorenulls=True).over(own.orderBy(F.desc("_late"), F.desc("_t"), F.desc("_side")).rowsBetween(*so_far))).where("_side = 0")
    # At most two rows for each range, as in `carried`.
    ends = dealt.groupBy("_key", "_range").agg(F.sum("_side").alias("_n"), F.min(time).alias("_first"))
    every, others = Window.partitionBy("_key"), (Window.unboundedPreceding, -1)
    ends = ends.select("_key", "_range", F.sum("_n").over(every.orderBy("_range").rowsBetween(*others)).alias("_before"), F.last("_first", ignorenulls=True).over(every.orderBy(F.desc("_range")).rowsBetween(*others)).alias("_after"), F.count("*").over(every).alias("_parts"))
    found = counted.join(F.broadcast(ends.where("_parts > 1").drop("_parts")), ["_key", "_range"], "left")
    first = F.coalesce("_next", "_after")
    first = F.when((F.col("_sign") < 0) & (F.col("_end").isNull() | (first < F.col("_end"))), first)
    found = found.select(*by, (F.col("_sign") * (F.col("_n") + F.coalesce("_before", F.lit(0)))).alias("n"), first.alias("first"))
    return found.unionByName(intervals.select(*by, F.lit(0).cast("long").alias("n"), F.lit(None).cast(kind).alias("first"))).groupBy(*by).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
