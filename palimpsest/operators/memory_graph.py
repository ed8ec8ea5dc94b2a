"""The graph leg of retrieval: bounded walks with restart on the graph of memories and the entities they name.

A walk starts at the entities of a query and goes from an entity to one of the memories that name it, and from a memory to
one of the entities that it names, each equally likely. `walk` carries the exact distribution of all queries' walks at
once: a step is a join on the entity (or the memory) and a sum by query. Before each visit of a memory but the first, a
walk starts anew with probability `restart`. The number of visits is fixed, so a plan has as many joins whatever the data.

An entity that many memories name (a hub) is split: its mentions are dealt over one part for each SPLIT of them, and walks
that stand on it are copied to each part, so that no task holds a hub.

`best` gives the memories that most walks of a query are at without a row for each query and memory. Queries are dealt into
blocks of a group; a task takes a block and lets the memories of its group pass by once for each visit, as lists of their
entities, so a visit is a few operations on arrays. It holds the masses at entities of its block (up to CELLS, or LEAST queries) and no
list of memories but the best. What is shuffled is the graph, once for each block and visit. Ids are integers there, and
entities are compared by a hash of 64 bits.

mentions(memory_id, group_id, entity), starts(query_id, group_id, entity): entities are those of one group. Repeated
mentions and starts count once; nulls in any column name nothing. A query whose entities are in no memory of its group
reaches nothing; a query's own memory is left out of what it finds, not of the graph. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import pair_scores as P
from palimpsest.sources.tables import written

#: Mentions of one entity that stay together.
SPLIT = 10_000
DIGITS = 12
#: Masses that a task holds for a block, and the least and most queries of one; mentions that are moved at once. Fixed values.
CELLS, LEAST, MOST, STRIP = 1 << 24, 16, 256, 1 << 20
#: Entities of a row of a group's vocabulary. Fixed value.
WORDS = 1000


def _graph(mentions: DataFrame, split: int) -> DataFrame:
    """Distinct mentions with the degrees of both ends and the part of a hub."""
    rows = mentions.select("memory_id", "group_id", "entity").dropna().distinct()
    entities = rows.groupBy("group_id", "entity").agg(F.count("*").alias("_named"))
    memories = rows.groupBy("memory_id", "group_id").agg(F.count("*").alias("_names"))
    rows = rows.join(entities, ["group_id", "entity"]).join(memories, ["memory_id", "group_id"])
    parts = F.ceil(F.col("_named") / split).cast("int")
    return written(rows.select("*", parts.alias("_parts"), F.pmod(F.hash("memory_id"), parts).alias("_part")), "mentions")


def walk(starts: DataFrame, mentions: DataFrame, visits: int = 2, restart: float = 0.3, split: int = SPLIT) -> DataFrame:
    """(query_id, memory_id, mass): where the walks are at their last visit of a memory."""
    graph = _graph(mentions, split)
    entities = graph.groupBy("group_id", "entity").agg(F.first("_parts").alias("_parts"), F.first("_named").alias("_named"))
    first = starts.select("query_id", "group_id", "entity").dropna().distinct().join(entities.select("group_id", "entity"), ["group_id", "entity"], "left_semi")
    first = written(first.withColumn("mass", 1 / F.count("*").over(Window.partitionBy("query_id"))), "walk_starts")
    at_entities, at_memories = first, None
    for visit in range(visits):
        if visit:
            back = at_memories.join(graph.select("memory_id", "group_id", "entity", "_names"), ["memory_id", "group_id"])
            back = back.select("query_id", "group_id", "entity", ((1 - restart) * F.col("mass") / F.col("_names")).alias("mass"))
            at_entities = first.withColumn("mass", restart * F.col("mass")).unionByName(back).groupBy("query_id", "group_id", "entity").agg(F.sum("mass").alias("mass"))
        spread = at_entities.join(entities, ["group_id", "entity"])
        spread = spread.select("query_id", "group_id", "entity", (F.col("mass") / F.col("_named")).alias("mass"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        met = spread.join(graph.select("group_id", "entity", "_part", "memory_id"), ["group_id", "entity", "_part"])
        at_memories = written(met.groupBy("query_id", "group_id", "memory_id").agg(F.sum("mass").alias("mass")), "walks")
    return at_memories.where("memory_id <> query_id").select("query_id", "memory_id", F.round("mass", DIGITS).alias("mass"))


def leg(walked: DataFrame, top: int) -> DataFrame:
    """(query_id, memory_id, rank, mass) of the memories that most walks of a query are at; ties: the smaller memory_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("mass"), "memory_id")
    return walked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def best(starts: DataFrame, mentions: DataFrame, top: int, visits: int = 2, restart: float = 0.3, cells: int = CELLS) -> DataFrame:
    """(query_id, memory_id, rank, mass): the `leg` of a `walk`."""
    rows = mentions.select("memory_id", "group_id", F.xxhash64("entity").alias("code"), F.col("entity").isNotNull().alias("named")).where("named").dropna()
    memories = written(rows.groupBy("memory_id", "group_id").agg(F.collect_set("code").alias("codes")), "mentions")
    entities = written(memories.select("group_id", F.explode("codes").alias("code")).groupBy("group_id", "code").agg(F.count("*").alias("named")), "entities")
    first = starts.where(F.col("entity").isNotNull()).select("query_id", "group_id", F.xxhash64("entity").alias("code")).dropna().distinct().join(entities.select("group_id", "code"), ["group_id", "code"], "left_semi")
    first = first.withColumn("mass", 1 / F.count("*").over(Window.partitionBy("query_id")))
    queries = written(first.groupBy("query_id", "group_id").agg(F.collect_list("code").alias("codes"), F.first("mass").alias("mass")), "walk_starts")
    # Queries of a block are as few as its cells need; a group without queries has no block.
    sizes = entities.groupBy("group_id").agg(F.count("*").alias("words")).join(queries.groupBy("group_id").agg(F.count("*").alias("asked")), "group_id")
    most = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(cells / F.col("words"))))
    sizes = written(sizes.select("group_id", F.ceil(F.col("words") / WORDS).alias("parts"), F.ceil(F.col("asked") / most).cast("int").alias("blocks")), "walk_blocks")
    of_all = lambda df: df.join(sizes.select("group_id", "blocks"), "group_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    vocabulary = entities.join(sizes.select("group_id", "parts"), "group_id").groupBy("group_id", F.pmod("code", "parts").alias("part")).agg(F.collect_list("code").alias("codes"), F.collect_list("named").alias("counts"))
    none, kinds = F.lit(None), F.explode(F.sequence(F.lit(2), F.lit(1 + visits)))
    stream = of_all(vocabulary).select("group_id", "block", F.lit(0).alias("kind"), none.cast("long").alias("id"), "codes", "counts", none.cast("double").alias("mass"))
    mine = queries.join(sizes, "group_id").select("group_id", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "codes", none.cast("array<bigint>").alias("counts"), "mass")
    passing = of_all(memories).select("group_id", "block", kinds.alias("kind"), F.col("memory_id").alias("id"), "codes", none.cast("array<bigint>").alias("counts"), none.cast("double").alias("mass"))
    stream = stream.unionByName(mine).unionByName(passing).withColumn("block", F.concat_ws("|", "block", F.col("group_id").cast("string"))).drop("group_id")
    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by bytes
    found = stream.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_walked(top, visits, restart), "query_id long, memory_id long, mass double")
    return leg(found, top)


class _Block:
    """Masses of a block's queries at the entities of their group: a row for each query, a column for each entity.

    Memories are gathered up to STRIP mentions. A query's row is read at their entities and summed by memory, one query after
    the other: a row stays in a processor's cache, as all queries' columns at once would not.
    """

    def __init__(self, top: int, visits: int, restart: float):
        self.top, self.visits, self.restart, self.kind = top, visits, restart, 0
        self.words, self.queries, self.passing, self.held, self.best = [], [], [], 0, None

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        codes, first, n = P._lists(rows.column("codes"))
        codes = codes[P._runs(first, n)]
        if kind == 0:
            counts, first, m = P._lists(rows.column("counts"))
            self.words.append((codes, counts[P._runs(first, m)]))
            return
        ids = rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        if kind == 1:
            self.queries.append((ids, codes, np.repeat(rows.column("mass").to_numpy(zero_copy_only=False), n), n))
            return
        if not self.queries:
            return
        if self.kind < kind:
            self._pass()
            self._begin(kind)
        self.passing.append((ids, np.searchsorted(self.codes, codes), n))
        self.held += len(codes)
        if self.held >= STRIP:
            self._pass()

    def _begin(self, kind: int) -> None:
        if kind == 2:
            codes, counts = (np.concatenate(x) for x in zip(*self.words))
            order = np.argsort(codes)
            self.codes, self.named = codes[order], counts[order].astype(np.float64)
            self.ids, codes, mass, n = (np.concatenate(x) for x in zip(*self.queries))
            self.first = np.repeat(np.arange(len(self.ids)), n), np.searchsorted(self.codes, codes), mass
            self.here = self._starts(1)
        else:
            self.here = self.next
        self.here /= self.named
        self.next = self._starts(self.restart) if kind <= self.visits else None
        self.kind = kind

    def _starts(self, share: float) -> np.ndarray:
        query, at, mass = self.first
        out = np.zeros((len(self.ids), len(self.codes)))
        out[query, at] = share * mass
        return out

    def _pass(self) -> None:
        """The memories that were gathered, as many at once as make STRIP masses if these are kept."""
        if not self.passing:
            return
        ids, at, n = (np.concatenate(x) for x in zip(*self.passing))
        self.passing, self.held = [], 0
        ends = np.cumsum(n)
        step = len(ids) if self.kind <= self.visits else max(1, STRIP // len(self.ids))
        for begin in range(0, len(ids), step):
            end = min(begin + step, len(ids))
            self._visit(ids[begin:end], at[ends[begin] - n[begin] : ends[end - 1]], n[begin:end])

    def _visit(self, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        begins = np.cumsum(n) - n
        if self.kind <= self.visits:
            share = (1 - self.restart) / n
            for here, later in zip(self.here, self.next):
                later += np.bincount(at, np.repeat(share * np.add.reduceat(here[at], begins), n), len(later))
            return
        mass = np.stack([np.add.reduceat(here[at], begins) for here in self.here])
        key = np.where((mass > 0) & (self.ids[:, None] != ids), -P._rounded(mass, DIGITS), np.nan)
        self.best = self.best or P._Best(len(self.ids), self.top, 0)
        self.best.add(ids, [key])

    def found(self) -> Iterator[pa.RecordBatch]:
        self._pass()
        if self.best is not None:
            q, ids, key = self.best.all()
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(-key)], names=["query_id", "memory_id", "mass"])


def _walked(top: int, visits: int, restart: float):
    """Rows by block and kind: 0 the vocabulary, 1 queries, 2 and more the memories at each visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        for b in batches:
            blocks, kinds = np.array(b.column("block").to_pylist(), object), b.column("kind").to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(kinds)]):
                if begin == end:
                    continue
                if blocks[begin] != name:
                    if block is not None:
                        yield from block.found()
                    name, block = blocks[begin], _Block(top, visits, restart)
                block.add(int(kinds[begin]), b.slice(begin, end - begin))
        if block is not None:
            yield from block.found()

    return run
