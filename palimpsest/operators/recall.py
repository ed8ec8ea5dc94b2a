"""Retrieval of stored facts and assembly of model context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import words
from palimpsest.operators import pair_scores as P
from palimpsest.sources.tables import written

#: Rank offset of reciprocal-rank fusion.
RRF = 60
#: Queries, and bytes of their words and vectors, that are broadcast at once. Fixed values.
BLOCK_QUERIES, BLOCK_BYTES = 2000, 16 << 20


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null for a vector of zeros; norms that are at hand need not be taken again for each pair."""
    return _dot(a, b) / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def pairs(queries: DataFrame, memories: DataFrame, prepare: Callable[[Column], Column] = words, grouped: bool = True) -> list[DataFrame]:
    """The plain form of pairs, for any score of columns: each query with all other memories of its group (or of all groups), in blocks of queries: (query_id, memory_id, _q, _m, _nq,
    _nm, _x, _y), the vectors, their norms and the prepared texts of both. A block is broadcast, so each memory is met where it lies, however many
    share its group; the queries' number and bytes are measured first."""
    q = queries.select("query_id", "group_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_nq"), prepare(F.col("query")).alias("_x"))
    m = memories.select("memory_id", "group_id", F.col("embedding").alias("_m"), norm(F.col("embedding")).alias("_nm"), prepare(F.col("fact")).alias("_y"))
    number, held = queries.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.octet_length("query"), F.lit(0)) + 4 * F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()
    n = max(1, -(-number // BLOCK_QUERIES), -(-held // BLOCK_BYTES))
    blocks = [q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)] if n > 1 else [q]
    other = F.col("memory_id") != F.col("query_id")
    if not grouped:
        return [m.drop("group_id").join(F.broadcast(b.drop("group_id")), other) for b in blocks]
    return [m.join(F.broadcast(b), "group_id").where(other).drop("group_id") for b in blocks]


def search(queries: DataFrame, memories: DataFrame, k: int = 10, prepare: Callable[[Column], Column] = words, scorer: Callable = P.jaccard, digits: int = 9, grouped: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """The k best memories of each query within its group, by fused ranks of cosine and lexical similarity; all groups'
    memories unless `grouped`. `also` names columns of memories that come with them.

    queries(query_id, group_id, query, embedding) are scored against all memories(memory_id, group_id, fact, embedding)
    in blocks (`pair_scores`). Similarities are rounded to `digits` before they are ranked; ties go to the smaller memory_id.
    `prepare` gives the set of words of a text, `scorer` a similarity from the sizes of the intersection and of both sets.

    Of each similarity the `top` best memories of a query are found in each task and merged; the k first of either have a
    score above 1 / (RRF + k), which what is beyond `top` in both cannot reach. For those that can, a rank beyond `top` is
    counted over all memories, in parts that are added up. All ranks are exact. Pairs are scored once, and once more only
    if a rank has to be counted; neither pass makes rows of them.
    """
    top = RRF + 2 * k
    ids, value, sides = ["query_id", "memory_id"], ("cosine", "lexical"), {"_a": "cosine", "_b": "lexical"}
    out = []
    for block in P.blocks(queries, memories, norm, value, prepare, grouped, digits, BLOCK_QUERIES, BLOCK_BYTES, scorer):
        order = Window.partitionBy("query_id", "side").orderBy(*[F.desc(F.when(F.col("side") == c, F.col(c))) for c in value], "memory_id")
        best = block.best(top).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
        near = best.groupBy(*ids).agg(*[F.first(c).alias(c) for c in value], *[F.max(F.when(F.col("side") == c, F.col("_rank"))).alias(r) for r, c in sides.items()])
        bound = sum(1 / (RRF + F.coalesce(c, F.lit(top + 1))) for c in sides)
        near = written(near.where(bound > 1 / (RRF + k) - 10.0**-digits), "recalled")
        # What stands before a memory whose rank is not known: the rows that precede it in the order of the window.
        key = lambda c: F.struct(F.when(F.col(c).isNull(), float("inf")).when(F.isnan(c), float("-inf")).otherwise(-F.col(c)).alias("v"), F.col("memory_id").alias("id"))
        asked = near.groupBy("query_id").agg(*[F.array_sort(F.collect_list(F.when(F.col(r).isNull(), key(c)))).alias(c) for r, c in sides.items()])
        if not near.where("_a is null or _b is null").isEmpty():
            counts = block.counts(asked).select("query_id", "side", F.posexplode("counts").alias("p", "c")).groupBy("query_id", "side", "p").agg(F.sum("c").alias("c"))
            counts = counts.withColumn("c", F.sum("c").over(Window.partitionBy("query_id", "side").orderBy("p")))
            for r, c in sides.items():
                unknown = asked.select("query_id", F.posexplode(c).alias("p", "x")).select("query_id", "p", F.col("x.id").alias("memory_id"))
                known = unknown.join(counts.where(F.col("side") == c), ["query_id", "p"]).select(*ids, F.col("c").cast("int").alias("_r"))
                near = near.join(known, ids, "left").withColumn(r, F.coalesce(r, "_r")).drop("_r")
        near = near.withColumn("score", F.round(1 / (RRF + F.col("_a")) + 1 / (RRF + F.col("_b")), digits))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))).where(F.col("rank") <= k)
        out.append(written(near, "found"))
    return P.union(out).join(memories.select("memory_id", "fact", *also), "memory_id").select("query_id", "memory_id", "fact", "cosine", "lexical", "score", "rank", *also)


def similar(queries: DataFrame, memories: DataFrame, top: int = 100, prepare: Callable[[Column], Column] = words, scorer: Callable = P.jaccard, digits: int = 9, grouped: bool = True) -> DataFrame:
    """(query_id, memory_id, leg, rank): the `top` best memories of each query by cosine and by lexical similarity, from
    one pass over the pairs; ties go to the smaller memory_id."""
    value = ("cosine", "lexical")
    order = Window.partitionBy("query_id", "side").orderBy(*[F.desc(F.when(F.col("side") == c, F.col(c))) for c in value], "memory_id")
    found = P.union([b.best(top) for b in P.blocks(queries, memories, norm, value, prepare, grouped, digits, BLOCK_QUERIES, BLOCK_BYTES, scorer)])
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("query_id", "memory_id", F.col("side").alias("leg"), "rank")


def overlaps(queries: DataFrame, memories: DataFrame, prepare: Callable[[Column], Column] = words, scorer: Callable = P.jaccard, digits: int = 6, grouped: bool = True) -> DataFrame:
    """(query_id, memory_id, lexical): each query with all other memories of its group, or of all groups."""
    return P.union([b.all() for b in P.blocks(queries, memories, norm, ("lexical",), prepare, grouped, digits, BLOCK_QUERIES, BLOCK_BYTES, scorer)])


def fused(legs: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """The k best memories of each query by the sum of 1 / (RRF + rank) over the legs that found them: (query_id, memory_id,
    n_legs, score, rank), from legs(query_id, memory_id, leg, rank)."""
    rows = legs.groupBy("query_id", "memory_id").agg(F.count("*").alias("n_legs"), F.round(F.sum(1 / (RRF + F.col("rank"))), digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def memories_used(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.count("*").alias("memories_used"))


def _listed(best: Column) -> Column:
    return F.array_join(F.transform(best, lambda m: F.concat(F.lit("- "), m["fact"])), "\n")


def memory_summary(found: DataFrame, key: str = "query_id", k: int = 5) -> DataFrame:
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "fact"))))
    return found.groupBy(key).agg(_listed(best).alias("summary"))


def recalled(found: DataFrame, key: str = "query_id", k: int = 5) -> DataFrame:
    """`memory_summary` and `memories_used` of each query in one grouping."""
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "fact"))))
    return found.groupBy(key).agg(_listed(best).alias("summary"), F.count("*").alias("memories_used"))


def context(instructions: DataFrame, dialog: DataFrame, last: DataFrame, summaries: DataFrame, key: str = "session_id", recent: int = 5) -> DataFrame:
    """(key, messages, error) of every session of `last`: array<struct(role, content)> of system (first instruction and
    memories), recent turns and last message; null where there is an error, which is passed on.

    instructions(key, pos, content), dialog(key, pos, role, content), last(key, role, content, error), summaries(key, summary).
    """
    first = instructions.groupBy(key).agg(F.min_by("content", "pos").alias("_first"))
    newest = Window.partitionBy(key).orderBy(F.desc("pos"))
    turns = dialog.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= recent)
    turns = turns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda t: F.struct(F.lower(t["role"]).alias("role"), t["content"].alias("content"))).alias("_turns"))
    rows = last.select(key, F.struct("role", "content").alias("_last"), "error")
    for part in (first, turns, summaries):
        rows = rows.join(part, key, "left")
    whole = messages(F.col("_first"), F.coalesce("_turns", F.array().cast(MESSAGES)), F.col("summary"), F.col("_last"))
    return rows.select(key, F.when(F.col("error").isNull(), whole).alias("messages"), "error")


MESSAGES = "array<struct<role:string,content:string>>"


def messages(instruction: Column, turns: Column, summary: Column, last: Column) -> Column:
    """A context: a system message of instruction and memories unless both are empty, turns, the last message."""
    memory = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\n\n相关记忆：\n"), summary)).otherwise("")
    system = F.concat(F.coalesce(instruction, F.lit("")), memory)
    head = F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.array().cast(MESSAGES))
    return F.concat(head, turns, F.array(last))
