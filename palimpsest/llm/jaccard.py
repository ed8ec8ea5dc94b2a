"""N-gram Jaccard self-join by vertical partitioning, down to the components of the link graph.

Two texts link when 100 * common shingles >= threshold * all shingles (of distinct n-word shingles). All shingles
have a global order: those that are not frequent first (by hash), then the frequent ones by rising frequency. The
order is cut into fragments (ranges of the hash), sets are cut alike, and what a pair has and lacks in common is
found fragment by fragment and summed per pair.

1. Texts with equal sets are one class. Frequent shingles are counted over all documents (whatever recurs within a
   batch); they only shape the order.
2. A pair that links shares a shingle of both prefixes (the first n - ceil(t n) + 1 of the order). Few classes (up
   to PAIRED) that share one are paired, and the shingles that two prefixes share are counted: a pair that shares no
   others goes if its count cannot reach the overlap that the threshold asks for. Of many classes the most central
   one (fewest infrequent shingles) is the hub; each other one makes one row with it, so a large group gives a star
   and not all its pairs.
3. Per fragment, each member's set is compared with its hub's: the difference (what one has and the other has not)
   is collected and summed over the fragments.
4. Members within the threshold of their hub link to it and need no pairs among themselves. For those beyond it,
   two members of a star link when their differences from the hub differ little enough: the symmetric difference of
   two sets is that of their differences. They are compared in blocks of BLOCK members, far ones against all.

A pair that links either meets in a star of step 2 or shares all its common prefix shingles in small groups, where
they are counted exactly, so no link is lost, at any size of group.

Defined results: null, empty and white-space texts have no shingles and link with nothing; fewer than n words are
one shingle; repeated rows are equal sets; a null id joins the component of an equal set and otherwise has none (null); an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import flat_utf8, held, in_arrow, slabs, staged
from palimpsest.llm.components import components

#: Frequent shingles that take part in the order, the most frequent ones; others count as infrequent.
FREQUENT = 500_000
#: A shingle that so many texts of a batch have is counted.
RECURS = 2
#: Up to so many classes that share a prefix shingle are paired; more of them make a star.
PAIRED = 16
#: Shingles of the longest set that a fragment holds, about.
FRAGMENT = 8192
SALT_MEMBERS, BLOCK = 64, 128
BROADCAST_BYTES = 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b for b in range(256))
_R = 0x9E3779B97F4A7C15
#: Powers that a worker keeps: those of a slab.
POWERS = (1 << 21) + 1
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the multiplier and of its inverse."""
    def made() -> tuple[np.ndarray, ...]:
        out = []
        for r in (_R, pow(_R, -1, 2**64)):
            p = np.full(max(n, POWERS), r, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return tuple(out)

    power, inverse = held("powers", made) if n <= POWERS else made()
    return power[:n], inverse[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts in a row, sorted within each text, and the texts' offsets."""
    docs = len(off) - 1
    low = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    space = _SPACE[low]
    edge = np.zeros(len(low), bool)
    edge[off[:-1][np.diff(off) > 0]] = True
    before = np.concatenate([[True], space[:-1]]) | edge
    begin = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]]) | np.concatenate([edge[1:], [True]]) if len(low) else space
    end = np.flatnonzero(~space & after) + 1
    power, inverse = _pow(len(low) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * power[: len(low)])])
    word = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, off)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    owner = np.repeat(np.arange(docs, dtype=np.int64), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    size = np.minimum(words, n)[owner]
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        more = size > j
        h = np.where(more, _mix(h * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(at + j, max(len(word) - 1, 0))] + np.uint64(j + 1)), h) if len(word) else h
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(docs + 1))


def _class_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for the empty one."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros(len(off) - 1, np.uint64)
    if len(full):
        s = np.add.reduceat(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), off[:-1][full])
        x = np.bitwise_xor.reduceat(_mix(h + np.uint64(0x14057B7EF767814F)), off[:-1][full])
        out[full] = _mix(s ^ _mix(x + np.diff(off)[full].astype(np.uint64)))
    return out.view(np.int64)


def _sets(n: int):
    names = ["id", "n_shingles", "cls", "recurs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "t"):
            h, off = shingle_sets(*flat_utf8(b.column("t")), n)
            cls = _class_of(h, off)
            rows = len(cls)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(off), pa.int64()), pa.array(cls), pa.array([None] * rows, pa.int64())], names=names)
            _, one = np.unique(cls, return_index=True)
            mine = np.zeros(rows, bool)
            mine[one] = True
            s = np.sort(h[np.repeat(mine, np.diff(off))])
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            times = np.diff(np.append(start, len(s)))
            own = times >= RECURS
            k = int(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array([None] * k, pa.int64()), pa.array(times[own], pa.int64()), pa.array([None] * k, pa.int64()), pa.array(s[start[own]].view(np.int64))], names=names)

    return run


def prefix_length(n: np.ndarray, threshold: int) -> np.ndarray:
    return n - -(-threshold * n // 100) + 1


def _prefixes(n: int, threshold: int, held):
    names = ["token", "central", "cls", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = held.value
        for b in slabs(batches, "t"):
            h, off = shingle_sets(*flat_utf8(b.column("t")), n)
            cls = _class_of(h, off)
            _, one = np.unique(cls, return_index=True)
            mine = np.zeros(len(cls), bool)
            mine[one] = True
            mine &= np.diff(off) > 0
            size = np.diff(off)[mine]
            h = h[np.repeat(mine, np.diff(off))]
            owner = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(h), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                rank = np.where(frequent[at] == h, times[at], 0)
            rare = np.bincount(owner, rank == 0, len(size)).astype(np.int64)
            # Sets are sorted by hash already, so a stable sort by frequency gives the global order.
            order = np.lexsort((rank, owner))
            begin = np.cumsum(size) - size
            own = np.arange(len(h)) - begin[owner] < prefix_length(size, threshold)[owner]
            token, who = h[order][own], owner[own]
            central = (rare * 1_000_000 // np.maximum(size, 1))[who]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(central, pa.int32()), pa.array(cls[mine][who]), pa.array(size[who], pa.int64())], names=names)

    return run


MEETINGS = "hub long, member long, n_hub long, n long, kind int"
PAIR, STAR, CROWD = 0, 1, 2


def _meetings(paired: int, large: int):
    """Rows sorted by token, centrality and class to pairs (small groups) and rows of the kind `large` of large ones:
    STAR, (hub, member), or CROWD, (token, member, centrality, size), to be dealt anew."""
    names = [c.split()[0] for c in MEETINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

        def made(*cols: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        def many_rows(token: np.ndarray, cls: np.ndarray, n: np.ndarray, central: np.ndarray, hub: np.ndarray, hub_n: np.ndarray) -> pa.RecordBatch:
            if large == CROWD:
                return made(token, cls, central, n, np.full(len(cls), CROWD))
            own = hub != cls
            return made(hub[own], cls[own], hub_n[own], n[own], np.full(int(own.sum()), STAR))

        def met(token: np.ndarray, cls: np.ndarray, n: np.ndarray, central: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(token):
                return
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            many = np.repeat(size > paired, size)
            hub = np.repeat(start, size)[many]
            yield many_rows(token[many], cls[many], n[many], central[many], cls[hub], n[hub])
            for d in range(1, paired):
                i = np.flatnonzero((token[d:] == token[:-d]) & ~many[d:]) if len(token) > d else np.zeros(0, np.int64)
                if not len(i):
                    break
                yield made(cls[i], cls[i + d], n[i], n[i + d], np.full(len(i), PAIR))

        held = [np.zeros(0, np.int64)] * 4
        running: tuple[int, int, int] | None = None  # token, hub and its size of a large group that goes on
        last: tuple[int, int] | None = None
        for b in batches:
            x = [b.column(c).to_numpy().astype(np.int64) for c in ("token", "cls", "n", "central")]
            if not len(x[0]):
                continue
            keep = np.ones(len(x[0]), bool)
            keep[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
            keep[0] = (int(x[0][0]), int(x[1][0])) != last
            last = int(x[0][-1]), int(x[1][-1])
            x = [v[keep] for v in x]
            if running:
                more = x[0] == running[0]
                k = int(more.sum())
                if k:
                    yield many_rows(*[v[more] for v in x], np.full(k, running[1]), np.full(k, running[2]))
                    x = [v[~more] for v in x]
                if len(x[0]):
                    running = None
            x = [np.concatenate(v) for v in zip(held, x)]
            if not len(x[0]):
                continue
            cut = int(np.searchsorted(x[0] == x[0][-1], True)) if x[0][0] != x[0][-1] else 0
            yield from met(*[v[:cut] for v in x])
            held = [v[cut:] for v in x]
            if len(held[0]) > paired:
                yield from met(*held)
                running = int(held[0][0]), int(held[1][0]), int(held[2][0])
                held = [v[:0] for v in held]
        yield from met(*held)

    return run


def _may_link(n, m, shared, threshold: int):
    """Whether two sets whose prefixes share `shared` shingles can have the common part that the threshold asks for."""
    rest = F.greatest(F.ceil(threshold * n / 100), F.ceil(threshold * m / 100)) - 1
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & ((100 + threshold) * (shared + rest) >= threshold * (n + m))


FRAGMENTS = "hub long, salt int, fragment int, role int, cls long, n long, tokens binary"


def _fragments(n: int, parts: int):
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]
    cuts = [i * (2**64 // parts) for i in range(1, parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "t"):
            h, off = shingle_sets(*flat_utf8(b.column("t")), n)
            out, found = [], _class_of(h, off).tolist()
            for i, (cls, wants) in enumerate(zip(b.column("cls").to_pylist(), b.column("wants").to_pylist())):
                if cls != found[i]:  # another text under the same id
                    continue
                own = h[off[i] : off[i + 1]]
                pieces = np.split(own, np.searchsorted(own, np.array(cuts, np.uint64))) if cuts else [own]
                raw = [p.tobytes() for p in pieces]
                out += [(w["hub"], w["salt"], f, w["role"], cls, len(own), r) for w in wants for f, r in enumerate(raw)]
                if len(out) >= 512:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (hub, salt, fragment): the hub's row first, then its members; the difference itself only for stars."""
    now, base, base_n, before = None, np.zeros(0, np.uint64), 0, None
    for b in batches:
        hubs, members, n, m, star, count, delta = [], [], [], [], [], [], []
        for hub, salt, fragment, role, cls, size, raw in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "fragment", "role", "cls", "n", "tokens"))):
            tokens = np.frombuffer(raw, np.uint64)
            if (hub, salt, fragment, cls) == before:  # a repeated row
                continue
            before = hub, salt, fragment, cls
            if role == 0:
                now, base, base_n = (hub, salt, fragment), tokens, size
                continue
            if now != (hub, salt, fragment):
                raise ValueError("a member came without its hub")
            hubs.append(hub)
            members.append(cls)
            n.append(size)
            m.append(base_n)
            part = np.setxor1d(base, tokens, assume_unique=True).view(np.int64)
            star.append(role == 2)
            count.append(len(part))
            delta.append(part if role == 2 else part[:0])
        if hubs:
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(members, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(star, pa.bool_()), pa.array(count, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], names=["hub", "member", "n", "n_hub", "star", "differ", "part"])


def _within(differ, total, threshold: int):
    """100 * common >= threshold * all, for sets of `total` members together that differ in `differ`."""
    return 100 * (total - differ) >= threshold * (total + differ)


def _far_links(threshold: int):
    """Groups (hub, i, j): far members (side 0) against members (side 1); a spanning forest of their links."""
    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        probe, other = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not probe or not other:
            return []
        np_, nq = len(probe), len(other)
        pt, qt = np.concatenate([r[3] for r in probe]), np.concatenate([r[3] for r in other])
        pl, ql = np.array([len(r[3]) for r in probe]), np.array([len(r[3]) for r in other])
        po, qo = np.repeat(np.arange(np_), pl), np.repeat(np.arange(nq), ql)
        order = np.argsort(qt, kind="stable")
        qt, qo = qt[order], qo[order]
        lo, hi = np.searchsorted(qt, pt, "left"), np.searchsorted(qt, pt, "right")
        many = hi - lo
        common = np.zeros(np_ * nq, np.int64)
        for part in np.array_split(np.arange(len(pt)), max(1, int(many.sum()) >> 21)):  # a few million meetings at a time
            k = many[part]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[part], k)
            common += np.bincount(np.repeat(po[part], k) * nq + qo[at], minlength=np_ * nq)
        differ = pl[:, None] + ql[None, :] - 2 * common.reshape(np_, nq)
        total = np.array([r[2] for r in probe])[:, None] + np.array([r[2] for r in other])[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(_within(differ, total, threshold))):
            a, b = find(probe[i][1]), find(other[j][1])
            if a != b:
                root[a] = b
                out.append((probe[i][1], other[j][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            out = []
            for hub, i, j, side, cls, n, delta in zip(*(b.column(c).to_pylist() for c in ("hub", "i", "j", "side", "member", "n")), b.column("delta")):
                if (hub, i, j) != now:
                    out += close(held)
                    now, held = (hub, i, j), []
                held.append((side, cls, n, delta.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
        out = close(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return run


def _bounded(df: DataFrame, size) -> DataFrame:
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: int = 80, paired: int = PAIRED) -> DataFrame:
    """(key, n_shingles, component_id) of every document; component_id is the least id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    seen = staged(in_arrow(rows, _sets(n), "id long, n_shingles long, cls long, recurs long"), "sets")
    sets = seen.where("recurs is null").drop("recurs")
    top = seen.where("recurs is not null").groupBy("recurs").agg(F.sum("n_shingles").alias("times")).orderBy(F.desc("times"), "recurs").limit(FREQUENT).toPandas()
    token = top["recurs"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    held = spark.sparkContext.broadcast((token[order], top["times"].to_numpy(np.int64)[order]))
    prefixes = in_arrow(rows.where("id is not null"), _prefixes(n, threshold, held), "token long, central int, cls long, n long")
    def meet(rows_: DataFrame, large: int) -> DataFrame:
        return in_arrow(rows_.repartition("token").sortWithinPartitions("token", "central", "cls"), _meetings(paired, large), MEETINGS)

    # Large groups are dealt anew by size as well: sets that link are in the same or the next band of sizes.
    first = staged(meet(prefixes, CROWD), "meetings")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / threshold)))
    crowd = first.where(F.col("kind") == CROWD).select(F.col("hub").alias("token"), F.col("member").alias("cls"), F.col("n_hub").cast("int").alias("central"), "n")
    crowd = crowd.withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("token", "band").alias("token"), "central", "cls", "n")
    meetings = first.where(F.col("kind") == PAIR).unionByName(meet(crowd, STAR))
    edges = meetings.groupBy("hub", "member").agg(F.first("n_hub").alias("n_hub"), F.first("n").alias("n"), F.count("*").alias("shared"), (F.max("kind") == STAR).alias("star"))
    edges = edges.where(F.col("star") | _may_link(F.col("n"), F.col("n_hub"), F.col("shared"), threshold))
    edges = staged(edges.select("hub", "member", "star"), "edges")

    members = edges.groupBy("hub").agg(F.count("*").alias("members"))
    salted = edges.join(members, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.least(F.lit(4096), F.ceil(F.col("members") / SALT_MEMBERS))).cast("int"))
    salted = staged(salted, "salted")
    wants = salted.select(F.col("member").alias("cls"), "hub", "salt", F.when(F.col("star"), 2).otherwise(1).alias("role")).unionByName(
        salted.select(F.col("hub").alias("cls"), "hub", "salt", F.lit(0).alias("role")).distinct()
    )
    wants = wants.groupBy("cls").agg(F.collect_list(F.struct("hub", "salt", "role")).alias("wants"))
    reps = sets.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"))
    reps = staged(reps, "classes")
    longest = reps.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    wants = staged(wants.join(reps.where("id is not null").select("cls", "id"), "cls"), "wants")
    texts = rows.join(_bounded(wants, F.size("wants") * 24 + 32), "id")
    pieces = in_arrow(texts, _fragments(n, max(1, -(-longest // FRAGMENT))), FRAGMENTS)
    ordered = pieces.repartition("hub", "salt", "fragment").sortWithinPartitions("hub", "salt", "fragment", "role", "cls")
    parts = in_arrow(ordered, _differences, "hub long, member long, n long, n_hub long, star boolean, differ long, part array<long>")
    deltas = parts.groupBy("hub", "member").agg(
        F.first("n").alias("n"), F.first("n_hub").alias("n_hub"), F.first("star").alias("star"), F.sum("differ").alias("differ"), F.flatten(F.collect_list("part")).alias("delta")
    )
    deltas = staged(deltas.withColumn("far", ~_within(F.col("differ"), F.col("n") + F.col("n_hub"), threshold)), "deltas")

    links = deltas.where("not far").select(F.col("hub").alias("u"), F.col("member").alias("v"))
    stars = deltas.where("star")
    groups = stars.groupBy("hub").agg(F.count("*").alias("all"), F.count_if("far").alias("n_far")).where("n_far > 0 and all > 1")
    blocked = stars.join(_bounded(staged(groups, "groups"), F.lit(24)), "hub").withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    probes = blocked.where("far").select("hub", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"), "member", "n", "delta")
    others = blocked.select("hub", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "member", "n", "delta")
    far = probes.unionByName(others).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side", "member")
    links = staged(links.unionByName(in_arrow(far, _far_links(threshold), "u long, v long")), "links")
    names = reps.select("cls", "id")
    ends = links.join(names.withColumnRenamed("cls", "u").withColumnRenamed("id", "x"), "u").join(names.withColumnRenamed("cls", "v").withColumnRenamed("id", "y"), "v")
    found = components(ends, "x", "y")
    classes = reps.select("cls", F.col("id").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("cls", F.coalesce("component", "rep").alias("component_id"))
    joined = sets.join(classes, "cls", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"))
