"""Token counts by linear longest-match with a failure-link automaton.

The vocabulary's pieces form a trie over bytes. Each node carries a failure link and the number of pieces that
are popped when the link is taken, both computed once; the greedy longest-match length of a word is then the sum
of popped counts along one pass over its bytes, without building a piece. The automaton is run over many words side
by side, one byte of each in a step, and each different word of a batch is counted once.

A text is cut at white space (space, tab, line ends, VT, FF); a word is matched with the word mark in front. A
word that cannot be covered by the vocabulary counts as one unknown piece. Long texts are read in blocks of whole
words, long words one byte after the other.

Defined results: null, empty and white-space texts have no words and no pieces; repeated rows do not matter; an empty
table gives an empty result; input columns named as the added ones are replaced, other names are free.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import blocks, flat_utf8, fresh, held, in_arrow, slabs, word_bounds

MARK = b" "
#: Words whose counts a worker knows; beyond that it starts anew.
CACHE_WORDS = 400_000
#: Longer words are not run side by side with others.
LONG_WORD = 1024
BLOCK_BYTES = 2 << 20
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece and rank in each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """goto as a sorted edge list (node * 256 + byte -> node); fail and popped by node; -1: no link."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for p in pieces:
            node = 0
            for b in p:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(False)
                node = children[node][b]
            ends[node] = bool(p)
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for b, u in children[v].items():
                if ends[u]:
                    fail[u], popped[u] = 0, 1
                else:
                    z, n = fail[v], popped[v]
                    while z != -1 and b not in children[z]:
                        n += popped[z]
                        z = fail[z]
                    if z != -1:
                        fail[u], popped[u] = children[z][b], n
                queue.append(u)
        edges = sorted((v << 8 | b, u) for v, c in enumerate(children) for b, u in c.items())
        self.key = np.array([e[0] for e in edges] or [-1], np.int64)
        self.to = np.array([e[1] for e in edges] or [0], np.int32)
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self.root = np.full(256, -1, np.int32)
        for b, u in children[0].items():
            self.root[b] = u

    def count(self, word: bytes) -> int:
        """Greedy longest-match length of one word, byte by byte; -1 if it has none."""
        if not hasattr(self, "edges"):
            self.edges = dict(zip(self.key.tolist(), self.to.tolist()))
            self.links = list(zip(self.fail.tolist(), self.popped.tolist()))
        edges, links, node, n = self.edges, self.links, 0, 0
        for b in word:
            while (to := edges.get(node << 8 | b)) is None:
                link, more = links[node]
                if link < 0:
                    return -1
                node, n = link, n + more
            node = to
        while node:
            link, more = links[node]
            if link < 0:
                return -1
            node, n = link, n + more
        return n

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Greedy longest-match lengths; -1 for a word that has none."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        out = self._side_by_side([b"" if len(w) > LONG_WORD else w for w in words] if long else words)
        out[long] = [self.count(words[i]) for i in long]
        return out

    def _side_by_side(self, words: list[bytes]) -> np.ndarray:
        n = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-n, kind="stable")
        start = (np.cumsum(n) - n)[order]
        size = n[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        out = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)
        dead = np.zeros(len(words), bool)
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))
            todo = np.flatnonzero(~dead[:m])
            byte = data[start[todo] + t]
            while len(todo):
                want = node[todo] << 8 | byte
                at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                hit = self.key[at] == want
                node[todo[hit]] = self.to[at[hit]]
                todo, byte = todo[~hit], byte[~hit]
                link = self.fail[node[todo]]
                dead[todo[link < 0]] = True
                todo, byte, link = todo[link >= 0], byte[link >= 0], link[link >= 0]
                out[todo] += self.popped[node[todo]]
                node[todo] = link
        todo = np.flatnonzero(~dead & (node > 0))
        while len(todo):  # the rest of each word is popped along the links down to the root
            link = self.fail[node[todo]]
            dead[todo[link < 0]] = True
            todo, link = todo[link >= 0], link[link >= 0]
            out[todo] += self.popped[node[todo]]
            node[todo] = link
            todo = todo[link > 0]
        out[dead] = -1
        back = np.empty_like(out)
        back[order] = out
        return back


def greedy(word: bytes, pieces: set[bytes]) -> int:
    """The same count by trying prefixes from the longest on; for tests."""
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


class Counter:
    """Counts of texts by an automaton that each different word is put to once."""

    def __init__(self, path: str):
        self.automaton = Automaton(vocabulary(path))
        self.forget()

    def forget(self) -> None:
        self.known, self.value = pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def of(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows (words, pieces, unknown words) of all texts in a row."""
        begin, end = word_bounds(raw, off, _SPACE)
        place = np.searchsorted(begin, off)
        ends = np.append(0, np.cumsum(end - begin))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw[~_SPACE[raw]])])
        coded = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        mine = coded.dictionary.take(pa.array(new))
        at[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, mine])
        self.value = np.append(self.value, self.automaton.counts([MARK + w for w in mine.to_pylist()]))
        n = self.value[at][coded.indices.to_numpy()]
        total = [np.append(0, np.cumsum(x)) for x in (np.ones(len(n), np.int64), np.abs(n), n < 0)]
        if len(self.known) > CACHE_WORDS:
            self.forget()
        return np.stack([np.diff(t[place]) for t in total])

    def of_any(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """As `of`; a text beyond BLOCK_BYTES, which is a slab by itself, is read in blocks."""
        if len(off) != 2 or len(raw) <= BLOCK_BYTES:
            return self.of(raw, off)
        return sum(self.of(raw[lo:hi], np.array([0, hi - lo])) for lo, hi in blocks(raw, _SPACE, BLOCK_BYTES))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_words, n_tokens (unknown words count as one) and n_unknown (long)."""
    names = ["n_words", "n_tokens", "n_unknown"]
    keep = [f for f in docs.schema.fields if f.name.lower() not in names]
    (body,) = fresh([f.name for f in keep], "_t")
    schema = T.StructType([*keep, *[T.StructField(x, T.LongType()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("pieces", path), lambda: Counter(path))
        for b in slabs(batches, body, BLOCK_BYTES):
            got = counter.of_any(*flat_utf8(b.column(body)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(c, pa.int64()) for c in got]], names=schema.names)

    return in_arrow(docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias(body)), run, schema)
