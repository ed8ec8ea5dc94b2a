import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm.suffixdedup import deduplicated, repeated, suffix_order

SCHEMA = "doc_id long, text string, spans string, kept_sha256 string"


def symbols(strings):
    return np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1), np.array([len(s) for s in strings], np.int64)


def test_suffix_order_and_common_prefixes():
    r = random.Random(5)
    for _ in range(100):
        strings = [bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(r.randint(1, 6))]
        owner, length, lcp = suffix_order(*symbols(strings))
        suffixes = sorted((tuple(c + 1 for c in s[i:]) + (0, j), j, len(s) - i) for j, s in enumerate(strings) for i in range(len(s) + 1))
        assert [(j, n) for _, j, n in suffixes] == list(zip(owner, length))
        for (a, *_), (b, *_), common in zip(suffixes, suffixes[1:], lcp[1:]):
            assert common == next(k for k in range(len(a)) if a[k] != b[k] or a[k] == 0)


def test_repeated_windows_of_strings():
    r = random.Random(6)
    for _ in range(100):
        width = r.choice([2, 4])
        strings = [bytes(r.choices(b"ab", k=r.randint(width, 14))) for _ in range(r.randint(1, 6))]
        doc, start = np.array([r.randint(0, 3) for _ in strings]), np.arange(len(strings)) * 100
        seen, expected = set(), []
        for d, s, w in sorted((int(doc[i]), int(start[i]) + k, x[k : k + width]) for i, x in enumerate(strings) for k in range(len(x) - width + 1)):
            if w in seen:
                expected.append((d, s))
            seen.add(w)
        assert sorted(zip(*map(np.ndarray.tolist, repeated(strings, doc, start, width)))) == expected


def brute(rows, width=100):
    seen, out = set(), []
    for d, text, *_ in sorted(rows):
        b = (text or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                hit[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, y in zip(b, hit) if not y)
        out.append((d, len(b), sum(hit), sum(hit[i] and (i == 0 or not hit[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdefgh é\n", k=n))
    base, line = [text(r.randint(50, 700)) for _ in range(6)], text(130)
    rows = [text(r.randint(0, 300)) for _ in range(10)] + ["", "x" * 99, "x" * 100, "x" * 1500, "ab" * 700, text(37) * 20]
    for _ in range(40):
        t = r.choice(base)
        i = r.randrange(len(t))
        rows.append(t[:i] + text(r.randint(0, 4)) + t[i + r.randint(0, 3) :])
    rows += [text(r.randint(0, 60)) + line + text(r.randint(0, 60)) for _ in range(30)] + [base[0]] * 5
    r.shuffle(rows)
    return [(i * 3 + 1, t, "a", "b") for i, t in enumerate(rows)] + [(100_000, None, "a", "b")]


@pytest.mark.parametrize("seed,wide_key", [(1, 192), (2, 1)])
def test_removed_bytes_equal_brute_force(spark, seed, wide_key):
    rows = corpus(seed)
    got = deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(5), wide_key=wide_key)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edge_cases(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "".join(chr(97 + i * 7 % 26) + chr(97 + i * i % 23) for i in range(80))
    got = deduplicated(spark.createDataFrame([(5, t, "", ""), (5, t, "", ""), (None, t, "", "")], SCHEMA)).collect()
    assert sorted(((r[0], r[2]) for r in got), key=str) == sorted([(None, 0), (5, 160), (5, 160)], key=str)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(120, 400))) for _ in range(30)]
    texts += [texts[0] + texts[1], texts[2][:110] * 2, texts[3] + "!" + texts[3]]
    rows = [(r.choice([None, None, 7, 7, 8, -(2**63), i]), t, "a", "b") for i, t in enumerate(texts)] + [(7, texts[0], "a", "b"), (7, texts[0], "a", "b"), (None, None, "a", "b"), (9, "", "a", "b")]
    got = deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    number = {x: n for n, x in enumerate(sorted({(-(2**63) if i is None else i, digest(t), i) for i, t, *_ in rows}, key=lambda x: (x[0], x[1], x[2] is not None)))}
    kinds = {(number[-(2**63) if i is None else i, digest(t), i], t) for i, t, *_ in rows}
    expected = {n: rest for n, *rest in brute(sorted(kinds, key=lambda x: x[0]))}
    want = sorted(repr((i, *expected[number[-(2**63) if i is None else i, digest(t), i]])) for i, t, *_ in rows)
    assert sorted(repr(tuple(x)) for x in got) == want


def test_unrelated_rows_without_an_id_keep_their_bytes(spark):
    r = random.Random(10)
    p, other = ("".join(r.choices("abcdefghijk", k=150)) for _ in range(2))
    got = {(x.doc_id, x.n_bytes, x.n_removed) for x in deduplicated(spark.createDataFrame([(None, p + "|" + p, "", ""), (None, other * 1 + "z", "", ""), (5, "other", "", "")], SCHEMA)).collect()}
    assert got == {(None, 301, 150), (None, 151, 0), (5, 5, 0)}
