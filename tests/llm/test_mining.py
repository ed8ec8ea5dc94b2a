"""Collocations, centroids and toxicity against brute force, and their results for odd rows."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest

from palimpsest.llm import centroids, collocations, toxicity


def brute_counts(rows, longest, threshold):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", " ".join(words[i : i + k])] += 1
    return n, {k: v for k, v in f.items() if v >= threshold}


def brute_phrases(rows, longest, threshold, top):
    n, f = brute_counts(rows, longest, threshold)
    found = collections.defaultdict(list)
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if any(x == lang and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} " and b >= a for (x, p), b in f.items()):
            continue
        found[lang].append((-score, -a, phrase.encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in found.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])}


def texts(seed, count):
    rng = random.Random(seed)
    vocabulary = ["Aa", "b", "ccc", "ÄÖ", "d'e", "x\x00y", "漢", "f"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]
    return [("".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(count)]


@pytest.mark.parametrize("capacity", [1 << 17, 8])
def test_collocations(spark, capacity):
    rows = [*texts(3, 150), (None, "en"), ("", None), ("  \n ", "fr"), ("same words here", "en"), ("same words here", "en"), ("long " * 4000, "de")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n long").repartition(3)
    n, f = brute_counts(rows, 4, 6)
    counts = collocations.frequent(df, longest=4, threshold=6, capacity=capacity).collect()
    assert {(r.lang, r.phrase): r.n for r in counts if r.words} == f
    assert {r.lang: r.n for r in counts if not r.words} == {k: v for k, v in n.items() if v}
    got = {tuple(r) for r in collocations.collocations(df, longest=4, threshold=6, top=20).collect()}
    assert got == brute_phrases(rows, 4, 6, 20)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(5)
    for threshold, hot in ((20, 1), (20, 4000), (3, 50)):
        key = np.concatenate([rng.integers(0, 5000, 20000), np.repeat(77, hot), rng.zipf(1.5, 5000) % 9000]).astype(np.uint64)
        rng.shuffle(key)
        summary = collocations.Summary(len(key) // threshold // 4, threshold)
        for part in np.array_split(key, 37):
            summary.add(*collocations.added(part, np.ones(len(part), np.int64)))
        kept, times = summary.survivors(), collections.Counter(key.tolist())
        assert {k for k, n in times.items() if n >= threshold} <= set(kept.tolist())
        assert summary.taken < threshold
        at = dict(zip(summary.key.tolist(), summary.times.tolist()))
        assert all(n - summary.taken <= at.get(k, 0) <= n for k, n in times.items())


def test_scores_pass_64_bits(spark):
    a, n = 4 * 10**12, 9 * 10**15
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "x", a + 1), ("en", 1, "y", a + 3), ("en", 2, "x y", a)], "lang string, words int, phrase string, n long")
    (row,) = collocations.scored(counts).collect()
    assert row.score == 1000 * a * n // ((a + 1) * (a + 3))


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else w for j, w in enumerate(c)]
    return sorted((str(i), near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, c[near(v)[1]])).encode()).hexdigest()) for i, v in kept)


@pytest.mark.parametrize("wide", [1.0, 300.0, 2.0**20])
def test_centroids(spark, wide):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-wide, wide) / rng.choice([1, 1, 50]) for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, list(rows[3][1])) for i in range(20)] + [(200, [0.0] * 64), (201, [-1 / 64] * 64), (None, [0.5] * 64)]
    odd = [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [1.0] * 63 + [None]), (304, [float("nan")] * 64), (305, [1.0] * 63 + [float("inf")]), (306, [])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows + odd], "vec_id long, embedding array<double>, cluster int, planes string").repartition(3)
    got = centroids.report(*centroids.clustered(df, k=9)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.centroid_sha256) for r in got) == brute_clusters(rows, 9, 3)
    sums = collections.Counter()
    for r in got:
        sums[r.cluster] += r.distance
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in got)


def test_centroids_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.report(*centroids.clustered(spark.createDataFrame([], schema))).count() == 0
    two = centroids.report(*centroids.clustered(spark.createDataFrame([(1, [1.0] * 64), (2, [0.0] * 64), (3, None)], schema))).collect()
    assert sorted((r.vec_id, r.distance) for r in two) == [(1, 0), (2, 0)] and len({r.cluster for r in two}) == 2
    same = centroids.report(*centroids.clustered(spark.createDataFrame([(5, [1.0] * 64)] * 3, schema), k=2)).collect()
    assert [(r.cluster, r.distance) for r in same] == [(0, 0)] * 3
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], schema))


def test_bit_planes_are_exact():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(1 << 27), 1 << 27, (2, 40, 64))
    x[0], x[1] = -(1 << 27), (1 << 27) - 1
    n, m = int(centroids.needed(x).max()), int(centroids.needed(y).max())
    assert (centroids.unpacked(centroids.packed(x, n)) == x).all()
    assert (centroids.products(centroids.packed(x, n), centroids.packed(y, m)) == (x * y).sum(axis=1)).all()
    assert centroids.needed(np.array([[0, -1], [1, 0], [-2, 1], [127, 0], [128, 0], [-128, 0]])).tolist() == [1, 2, 2, 8, 9, 8]


def test_words_and_features():
    rows = ["Some SOME words_here", "", None, "Été 漢字x 漢字x", "a" * 50]
    raw = np.frombuffer("".join(t or "" for t in rows).encode(), np.uint8)
    off = np.cumsum([0, *[len((t or "").encode()) for t in rows]])
    (c,) = toxicity.chunks(raw, off)
    names = c.texts()
    assert sorted((int(d), names[w]) for d, w in zip(c.doc, c.word)) == [(0, "here"), (0, "some"), (0, "words"), (3, "été"), (3, "漢字x"), (4, "a" * 50)]
    word, _ = c.features()
    size = collections.Counter(word.tolist())
    assert all(size[i] == sum(max(len(w) + 2 - n + 1, 0) for n in toxicity.ORDERS) for i, w in enumerate(names))


def test_long_texts_score_as_whole_ones(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(4000)).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    model = toxicity.Model(-1.0, np.random.default_rng(1).normal(0, 0.001, toxicity.PLACES).astype(np.float32))
    whole = model.score(raw, off)
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    assert len(list(toxicity.chunks(raw, off))) > 10
    assert np.allclose(model.score(raw, off), whole)


def toxic_rows(seed, count):
    rng = random.Random(seed)
    clean, bad = ["tree", "river", "stone", "cloud", "window", "paper"], ["wretch", "wretched", "vilest", "viler"]
    out = []
    for i in range(count):
        words = [rng.choice(clean) + rng.choice(["", "s", "y"]) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(i % 5 == 0)))
    return out


def test_toxicity(spark):
    rows = toxic_rows(2, 400)
    extra = [(None, "wretched", "x", 9), (1000, None, "x", 9), (1001, "", "x", 9), (1002, " .\n", "x", 9), (7, rows[7][1], "x", 9)]
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in rows] + extra, "doc_id long, text string, Score string, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, 0), (4, None), (6, 5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert [(r.predicted, r.held_out) for r in got if r.doc_id is None] == [(1, False)]
    again = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert sorted(r.score for r in again) == sorted(r.score for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()] == [0.5, 0.5]
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    from palimpsest.llm.queries import op11_toxicity

    rows = op11_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    bad = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(bad) >= 0.85 * len(bad) and sum(clean) <= 0.01 * len(clean)
