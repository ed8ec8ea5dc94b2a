import random
import re

import pytest

from palimpsest.llm.jaccard import near_duplicates

SCHEMA = "doc_id long, text string, cls string, hub string"


def brute(rows):
    low = {i: i + 32 for i in range(65, 91)}
    sets, parent = {}, {}
    for i, (d, text, *_) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in sets:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in sets)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "  \n", "a", None), (4, "One two", "", ""), (5, "one TWO", "", ""), (6, "x y z w v", "", ""), (7, "x y z w v", "", "")]
    for family in range(6):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(2, 40)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) + 10, " ".join(w), "c", "h"))
    line = [word() for _ in range(25)]
    rows += [(len(rows) + 1000 + i, " ".join(line + [word() for _ in range(r.randint(0, 40))]), "c", "h") for i in range(40)]
    return rows


@pytest.mark.parametrize("seed,paired", [(1, 16), (2, 1), (3, 3)])
def test_components_equal_brute_force(spark, seed, paired):
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), paired=paired)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edge_cases(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (None, "q", "", "")]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(same, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None)], key=str)
