import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_operators import brute_pii

# score, spans, redacted, n_email, _t, offset and __len are names that operators use themselves.
OWN = {"score": "double", "spans": "string", "redacted": "string", "n_email": "string", "_t": "string", "offset": "string", "__len": "string", "hit": "string", "others": "string"}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {t}" for c, t in OWN.items())
EXTRA = (0.25, *[f"own {c}" for c in list(OWN)[1:]])
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contaminated(text, items):
    w = words(text)
    windows = {tuple(v[i : i + 10]) for v in map(words, items) for i in range(max(1, len(v) - 9)) if v}
    return any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))


def redacted(text):
    """Base spans of a text whose spans do not overlap."""
    out, done = "", 0
    for kind, s, e in sorted(brute_pii(text), key=lambda x: x[1]):
        out, done = out + text[done:s] + f"[{kind.upper()}]", e
    return out + text[done:]


DISGUISED = {"write to jo (at) ex [dot] org today": "write to [EMAIL] today", "call +1 four one five 555 12 34 now": "call [PHONE] now"}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choices(["th", "ou", "ing", "a", "re", "st"], k=r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(5, 80))) for _ in range(40)]
    items = [" ".join(word() for _ in range(14)) for _ in range(5)]
    texts += [texts[0], texts[1] + " more", None, "", "12 34 !!", texts[2] + " " + items[0], "Mail me at me@x.org or +1 (415) 555-1234 " + word(), *DISGUISED]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_every_stage_equals_brute_force(spark, fixture):
    path, rows, items = fixture
    now = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, path), name)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", *OWN]
        if name == "language_id":
            kept = {i: (i, t, lang or "en", *rest) for i, t, lang, *rest in kept.values() if any(c.isalpha() for c in t or "")}  # one language is learned
        elif name == "near_duplicates":
            kept = {i: kept[i] for i, _, c in brute(sorted(kept.values())) if i == c}
        elif name == "decontamination":
            kept = {i: r for i, r in kept.items() if not contaminated(r[1], items)}
        else:
            kept = {i: (i, t := DISGUISED.get(r[1]) or redacted(r[1]), *r[2:4], len(t), *r[5:]) for i, r in kept.items()}
        assert sorted(map(tuple, now.collect())) == sorted(kept.values()), name
    assert "[EMAIL]" in "".join(r[1] for r in kept.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert {p.doc_id for p in pieces} == set(kept)


def test_run_and_names(spark, fixture):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    assert corpus_pipeline.run(spark, fixture[0]).count() > 0


def test_empty_documents(spark, fixture, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{fixture[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
