"""Empty tables, clashing column names, long texts."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, flac, langid, packing, pii, wordpiece
from palimpsest.llm.queries import tokenizer_file

OWN = ["__t", "_t", "_letter", "score", "spans", "offset", "__len", "_len", "_part", "_rank", "_start", "_range", "hit", "n_email", "n_tokens", "lang_pred", "piece", "length", "_old", "t", "k"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in OWN)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", *OWN) for i, t in enumerate(texts)], SCHEMA)


def operators(spark):
    items = spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")
    return {
        "pii": pii.find, "tokens": lambda d: wordpiece.token_counts(d, tokenizer_file("byte_bpe_50k.tiktoken")),
        "language": lambda d: langid.identify(d, langid.train(d)), "decontamination": lambda d: decontam.contamination(d, items),
        "packing": lambda d: packing.pack(d.withColumn("length", F.lit(3)).drop("offset"), order=("doc_id",)),
    }


def test_empty_tables(spark):
    none = table(spark, [])
    for name, f in operators(spark).items():
        assert f(none).count() == 0, name
    assert flac.features(flac.to_media(none)).count() == 0 and flac.pcm_blocks(flac.to_media(none)).count() == 0
    assert packing.pack_documents(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns)).count() == 0
    assert decontam.decontaminated(table(spark, ["some words"]), spark.createDataFrame([], "item_id long, text string")).count() == 1


def test_other_columns_stay(spark):
    docs = table(spark, ["Mail me@x.org, some words of a benchmark item here", None, ""])
    for name, f in operators(spark).items():
        out = f(docs)
        added = {"pii": {"spans", "n_email"}, "tokens": {"n_tokens"}, "language": {"lang_pred", "score"}, "decontamination": {"hit"}, "packing": {"offset", "length"}}[name]
        rows = out.collect()
        assert len(rows) == 3, name
        for r in rows:
            assert all(r[c] == c for c in OWN if c not in added), (name, r)


def test_sequences_are_near_the_fewest(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    packed = packing.pack_documents(spark.read.parquet(path), tokenizer_file("word_bpe_49k.json")).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert packed[1] <= -(-packed[0] // 4096) + 1


@pytest.mark.parametrize("unit", ["x", "ab" * 7 + "é", "漢"])
def test_long_words_are_counted_in_time(unit):
    counter = wordpiece.Counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    word = (unit * ((1 << 20) // len(unit.encode()))).encode()
    began = time.process_time()
    got = counter.of_any(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    assert time.process_time() - began < 5 and got[0, 0] == 1 and got[1, 0] > len(word) // 200
    short = word[:3000]
    pieces = set(wordpiece.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken")))
    assert counter.automaton.count(b" " + short) == wordpiece.greedy(b" " + short, pieces)


def test_long_texts_in_blocks(monkeypatch):
    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdeé'.1", k=r.randint(1, 8))) for _ in range(4000)).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    words, counter = packing.WordIds(tokenizer_file("word_bpe_49k.json")), wordpiece.Counter(tokenizer_file("byte_bpe_50k.tiktoken"))
    found = decontam.Windows([("a", text[5000:5200].decode(errors="ignore")), ("b", "zz yy")], 4)
    whole = words.of_any(raw, off)[0].tolist(), counter.of_any(raw, off).tolist(), found.scan(raw, off)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 700)
    monkeypatch.setattr(wordpiece, "BLOCK_BYTES", 700)
    monkeypatch.setattr(decontam, "TEXT_BYTES", 700)
    again = words.of_any(raw, off)[0].tolist(), counter.of_any(raw, off).tolist(), found.scan(raw, off)
    assert whole[:2] == again[:2] and (whole[2][0] == again[2][0]).all() and whole[2][1:] == again[2][1:] and whole[2][1]


def test_long_streams_in_groups(monkeypatch):
    r = np.random.default_rng(2)
    x = np.cumsum(r.integers(-2, 3, 50_000)).clip(-128, 127)
    whole = flac.encode(x, np.array([len(x)]))
    monkeypatch.setattr(flac, "GROUP_SAMPLES", 2 * flac.BLOCK)
    monkeypatch.setattr(flac, "GROUP_BYTES", 3000)
    monkeypatch.setattr(flac, "MOST_POINTS", 5)
    parts = flac.encode(np.append(x, x[:100]), np.array([len(x), 100]))
    assert parts[0][-len(whole[0]) // 2 :] == whole[0][-len(whole[0]) // 2 :]
    for stream, samples in ((whole[0], x), (parts[0], x), (parts[1], x[:100])):
        blocks = flac.decode([stream])[0]
        assert (np.concatenate([b for _, b in blocks]) == samples).all()
    # Without seek points the frames are read one after the other.
    bare, at = bytearray(whole[0][:4]), 4
    while True:
        last, kind, size = whole[0][at] & 0x80, whole[0][at] & 0x7F, int.from_bytes(whole[0][at + 1 : at + 4], "big")
        if kind != 3:
            bare += whole[0][at : at + 4 + size]
        at += 4 + size
        if last:
            break
    assert (np.concatenate([b for _, b in flac.decode([bytes(bare) + whole[0][at:]])[0]]) == x).all()
