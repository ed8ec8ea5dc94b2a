"""The operators against brute force, exact round trips or held-out accuracy, on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, flac, langid, packing, pii, warc, wordpiece
from palimpsest.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, hit string, spans string"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i), None, None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


TEXTS = [None, "", " \n", "a", "Plain words, and a few more.", "Ünïcödé été ñandú 漢字 🙂", "x" * 5000, "word " * 6000, "a b\x0bc d <|endoftext|> I'll we've 12345", "same", "same"]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack_documents(docs(spark, TEXTS), path, capacity=256, keep_ids=True)
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.piece))
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(TEXTS):
        own = [r for r in got if r.doc_id == i]
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 256)) and all(r.length == len(r.ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(fill) <= 1.02 * sum(r.length for r in got) / 256 + 1
    seqs = packing.sequences(rows).collect()
    assert sorted(len(s.ids) for s in seqs) == sorted(sum(n for _, n in p) for p in fill.values())
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_best_fit_plan_places_every_piece_once():
    r = random.Random(1)
    for _ in range(200):
        histogram = {r.randint(1, 50): r.randint(1, 30) for _ in range(r.randint(1, 20))}
        used = {}
        ranks = {}
        for length, lo, hi, first, k, offset in packing.best_fit_plan(histogram, 50):
            ranks.setdefault(length, []).append((lo, hi))
            for i in range(hi - lo):
                used.setdefault(first + i // k, []).append((offset + i % k * length, length))
        assert {n: sum(b - a for a, b in v) for n, v in ranks.items()} == histogram
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 50


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_equals_brute_force():
    r = random.Random(2)
    for alphabet in ("a1.@-+ 2(", "0123456789 -.", "ab@.é"):
        for _ in range(3000):
            t = "".join(r.choices(alphabet, k=r.randint(0, 40)))
            assert pii.detect(t) == brute_pii(t), t


@pytest.mark.parametrize("text,kind,found", [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("x (at) y.com", "email", "x (at) y.com"),
    ("a[at]b[dot]org", "email", "a[at]b[dot]org"),
    ("jоhn@example.com", "email", "jоhn@example.com"),
    ("j@exa​mple.com", "email", "j@exa​mple.com"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("call plus one four one five five five five one two three four", "phone", "plus one four one five five five five one two three four"),
    ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_disguises_map_to_the_source(text, kind, found):
    base = pii.detect(text)
    assert (kind, found) in [(k, text[s:e]) for k, s, e in pii.disguised(text, base)]


@pytest.mark.parametrize("text", ["look at example.com", "bob at mail.example.com", "one two three", "the dot at noon", "zero one two three four five six", "4111 1111 1111 1112", "é dot à la carte at home"])
def test_clean_text_stays_clean(text):
    assert pii.detect(text) + pii.disguised(text, pii.detect(text)) == []


def test_pii_rows(spark):
    rows = pii.find(docs(spark, [*TEXTS, "me@x.org, +1 (415) 555-1234"]), redacted="text").collect()
    assert len(rows) == len(TEXTS) + 1 and max(rows, key=lambda r: r.doc_id).text == "[EMAIL], [PHONE]"
    assert all(r.n_email == 0 and r.spans == "" for r in rows if r.doc_id < len(TEXTS))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    r = random.Random(3)
    word = lambda: r.choice(["ab", "Cd", "é9", "x"])
    texts = [None, "", "!?", "one"] + [r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(1, 60))) for _ in range(60)]
    items = [(i, r.choice([" ", "-"]).join(word() for _ in range(r.randint(1, 7)))) for i in range(20)] + [(99, None), (None, "ab"), (50, "!"), (7, "x x x")]
    low = {i: i + 32 for i in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    got = {x.doc_id: x for x in decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), n=4).select("doc_id", "text", "hit.*").collect()}
    for i, t in enumerate(texts):
        w, hit, who = words(t), set(), set()
        for item, text in items:
            v = words(text) if item is not None else []
            for size, wins in [(min(4, len(v)), [v[j : j + 4] for j in range(max(1, len(v) - 3))])] if v else []:
                for win in wins:
                    for k in range(len(w) - size + 1):
                        if w[k : k + size] == win:
                            hit |= set(range(k, k + size))
                            who.add(str(item))
        x = got[i]
        assert (x.n_words, x.n_hit, x["items"]) == (len(w), len(hit), sorted(who)), t
        assert len(hit) == sum(len(words(t[s.start : s.end])) for s in x.spans)


def test_chat_round_trip(spark):
    hard = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<|", "a<", "line\nline\r\n", "<\\\\|im_end|>\n", "é🙂" * 3, None]
    rows = [(c, t, ("user", "assistant", "sys\n<|tem", None)[t % 4], hard[(c + t) % len(hard)]) for c in range(9) for t in range(7)] + [(None, 0, "user", "x"), (1, 1, "assistant", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    segments = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    texts = {r.conv_id: r for r in chat.format_conversations(segments).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1], v[2]))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        said = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
        f = texts[c].formatted
        assert len(f) == got[c].formatted_chars and [(r, x) for r, x, *_ in chat.parse(f)] == [(r, x) for _, r, x in own]
        assert "".join(chat.unescape(f[s.start : s.end]) for s in texts[c].loss) == said


def test_token_counts_equal_greedy(spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    pieces = set(wordpiece.vocabulary(path))
    for r in wordpiece.token_counts(docs(spark, TEXTS), path).collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(wordpiece.greedy(b" " + w, pieces) for w in words), 0)
    rnd = random.Random(4)
    for _ in range(100):
        vocabulary = sorted({bytes(rnd.choices(b"abc", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 8))})
        words = [bytes(rnd.choices(b"abc", k=rnd.randint(1, 12))) for _ in range(40)]
        assert list(wordpiece.Automaton(vocabulary).counts(words)) == [wordpiece.greedy(w, set(vocabulary)) for w in words]


def test_warc_round_trip(spark):
    import base64

    pages = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b\r\nX: y", None), (4, "u", ""), (5, "u", "x" * 1000 + "\r\n\r\nWARC/1.0\r\n" * 30), (6, "ü", "x" * 1000 + "\r\n\r\nWARC/1.0\r\n" * 30), (7, "u", "é" * 333), (7, "u", "é" * 333), (None, "n", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, head string, data string").repartition(3)
    for least in (0, 100):
        chunks = warc.write_records(df, min_bytes=least, chunk=100)
        assert chunks.agg(F.max(F.octet_length("data"))).first()[0] < 1000
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.read_records(chunks).collect()), key=str)
        expected = []
        for i, _, html in pages:
            raw = (html or "").encode()
            first = min((j for j, _, h in pages if (h or "").encode() == raw and j is not None), default=None)
            again = i is not None and len(raw) >= least and first < i
            expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None, True))
        assert got == sorted(expected, key=str)
    assert warc.read_records(warc.write_records(df.limit(0))).count() == 0


def test_language_id(spark):
    r = random.Random(7)
    stems = {"en": ["the", "and", "thing", "with", "ouse"], "de": ["sch", "ung", "ein", "für", "heit"], "fr": ["é", "eau", "tion", "que", "les"]}
    texts, langs = [], {}
    for i in range(300):
        lang = r.choice(sorted(stems))
        langs[i] = lang
        texts.append(" ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(r.randint(4, 30))))
    texts += [None, "", "123 !?", "the thing with the ouse"]
    df = docs(spark, texts, langs)
    rows = langid.identify(df, langid.train(df)).withColumn("out", langid.held_out()).collect()
    tested = [x for x in rows if x.out and x.doc_id in langs]
    assert len(tested) > 60 and np.mean([x.lang_pred == langs[x.doc_id] for x in tested]) > 0.95
    by = {x.doc_id: x for x in rows}
    assert [by[i].lang_pred for i in range(300, 304)] == ["und", "und", "und", "en"] and all(0 <= x.score <= 1 for x in rows)
    assert all(x.out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    none = docs(spark, ["abc", None])
    assert {x.lang_pred for x in langid.identify(none, langid.train(none)).collect()} == {"und"}


def brute_bits(sample, text):
    """Code length of a text under contexts of 3, 2, 1 and 0 bytes counted on the sample, byte by byte."""
    counts = [{} for _ in range(4)]
    for t in sample:
        for i in range(len(t)):
            for k in range(4):
                context = (bytes(3) + t[:i])[-k:] if k else b""
                counts[k].setdefault(context, {}).setdefault(t[i], 0)
                counts[k][context][t[i]] += 1
    total = 0.0
    for i, b in enumerate(text):
        for k in (3, 2, 1, 0):
            seen = counts[k].get((bytes(3) + text[:i])[-k:] if k else b"", {})
            room = sum(seen.values()) + len(seen)
            if b in seen:
                total -= math.log2(seen[b] / room)
                break
            total -= math.log2(len(seen) / room) if seen else 0
        else:
            total += 8
    return total


def test_code_lengths_equal_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    r = random.Random(5)
    make = lambda abc: "".join(r.choices(abc, k=r.choice([0, 1, 2, 3, 9, 40]))).encode()
    for _ in range(20):
        samples = {"x": [make("abé") for _ in range(6)], "y": [make("bc\0漢") for _ in range(6)]}
        counts = {}
        for name, texts in samples.items():
            off = np.cumsum([0, *map(len, texts)])
            counts[name] = np.unique(langid.contexts(np.frombuffer(b"".join(texts), np.uint8), off), return_counts=True)
        trees = langid.Trees(["x", "y"], counts)
        texts = [make("abcé漢\0z") for _ in range(9)]
        got = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert np.allclose(got, [[brute_bits(samples[name], t) for name in ("x", "y")] for t in texts], rtol=1e-5, atol=1e-4)


def test_language_id_repeats_ties_and_clashes(spark):
    rows = [(i, t, lang, 0.5, "t") for i, (t, lang) in enumerate([("same words", "b"), ("same words", "a")] * 8 + [("same words", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, _t string")
    out = langid.identify(df, langid.train(df)).collect()
    assert {(x.lang_pred, x._t) for x in out} == {("a", "t")} and all(abs(x.score - 0.5) < 1e-6 for x in out)
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_flac_streams():
    r = np.random.default_rng(1)
    t = np.arange(9000)
    signals = [(100 * np.sin(t / 20)).astype(int), (90 * np.sin(t / 9) + r.normal(0, 5, 9000)).astype(int).clip(-128, 127), r.integers(-128, 128, 5000), np.full(64, -128), np.zeros(5000, int), np.array([5]), np.cumsum(r.integers(-2, 3, 8000)).clip(-128, 127)]
    streams = flac.encode(np.concatenate(signals), np.array([len(x) for x in signals]))
    for x, blocks in zip(signals, flac.decode(streams)):
        assert (np.concatenate([b for _, b in blocks]) == x).all() and [o for o, _ in blocks] == list(range(0, len(x), flac.BLOCK))
    bad = bytearray(streams[1])
    bad[-100] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])


def test_media_rows(spark):
    rows = flac.features(flac.to_media(docs(spark, TEXTS))).collect()
    by = {x.doc_id: x for x in rows}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        x = by[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[9].media_sha256 == by[10].media_sha256 and by[9].feature == by[10].feature
    blocks = flac.pcm_blocks(flac.to_media(docs(spark, ["x" * 9000]))).orderBy("sample_offset").collect()
    assert [(b.sample_offset, b.n_samples) for b in blocks] == [(0, 4096), (4096, 4096), (8192, 832)]
