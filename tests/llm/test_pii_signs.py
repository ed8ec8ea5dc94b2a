"""The quick look for signs of a disguise passes every text that the transducers change."""

import random
import time
import unicodedata

import pyarrow as pa
import pytest

from palimpsest.llm import pii


@pytest.mark.parametrize("kind,text", [
    *[("email", t) for t in ("alice[@]example[.]com", "bob(@)mail.org", "eve@host(.)com", "x@host[punto]com", "x@host[point]com", "x{ at }y.com", "x( arroba )y.com", "ann @ host.org")],
    *[("phone", t) for t in ("+1 415 five five five 1234", "plus 1 415 555 1234", "+߁ ߄߁߅ ߅߅߅ ߁߂߃߄")], *[("ip", t) for t in ("192 dot 168 dot 1 dot 1", "192[.]168[.]1[.]1", "192(dot)168(dot)1(dot)1", "192(.)168 [ . ] 1 {punto} 1", "one[.]0[.]0<.>1")], ("card", "oh one 0000 0000 0000 0009"),
])
def test_disguise_is_read(kind, text):
    assert (kind, 0, len(text)) in pii.disguised(text, pii.detect(text))


def test_signs_lose_nothing():
    r = random.Random(5)
    signs = ["@", ".", "at", "AT", "arroba", "dot", "punto", "punKt", "point", "plus", "+", "zero", "oh", "Nine", "five", "1", "415", "192", "example", "bob", "com", "bone"]
    between = ["", "", " ", "  ", "\n", "-", ".", ", ", "(", ")", "[", "]", "{ ", " }", "<", ">", "\xa0", "٣", "і", "​"]
    texts = ["".join(r.choice(signs) + r.choice(between[: r.choice((10, 20))]) for _ in range(r.randint(1, 14))) for _ in range(40000)]
    quick = []
    for t, (plain, *flags) in zip(texts, pii.signs(pa.array(texts))):
        base = pii.detect(t)
        assert plain or not base
        quick.append(pii.disguised(t, base, *flags))
    assert quick == [pii.disguised(t, pii.detect(t)) for t in texts]
    assert sum(map(bool, quick)) > 100


@pytest.mark.parametrize("unit", ["x dot ", "one dot ", "a at b ", "a@", "1 ", "1.", "+1 (", "five\n", "(at)", " " * 7, "і", "​", "a.b@c.d ", "one two ", "(  ", "x at y dot ", "1[.]", "1 (dot) ", "1[", "1(dot"])
def test_time_is_linear(unit):
    text = unit * ((1 << 20) // len(unit))
    began = time.process_time()
    pii.disguised(text, pii.detect(text))
    assert time.process_time() - began < 5


def test_transducers_compose():
    text = "write to joe (at) one nine two dot one six eight dot five dot six please"
    assert ("email", "joe (at) one nine two dot one six eight dot five dot six") in [(k, text[s:e]) for k, s, e in pii.disguised(text, [])]


def test_every_mapped_character_is_suspect():
    assert all(pii._SUSPECT.fullmatch(c) for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) != "Cn" and pii._plain_char(c) is not None)
