"""Personal data in plain and disguised form, with spans of the original text.

Base detectors read the text as it is. A text with signs of a disguise is rewritten by transducers, each of which reads
it once from left to right and keeps for every character it writes the source span it comes from: homoglyphs and
zero-width characters; `(at)` and `dot` in words; spelled digits; and the last two after one another. The same
detectors then read what was written, and what they find is mapped back to code points of the source. Spans found only
that way are added; base spans stay.

Bare `at` counts only where the domain has a disguised `dot` as well, and spelled digits only in runs, so that prose
with these words is left alone. All work is linear in a text's length. Signs are looked for in whole batches first, with
patterns that only pass too much.

Defined results: null text is empty and has no spans; repeated rows are treated alike; very long texts are read
whole; an empty table gives an empty result; input columns named as the added ones are replaced, other names are free.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import fresh, in_arrow, slabs

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is tried from its start only: a later start in the same run fails in the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TWICE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(_TWICE[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """`LOCAL@DOMAIN(.DOMAIN)+`, leftmost and without overlap; local parts are read backwards from each @."""
    out: list[tuple[int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> list[Span]:
    """Base spans (kind, start, end) by kind, then start."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Cyrillic and Greek letters that look like Latin ones (fixed values).
_LOOKALIKE = dict(zip("аеіјорсухѕһԁԛԝАВЕІЈКМНОРСТУХЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "aeijopcyxshdqwABEIJKMHOPCTYXSABEZHIKMNOPTYXoiv"))
_ZERO_WIDTH = "​‌‍⁠﻿­"
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _plain_char(c: str) -> str | None:
    """The ASCII character that c stands for, '' for a zero-width one, None if c is none of these."""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c in _ZERO_WIDTH:
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x24EA or c in "。｡﹒․﹫ ‐‑‒–−":
        n = unicodedata.normalize("NFKC", c)
        n = {"。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}.get(c, n)
        return n if len(n) == 1 and n.isascii() else None
    return None


class _Plain(dict):
    """For str.translate: what _plain_char says, asked once a character."""

    def __missing__(self, code: int) -> str | int:
        plain = None if code < 128 else _plain_char(chr(code))
        self[code] = code if plain is None else plain
        return self[code]


_PLAIN = _Plain()
_OTHER_DIGITS = "".join(c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd")
# What _plain_char maps, and a few more.
SUSPECT_SIGN = f"[{''.join(_LOOKALIKE)}{_ZERO_WIDTH}{_OTHER_DIGITS}！-～\U0001d400-\U0001d7ff①-⓪。｡﹒․﹫\xa0‐-–−]"
_SUSPECT = re.compile(SUSPECT_SIGN)

# A joint is what stands between two words of an address. Blanks are tried from the first one only.
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_ATS, _DOTS = r"at|arroba|@", r"dot|punto|punkt|point|\."
_JOINT = re.compile(
    rf"(?P<at>(?<!\s)\s*+{_OPEN}\s*+(?:{_ATS})\s*+{_CLOSE}\s*+|(?<!\s)\s++(?:{_ATS})\s++|@)|(?P<dot>(?<!\s)\s*+{_OPEN}\s*+(?:{_DOTS})\s*+{_CLOSE}\s*+|(?<!\s)\s++dot\s++|\.)", re.IGNORECASE)
_LOCAL_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_DOMAIN_WORD = re.compile(r"[A-Za-z0-9-]++")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\+|[^A-Za-z0-9+]+")
_NARROW, _BEFORE_DOT, _AFTER_DOT, _AFTER_PLUS = re.compile(r"[\s.()-]{1,3}"), re.compile(r"[\s.,-]+"), re.compile(r"[\s,-]+"), re.compile(r"[\s-]+")
_OPENED, _CLOSED = re.compile(rf"\s*+{_OPEN}\s*+"), re.compile(rf"\s*+{_CLOSE}\s*+")
_BRACKETED_DOT = re.compile(rf"\s*+{_OPEN}\s*+\.\s*+{_CLOSE}\s*+")
_DOT_WORDS = ("dot", "point", "punto", "punkt")
_WORD, _VALUE = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
#: Spelled or written numbers that make a run.
RUN = 4

# Signs of a disguise, for RE2: each is a part of every text that a transducer changes.
_B = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_W = f"(?:{'|'.join(_DIGIT_WORDS)})"
_GAP = rf"(?:[\s\x0b\x1c-\x1f\x85\p{{Z}}.,-]*(?:dot|point)[\s\x0b\x1c-\x1f\x85\p{{Z}},-]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}.()-]{{1,3}})"
AT_DOT_SIGN = rf"{_OPEN}{_B}*(?:{_ATS}|{_DOTS}){_B}*{_CLOSE}|{_B}(?:dot|@){_B}"
DIGIT_SIGN = rf"{_W}{_GAP}(?:{_W}|[0-9])|[0-9]{_GAP}{_W}|[0-9][\s\x0b\x1c-\x1f\x85\p{{Z}}.,-]*(?:dot|point)[\s\x0b\x1c-\x1f\x85\p{{Z}},-]+[0-9]|plus(?:{_B}|-)+(?:{_W}|[0-9])|(?:{_W}|[0-9]){_B}*{_OPEN}{_B}*(?:{_DOTS}){_B}*{_CLOSE}{_B}*(?:{_W}|[0-9])"
# And of base spans.
BASE_SIGN = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9]"


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start, self.end = start, end  # None: as in the source

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replaces [a, b) by a string for each edit, in order; all of the string comes from the source of [a, b)."""
        if not edits:
            return self
        a, b = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
        cut = np.append(0, b)  # where kept ranges begin
        size = np.zeros(2 * len(edits) + 1, np.int64)
        size[::2], size[1::2] = np.append(a, len(self.text)) - cut, [len(e[2]) for e in edits]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        first, last, step = np.zeros_like(size), np.zeros_like(size), np.zeros_like(size)
        first[::2], last[::2], step[::2] = cut, cut, 1
        first[1::2], last[1::2] = a, b - 1
        at *= np.repeat(step, size)
        start, end = np.repeat(first, size) + at, np.repeat(last, size) + at
        parts = [x for (p, q, new), c in zip(edits, cut.tolist()) for x in (self.text[c:p], new)]
        text = "".join([*parts, self.text[edits[-1][1] :]])
        return Mapped(text, start if self.start is None else self.start[start], end + 1 if self.end is None else self.end[end])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


def _homoglyphs(text: str) -> Mapped:
    plain = text.translate(_PLAIN)
    if len(plain) == len(text):
        return Mapped(plain)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.flatnonzero(~np.isin(codes, [ord(c) for c in _ZERO_WIDTH]))
    return Mapped(plain, start, start + 1)


def _at_dot(m: Mapped) -> Mapped:
    """Addresses around each joint that means @: to the left and right as far as words and dots go. No walk crosses
    another @, so all walks together read the text twice at most."""
    text, edits, done = m.text, [], 0
    joints = [(x.start(), x.end(), x.lastgroup) for x in _JOINT.finditer(text)]
    if all(b - a == 1 for a, b, _ in joints):
        return m  # nothing but plain signs
    for q, (at, after, kind) in enumerate(joints):
        if kind != "at":
            continue
        left, lo, begin = [], q - 1, at
        while True:
            while begin > done and text[begin - 1] in _LOCAL_WORD:
                begin -= 1
            if begin == (left[-1][0] if left else at):
                begin = left.pop()[1] if left else at  # a dot with no word before it is none of the address
                break
            if lo < 0 or joints[lo][2] != "dot" or joints[lo][1] != begin or joints[lo][0] < done:
                break
            left.append(joints[lo])
            begin, lo = joints[lo][0], lo - 1
        if begin == at:
            continue
        right, hi, word = [], q + 1, _DOMAIN_WORD.match(text, after)
        end = word.end() if word else after
        while word and hi < len(joints) and joints[hi][2] == "dot" and joints[hi][0] == end and (more := _DOMAIN_WORD.match(text, joints[hi][1])):
            right.append(joints[hi])
            end, hi = more.end(), hi + 1
        if not right:
            continue
        disguised_dot = any(text[a:b] != "." for a, b, _ in right)
        sign = text[at:after]
        if sign == "@" and not disguised_dot and all(text[a:b] == "." for a, b, _ in left):
            continue  # plain
        if sign[0].isspace() and sign.strip().lower() in ("at", "arroba") and not disguised_dot:
            continue
        edits += [(a, b, "." if k == "dot" else "@") for a, b, k in [*reversed(left), joints[q], *right] if b - a > 1]
        done = end
    return m.rewrite(edits)


def _digits(m: Mapped) -> Mapped:
    """Runs of spelled or written numbers; between them white space, hyphens and the like mean nothing."""
    tokens = [(x.start(), x.end(), x[0].lower()) for x in _TOKEN.finditer(m.text)]
    n, edits = len(tokens), []
    word = lambda i: tokens[i][2] if i < n else ""
    value = lambda i: i < n and (tokens[i][2] in _DIGIT_WORDS or tokens[i][2].isdecimal())
    i = 0
    while i < n:
        if not value(i) or i and _alnum(word(i - 1)):
            i += 1
            continue
        ends, bracketed = [i], False  # places of the run's values
        while True:
            j = ends[-1] + 1
            if _BRACKETED_DOT.fullmatch(word(j)) and value(j + 1):
                ends.append(j + 1)
                bracketed = True
                continue
            if _NARROW.fullmatch(word(j)) and value(j + 1):
                ends.append(j + 1)
                continue
            if _OPENED.fullmatch(word(j)) and word(j + 1) in _DOT_WORDS and _CLOSED.fullmatch(word(j + 2)) and value(j + 3):
                ends.append(j + 3)
                continue
            j += bool(_BEFORE_DOT.fullmatch(word(j)))
            if word(j) in ("dot", "point") and _AFTER_DOT.fullmatch(word(j + 1)) and value(j + 2):
                ends.append(j + 2)
                continue
            break
        following = ends[-1] + 1
        while ends and _alnum(word(ends[-1] + 1)):
            ends.pop()
        if len(ends) >= RUN:
            first = i
            if i >= 2 and word(i - 2) == "plus" and _AFTER_PLUS.fullmatch(word(i - 1)):
                first = i - 2
            elif i >= 1 and word(i - 1) == "+":
                first = i - 1
            elif i >= 2 and word(i - 2) == "+" and word(i - 1).isspace():
                first = i - 2
            run = tokens[first : ends[-1] + 1]
            if bracketed or any(w.isalpha() for _, _, w in run):
                for a, b, w in run:
                    new = _DIGIT_WORDS.get(w) or ("+" if w == "plus" else "." if w in _DOT_WORDS else None)
                    if new is None and not w.isdecimal() and w != "+":
                        new = "." if w == "." or _BRACKETED_DOT.fullmatch(w) else ""
                    if new is not None:
                        edits.append((a, b, new))
        i = following
    return m.rewrite(edits)


def _alnum(w: str) -> bool:
    return bool(_WORD.fullmatch(w) or _VALUE.fullmatch(w))


def disguised(text: str, base: list[Span], suspect: bool = True, at_dot: bool = True, spelled: bool = True) -> list[Span]:
    """Spans of the source that only the rewritten text shows; flags: the signs that were seen."""
    m = Mapped(text)
    forms = []
    suspect = suspect and not text.isascii() and _SUSPECT.search(text) is not None
    if suspect:
        m = _homoglyphs(text)
        forms.append(m)
    one = _at_dot(m) if at_dot or suspect else m
    two = _digits(m) if spelled or suspect else m
    forms += [x for x in (one, two) if x is not m]
    if two is not m and (at_dot or suspect):
        forms.append(_at_dot(two))
    found = set()
    for form in forms:
        for kind, a, b in detect(form.text):
            s, e = form.source(a, b)
            if text[s:e] != form.text[a:b]:
                found.add((kind, s, e))
    out: list[Span] = []
    reach: dict[str, int] = {}
    own = set(base)
    for kind, s, e in sorted(own | found, key=lambda x: (x[1], -x[2])):  # what lies in a span of its kind is not told again
        if (kind, s, e) not in own and e > reach.get(kind, 0):
            out.append((kind, s, e))
        reach[kind] = max(e, reach.get(kind, 0))
    return out


def signs(texts: pa.Array) -> list[tuple[bool, bool, bool, bool]]:
    """Of each text whether it may hold base spans, characters that stand for others, disguised addresses, spelled
    numbers; false only where it holds none."""
    any_of = lambda p, fold=True: pc.match_substring_regex(texts, p, ignore_case=fold).to_pylist()
    return list(zip(any_of(BASE_SIGN, False), any_of(SUSPECT_SIGN, False), any_of(AT_DOT_SIGN), any_of(DIGIT_SIGN)))


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes [EMAIL], [IP], [CARD] or [PHONE] by its first span."""
    out, done = [], 0
    runs: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(e, runs[-1][2])
        else:
            runs.append([k, s, e])
    for k, s, e in runs:
        out += [text[done:s], f"[{k.upper()}]"]
        done = e
    return "".join([*out, text[done:]])


def find(docs: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added; on request also the
    redacted text, which replaces a column of that name."""
    counts = [f"n_{k}" for k in KINDS]
    added = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    if redacted:
        added.append(T.StructField(redacted, T.StringType()))
    names = {a.name.lower() for a in added}
    keep = [f for f in docs.schema.fields if f.name.lower() not in names]
    (body,) = fresh([f.name for f in keep], "_t")
    schema = T.StructType([*keep, *added])
    nothing = [0] * 4 + [hashlib.sha256(b"").hexdigest(), "", 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, body):
            texts = pc.fill_null(b.column(body), "")
            cols: list[list] = [[] for _ in added]
            for v, (plain, other, at_dot, spelled) in zip(texts, signs(texts)):
                if not (plain or other or at_dot or spelled):
                    row = nothing + [v.as_py()] * bool(redacted)
                else:
                    t = v.as_py()
                    base = detect(t) if plain else []
                    more = disguised(t, base, other, at_dot, spelled) if other or at_dot or spelled else []
                    row = [sum(k == x for x, _, _ in base) for k in KINDS] + [hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)]
                    if redacted:
                        row.append(redact(t, base + more))
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    return in_arrow(docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").cast("string").alias(body)), run, schema)
