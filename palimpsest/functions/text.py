"""Column expressions for text: normal forms, digests, ids, similarity. All but `char_jaccard` are built-in functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space as scripting languages strip it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Single characters replaced one after the other; much cheaper than `translate`, which looks each character up."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def normalize_name(c: Column) -> Column:
    """Lower case, single spaces, folded full-width punctuation; CJK, ASCII letters and digits and ` :(),.-_` stay."""
    folded = F.translate(strip(collapse(F.lower(c))), "：（）【】", ":()[]")
    return F.regexp_replace(folded, r"[^\x{4e00}-\x{9fff}a-zA-Z0-9 :(),.\-_]", "")


def normalize_content(c: Column, mode: str = "punct") -> Column:
    """`punct`: line ends and punctuation folded, outer white space cut; `ws`: white space collapsed."""
    if mode == "ws":
        return strip(collapse(c))
    lines = strip(replaced(c, (("\r\n", "\n"), ("\r", "\n"))))
    folded = F.when(lines.contains("\n\n\n"), F.regexp_replace(lines, r"\n{3,}", "\n\n")).otherwise(lines)
    return replaced(folded, (("：", ":"), ("，", ","), ("。", ".")))


def content_hash(c: Column, mode: str = "punct") -> Column:
    return F.md5(normalize_content(c, mode).cast("binary"))


def entry_id(kind: Column, name: Column, mode: str = "punct") -> Column:
    plain = normalize_name(name) if mode == "punct" else F.regexp_replace(strip(collapse(F.lower(name))), r"[^\p{L}\p{N}_]", "")
    return F.concat(kind, F.lit(":"), plain)


def structural_fingerprint(c: Column) -> Column:
    """One mark a line: `#`s for a heading, `-` for a list item, empty, or `text`."""
    def mark(line: Column) -> Column:
        return (
            F.when(line.rlike(rf"(?U)^#{{1,6}}{SPACE}"), F.regexp_extract(line, "^#+", 0))
            .when(line.rlike(rf"(?U)^{SPACE}*[-*+]{SPACE}"), "-")
            .when(strip(line) == "", "")
            .otherwise("text")
        )

    return F.array_join(F.transform(F.split(c, "\n", -1), mark), "\n")


def content_hashes(c: Column) -> Column:
    """struct(exact, structural, semantic); the semantic slot stays null."""
    return F.struct(content_hash(c).alias("exact"), F.md5(structural_fingerprint(c).cast("binary")).alias("structural"), F.lit(None).cast("string").alias("semantic"))


def sanitize(c: Column, limit: int = 10_000) -> Column:
    """Without control characters, blanks collapsed, cut at `limit` with `...`; null becomes empty."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    clean = strip(F.regexp_replace(clean, r"[ \t]+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("..."))).otherwise(clean)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often `use` names it, also within its lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(DoubleType())
def char_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """|A & B| / |A | B| of the sets of code points; 0 when both are empty, null for a null.

    Built-in functions would make a string of each character of each text; sets are some ten times faster.
    """
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = set(x), set(y)
        return len(p & q) / (len(p | q) or 1)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def words(c: Column) -> Column:
    """The different lower-cased words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(c), rf"(?U){SPACE}+"), lambda s: s != ""))


def set_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 when either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of lower-cased words; 0 when either is empty."""
    return set_jaccard(words(a), words(b))


def change_type(old: Column, new: Column, change: Column) -> Column:
    """replacement, expansion, reduction or update of two different texts; change: 1 - their `char_jaccard`."""
    return (
        F.when(change > 0.7, "replacement")
        .when(F.length(new) > 1.5 * F.length(old), "expansion")
        .when(F.length(new) < 0.7 * F.length(old), "reduction")
        .otherwise("update")
    )


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first differing element, the shorter length for a true prefix, null for equal arrays."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, at - 1)
