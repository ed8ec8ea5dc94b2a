"""Data quality: range rules and quarantine, text hygiene, duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: What an address looks like as a whole. Fixed value.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

#: Allowed ranges of request parameters and scores (lowest, highest; None: open). Fixed values.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "temperature": (0, 2), "top_p": (0, 1), "presence_penalty": (-2, 2), "frequency_penalty": (-2, 2), "n": (1, None), "max_tokens": (1, None),
    "intensity": (0, 1), "strength": (0, 1), "consistency": (0, 1), "stability": (0, 1), "arousal": (0, 1),
}


def violations(ranges: dict[str, tuple[float | None, float | None]], required: tuple[str, ...] = ()) -> Column:
    """Names of the rules that a row breaks, in the order given."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in required]
    for c, (lo, hi) in ranges.items():
        bad = F.lit(False)
        bad = bad | (F.col(c) < lo) if lo is not None else bad
        bad = bad | (F.col(c) > hi) if hi is not None else bad
        rules.append(F.when(bad, F.lit(f"{c}: out of range")))
    return F.array_compact(F.array(*rules))


def quarantine(rows: DataFrame, ranges: dict, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their violations)."""
    marked = rows.withColumn("violations", violations(ranges, required))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def hygiene(docs: DataFrame, text: str = "text", preview: int = 100, limit: int = 10_000) -> DataFrame:
    rows = docs.withColumn("clean", T.sanitize(F.col(text), limit))
    return rows.withColumn("preview", T.truncate(F.col("clean"), preview))


def hygiene_profile(docs: DataFrame, by: str = "source", text: str = "text", limit: int = 10_000) -> DataFrame:
    rows = hygiene(docs, text, limit=limit)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("clean").eqNullSafe(F.col(text))).alias("n_changed"), F.count_if(F.length("clean") > limit).alias("n_cut"))


def email_profile(docs: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Of the tokens that hold @, the share that is an address as a whole."""
    tokens = docs.select(by, F.explode(F.filter(F.split(text, r"\s+"), lambda w: w.contains("@"))).alias("w"))
    return tokens.groupBy(by).agg(F.count("*").alias("n_tokens"), F.avg(F.col("w").rlike(EMAIL).cast("int")).alias("share"))


def duplicate_groups(docs: DataFrame, digest: Column, key: str = "doc_id") -> DataFrame:
    return docs.groupBy(digest.alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))
