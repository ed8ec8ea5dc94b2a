"""A corpus-cleaning pipeline of five stages over `documents`: language, near copies, benchmark, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all documents that its predecessor kept; all but the last return the
columns of documents, in which only what a stage says it changes is changed. Other columns may have any name.

Defined results: a null text is empty: it has no letter, so the first stage drops it; a null doc_id is kept (of
near duplicates only documents with ids are compared and go); repeated rows go or stay alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, jaccard, langid, packing, pii
from palimpsest.llm.common import staged, table
from palimpsest.llm.queries import tokenizer_file

#: Ids (8 bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _beside(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one that no operator's column can clash with."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"))


def _back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, some of them changed."""
    same = {c: F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns}
    return rows.select(*[changed.get(c, same[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter go. A missing lang gets the prediction."""
    found = langid.identify(_beside(docs), langid.train(docs)).where("lang_pred <> 'und'")
    return _back(found, docs, lang=F.coalesce("others.lang", "lang_pred"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts, plain or disguised, is replaced by [KIND]."""
    found = pii.find(_beside(docs), redacted="redacted")
    changed = F.col("spans") != ""
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    return _back(found, docs, text=text, n_chars=F.when(changed, F.length("redacted")).otherwise(F.col("others.n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language), ("near_duplicates", near_copies), ("decontamination", benchmark), ("pii", personal_data), ("packing", packed)]

#: Language models and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
