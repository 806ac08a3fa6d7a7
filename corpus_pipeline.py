"""From raw documents to packed training sequences.

Each stage works on all that the one before kept, and its decisions take effect: language identification drops what it
rejects, the n-gram Jaccard join keeps one document of each group, decontamination drops documents that hold a benchmark
item, the secret scan replaces secrets in the text, packing returns pieces of sequences. Rows without an id pass every
stage by their text alone; repeated ids become one document at the join; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, jaccard, langid, packing, secrets
from lexmill.llm.common import discard, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or hold hardly a letter and texts that fit no language; fills in a missing lang."""
    return langid.accepted(docs, langid.fit_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of five-word shingle sets with a similarity of 0.8 or more."""
    return jaccard.keep_first(docs, jaccard.near_components(docs, 5, 80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget; null and empty texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; other documents stay as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of all documents that are left; a null text is its end token alone."""
    return packing.op6_packing(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokeniser; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
