"""A corpus pipeline of five operators: language, near copies, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents.  All stages but the last return the
columns of documents, extra ones and their names included.

Edge cases, for every stage: an empty table gives no rows; very long texts are read whole;
rows without id and repeated ids stay rows of their own unless a stage says otherwise; no
column but those named is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumstat.llm import decontaminate, langid, mixing, secrets, simhash
from quorumstat.llm.common import read, stored

#: Near copies: five-word shingles and a Jaccard index of 0.8 or more; fingerprints within 44 of 256 bits are looked at first.
SHINGLE, RADIUS = 5, 44


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters (null and blank texts among them), unlike every language of
    the corpus, or surely not in the one declared.  Null languages and sources give no evidence."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate group: one row where ids repeat; rows without id all
    stay; wordless texts are one group."""
    return simhash.deduplicate(docs, SHINGLE, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item; null texts hold
    nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text; n_chars follows, and is null for a null text."""
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each taking of a document into the mixture of sources; a null source is a source of its own, a null
    text has no tokens and costs nothing."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]
#: Fingerprints, fixpoints and a trained language model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each handed on as a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
