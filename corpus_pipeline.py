"""The training-data pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of documents, extra ones with any name included. In the last one a document that the mix takes several times has as many rows.

Defined cases, beside those of the operators:

* quality: null and empty texts go (under 20 words); labels that are null or name no document are unused; without bad labels there are no rules and the base
  limits decide; rows that share a doc_id are judged by their own texts.
* near_duplicates: one row of each component stays, that of the smallest doc_id, null ids last; of equal rows any one; rows that share a doc_id but are
  in different components all stay.
* decontamination: null texts and null item ids are fine; an empty benchmark keeps everything; rows that share a doc_id are judged by their own texts.
* mix: null is a source of its own; rows alike in id and text are taken together; documents without words may be taken, as they take no words.
* token_files: null and empty texts give the end id alone; rows that share a doc_id are ordered by their texts; null ids come first.
* An empty table, or one of which a stage keeps nothing, gives no rows, and the stages after it run all the same. Long texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from objekta.llm import decontaminate, mixing, quality, simhash, token_files
from objekta.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base limits or the learned rules reject."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints."""
    return simhash.deduplicate(docs, nameless=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the token files."""
    return token_files.encode_and_read_back(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix_sources),
    ("token_files", token_output),
]

#: A tokenizer's ids and learned rules are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
