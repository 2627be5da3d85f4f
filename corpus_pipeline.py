"""Five stages from raw documents to token ids, each a whole Spark job over what the one before kept.

Stages keep extra columns of any name (the last returns its own) and give an empty table for an empty one; texts of any
length are read whole. What each does with nulls, ties and repeated rows is said where it is defined, and in more
detail in the operators' modules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm import bpe, mixing, near_dup, quality, suffix_dedup
from bazaarlens.llm.common import table
from bazaarlens.plans.storage import materialize

#: Similarity of near duplicates in the corpus; the query of operator 8 keeps to its own, 85.
SIMILAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on rated ones of them, doesn't reject. A null text is judged like an empty
    one, a row with a null id like others, and repeated rows alike; without ratings of two grades all rows stay."""
    return quality.kept(docs, quality.train(docs, quality.grades(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of a similarity of SIMILAR hundredths or more: the one with the
    smallest id; of a group without ids, one row. Rows that repeat an id are one document, of which the row whose text
    is last in order stays. Texts without words (null, empty) stay, once for each id, and all of those with a null id."""
    return near_dup.kept_documents(docs, threshold=SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that occur elsewhere too. All copies of a string go, and rows that repeat
    an id are documents of their own; null texts stay null, empty ones empty."""
    return suffix_dedup.removed_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own; null and empty texts have no words and
    go with their neighbours in the order; equal rows are mixed each for itself, and ties are ordered by hashes."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``; a row for each row, null ids kept; null and empty texts
    have no ids."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: Fitted weights, hashes and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
