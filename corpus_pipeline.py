"""documents -> packed training sequences: five stages, each a Parquet table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import language, mixing, neardup, packing, pii
from loomgrain.llm.common import table, written
from loomgrain.llm.entry import PII_KEY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified and not rejected; null, empty and letterless texts go.

    The model is fitted on the labelled rows of docs; without any, nothing can be identified and all go. Null ids, repeated
    rows and long texts are judged by their text like all others; an empty table gives an empty table.
    """
    return language.accepted(docs, language.fit_model(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; of rows equal in id and text, one.

    Rows with null ids or without words are in no group and stay; an empty table gives an empty table.
    """
    return neardup.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced by surrogates; n_chars follows the new text (null for a null text).

    Null ids, repeated rows and empty texts stay; equal texts get equal surrogates; an empty table gives an empty table.
    """
    safe = pii.with_surrogates(docs, PII_KEY)
    return safe.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, up to three times.

    A null source is a source, null ids are like others, equal rows share what is taken of them; an empty table gives an
    empty table.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences.

    A row repeated by the mix is packed as often; null ids stay null, a null or empty text is one piece with the end id
    alone; an empty table gives an empty table.
    """
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_copies),
    ("PII", replace_personal_data),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the models and sampling of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
