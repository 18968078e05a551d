"""A corpus pipeline of five stages: language, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of docs. Nulls: a
document without text has no language and goes in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import curve_packing, language_id, pii_surrogates, simhash_dedup, suffix_dedup
from tidemark.llm.common import materialize, read

#: A text whose cosine with its language is below this is like none of the languages learned.
LEAST_SCORE = 0.05

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language."""
    learn = language_id.folded(docs)
    langs, prototypes = language_id.fit(learn.where("not held_out"))
    return language_id.filter_known(docs, langs, prototypes, LEAST_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the least doc_id. Texts without words are one class; texts that
    differ under one doc_id, or under none, are documents of their own."""
    return simhash_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the bytes of repeated passages; n_chars follows. A character that is cut in the middle goes whole."""
    return suffix_dedup.cut_repeats(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data. Null texts stay null, equal texts stay equal."""
    return pii_surrogates.replace(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text is its end token alone; an empty table gives no rows."""
    return curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
