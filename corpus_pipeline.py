"""From raw documents to packed token sequences: five stages, each on what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and further
ones that docs has, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.llm import decontam, langid, neardup, packing, pii
from tracegauge.llm.common import materialize, table

#: Least posterior of the best language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with it as their lang; texts without a letter or of no clear language go, null and
    empty ones with them. A null lang isn't learned from; repeated rows are judged alike."""
    said = langid.identify(docs, langid.fit(docs))
    kept = said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id: those that op2 links (two-word shingles, a similarity
    of 0.8), as one changed word costs five five-word shingles, and short copies with two or three changes stayed. Of rows that repeat a doc_id one stays; rows without a doc_id, and texts without words, stay."""
    return neardup.without_near_duplicates(docs, size=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; rows that repeat doc_id and text go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked. A null text stays null."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null or empty text is one piece, the end; rows that repeat a doc_id are
    documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]
#: No stage but the joins can be said in SQL (a model, sketches, a tokenizer); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
