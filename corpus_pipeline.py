"""From raw documents to packed token sequences, in four stages.

Each stage takes what its predecessor kept, written as Parquet and read again, works on
all of it and decides alone; all but the last return the columns of documents as they came,
more columns and those with names that operators use too.

Null and empty texts go at the first stage, as they have fewer than ten words; given to a
later stage alone, language ID rejects them, the join keeps each, as they link with nothing,
and packing gives their end id. A null doc_id, lang or source is carried; a null doc_id is
the greatest of a group. Repeated rows are judged alike by the first two stages, and the
join keeps one of them; of equal keys any one stays. Very long texts are worked on whole.
An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barframe.llm import jaccard, langid, packing, quality
from barframe.llm.shared import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the fixed rules or the thresholds of its language and source reject."""
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or in which no language has half of the letters."""
    return langid.filter_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard.filter_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' token ids into sequences of powers of two."""
    return packing.digest(packing.pack(docs, packing.public_path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard_join), ("packing", pack)]

#: Viterbi labelling and byte-pair merging have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
