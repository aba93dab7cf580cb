"""A training-data pipeline: each stage works on all rows that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of ``documents`` as they are, extra ones of any name
included.

Defined cases, by stage:

- quality_rules: a null or empty text goes (it fails the base rule); repeated
  rows are judged each; without labels only the base rule decides.
- language_id: a null text, one without a letter, or one whose trigrams are
  unlikely in every learned language goes; where no row has a language to learn
  from, all stay.
- near_dedup: of a group the row of the smallest id stays, and of rows that
  repeat an id one; rows without an id, and texts without a word, all stay.
- packing: returns a row a piece; a null or empty text is its end token;
  repeated rows are packed once each.

Very long texts are read whole everywhere, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm import language_id, near_dedup, packing, quality_rules
from answerscope.llm._common import cut, in_fold, table

SEQUENCE_TOKENS = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the base rule or the learned decision list rejects."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, rules)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, in no learned language, or of which no learned language has 0.34 or more."""
    return language_id.keep_known(docs, language_id.fit(docs, ~in_fold(F.col("doc_id"), 4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers as vocabularies

    found = packing.pieces(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, SEQUENCE_TOKENS)
    return packing.pack(found, SEQUENCE_TOKENS)


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_duplicates), ("packing", pack)]

#: Learned and iterative stages have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps goes to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
