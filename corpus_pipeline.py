"""From raw documents to token ids: five stages, each over all that the one before kept.

Defined cases, in every stage: a null text counts as empty, and such rows, like those of fewer than 20 words, go in the first
stage; rows without an id are told apart by their texts only; repeated rows and equal texts leave one row; very long texts are
taken whole; other columns stay, under any name and with any value, until the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from copycensus.llm.common import table
from copycensus.session import materialize


#: Bytes of a string that counts as a repeated passage; 50 words have 243 or more in 95 of 100 documents.
REPEAT_BYTES = suffix_dedup.PASSAGE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    # A filter stays above a generated column; pushed below, it would evaluate the statistics once per use.
    verdicts = quality.judged(docs).select("row", F.explode(F.array("kept")).alias("kept"))
    return verdicts.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEAT_BYTES`` that occur elsewhere too, the first place included; every document stays, if with an empty text."""
    cut = suffix_dedup.without_repeats(docs, length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the bytes that they decode to."""
    return bpe.digest_documents(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL has no suffix sorting within reach, SimHash or byte-pair merges; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
