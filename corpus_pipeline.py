"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination, best-fit packing.

Null and empty texts fail the quality rules; a null doc_id is passed on.  Repeated rows are near copies of each other.
Columns that documents has besides the usual ones are passed on until the last stage.  Empty tables give empty results,
and without labels the quality rules keep what their base rule keeps.  Ties (equal texts) go to the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common as C
from quern.llm import decontamination, packing, quality_rules, simhash, suffix_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = C.table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.keep(docs, quality_rules.fit(docs, labels))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group (five-word shingles, similar at 0.8 or more)."""
    return simhash.keep(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty words or more that occur more than once."""
    return suffix_dedup.keep(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any thirteen words in a row of a benchmark item."""
    return decontamination.keep(docs, C.table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_dedup", keep_one_of_near_copies),
    ("suffix_dedup", remove_repeats),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_sequences),
]

#: SQL can't express trained trees, SimHash links or tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
