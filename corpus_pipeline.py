"""The corpus pipeline: stages of (name, function of (spark, docs, sf_dir)), each over all that the one before kept.

All stages but the last return the columns of documents; the last one adds piece_ids. Rows without an id are documents like others in
all stages, a null text is an empty one, rows are told apart by id and text, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import exact_dedup, mixing, pieces, quality_classifier, simhash
from chartloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; repeats and rows without an id are rated by their text. Without labels of two grades all stay."""
    return quality_classifier.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for the case of A-Z, the one with the largest id; one without an id only where none of its
    group has one. Null and empty texts are one group, and of rows equal in id and text one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near-equal fingerprints, the one with the smallest id; one without an id only where none of its
    group has one. Texts without words are one group."""
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those without words go, as nothing is taken of them. A null source is a source."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sampled segmentation of their whole text; rows equal in id and text get the same one, an empty text none."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the classifier, the trie join's components or sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
