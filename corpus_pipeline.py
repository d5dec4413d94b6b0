"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal and mixing to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept. The first four return the columns of `documents`; the last returns one row per
document that the mix took, as often as it took it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenlake.llm import line_templates, piece_codec, quality_rules, shingle_dedup, source_mix
from lumenlake.llm.common import load, stored

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to every quality rule."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; `n_chars` is counted anew."""
    return line_templates.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash of five-word shingles, or their Jaccard similarity of 0.8 or more."""
    return shingle_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix of sources takes them."""
    return source_mix.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of each document."""
    return piece_codec.digests(piece_codec.encode_decode(docs, public_tokenizers.path(PIECES)))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("source_mix", mix),
    ("encode", encode),
]

# Encoding cannot be stated in SQL; tests compare the whole run with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written as Parquet to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, [])
    return docs
