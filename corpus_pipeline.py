"""A training corpus from raw documents, stage by stage.

Each stage takes all that its predecessor kept and returns a DataFrame, which is
written and read again for the next one. All but the last return the columns of
documents.

Rows: nulls in any column, empty and very long texts, repeated rows and columns of
any further names are taken as they are: a null text counts as an empty one, and a
stage either keeps a row with all its columns or not (mixing: once, twice or not).
A row without an id is kept unless its text is toxic, a copy of one that has an id,
or the mix leaves it out. Of an empty table every stage makes an empty one.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from passageloom.llm.bpe import bpe_digest
from passageloom.llm.common import delete, materialise, temporary
from passageloom.llm.exact_dedup import keep_distinct
from passageloom.llm.mixing import mix
from passageloom.llm.near_dup import keep_representatives
from passageloom.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under their language's threshold."""
    return keep_clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8."""
    return keep_representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the bytes they decode to, as digests."""
    return bpe_digest(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixed),
    ("byte BPE", encoded),
]
#: SQL can't express the classifier, signatures or BPE; tests hold each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes. Of the tables on the way only the last stage's input
    stays, which the result is read from; every other goes as soon as it has been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with temporary(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir))
            kept = made.pop()
        delete(spark, *before)
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
