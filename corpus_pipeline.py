"""A corpus pipeline: each stage works on all that the one before it kept, written as Parquet.

Every stage takes null and empty texts, very long ones, repeated rows, null ids, empty tables and columns of
any name; what becomes of them is said at each stage. All but the last return the columns of docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm.dedup import exact_dedup
from quern.llm.jaccard import one_of_each
from quern.llm.mixing import mixed
from quern.llm.packing import packed
from quern.llm.quality import quality_filter
from quern.llm.shared import release, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored as a text of no
    bytes; repeated rows share their fate; without labels of both kinds all stay, or none if all labels are 0."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id; null and empty texts are equal."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the least doc_id; null and empty texts and
    rows without doc_id stay."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says; rows without doc_id stay once, and so do all without labels."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id alone."""
    return packed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mix), ("packing", pack)]

#: Training a network and a classifier can't be expressed in SQL; tests hold the deduplicating stages, the copies of
#: the mixing and the pieces of the packing against plain versions, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored in the shared folder for the next and dropped after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/quern-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            release(spark, before)
        docs = before = spark.read.parquet(f"{folder}/{name}")
    return docs
