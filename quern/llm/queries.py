"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secrets import report, secret_spans

    return report(secret_spans(table(spark, sf_dir, "documents")))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.spans import without_repeats

    # Stretches of 25 words and more: shorter ones are phrases that clean documents share.
    return without_repeats(table(spark, sf_dir, "documents"), least=25)


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ctw import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))
