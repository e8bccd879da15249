"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Equal texts first meet within a task (the partial aggregate), then within one salt of their digest,
and the winners of the salts meet at last. Each of these groups by the digest and the whole text, so
that texts are compared in full at every stage; a key sends one row per task, then one per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import texts


def exact_groups(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays. Null texts count as empty, and all empty texts are equal.
    A null doc_id never wins over another; rows that repeat a doc_id and its text share its fate. An
    empty table gives an empty result; other columns are left out."""
    rows = texts(docs, id_col, text_col).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    salted = rows.groupBy("text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy("text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    # One row for each digest, or else two different texts share it, and the rows below would be wrong.
    groups = whole.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count("*").alias("contents"))
    groups = groups.select("text_sha256", "keep_id", F.when(F.col("contents") == 1, F.col("n")).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("long")).alias("group_size"))
    found = rows.select("doc_id", "text_sha256").join(groups, "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of docs, in all their columns, one for each text: that with the largest doc_id.

    Null and empty texts are equal. A row without doc_id stays only where no row with one has its text; of
    rows that repeat a doc_id and its text one stays; an empty table stays empty; columns of any name stay.
    The row travels with its text through the same stages as in exact_groups, so that no join follows."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("text").isNull().alias("none"), F.struct(*others).alias("row"))
    # Of equal ids the greater hash wins, so that a lost task gives the same row again.
    order = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(*others).alias("h"))
    keyed = docs.select(F.sha2(text, 256).alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), text.alias("said"), order.alias("order"), row.alias("kept"))
    salted = keyed.groupBy("sha", "salt", "said").agg(F.max(F.struct("order", "kept")).alias("best"))
    whole = salted.groupBy("sha", "said").agg(F.max("best").alias("best"))
    said = F.when(F.col("best.kept.none"), F.lit(None)).otherwise(F.col("said"))
    return whole.select(*(said.alias(c) if c == "text" else F.col("best.kept.row").getField(c).alias(c) for c in docs.columns))
