"""Ranked search over named columns: BM25 over four columns, phrases, substring fallback, re-ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import name_rank

#: BM25 parameters of the usual full-text index (fixed values).
K1, B = 1.2, 0.75
#: The columns of a node that are searched.
COLUMNS = ("name", "qualified_name", "signature", "doc")


def query_phrases(query: str) -> list[list[str]]:
    """The words of a query without its quotes, each as the phrase of its tokens, any of which may match."""
    found = []
    for word in query.replace('"', "").split():
        tokens = [t for t in re.split(r"[^a-z0-9]+", word.lower()) if t]
        if tokens and tokens not in found:
            found.append(tokens)
    return found


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query."""
    return sorted({t for p in query_phrases(query) for t in p})


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _occurrences(words: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))
    n = len(phrase)
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i + n - 1 <= F.size(words)) & (F.slice(words, i, n) == F.array(*map(F.lit, phrase))))
    return F.when(F.size(words) >= n, F.size(starts)).otherwise(0)


def ranked(rows: DataFrame, id_col: str, columns: tuple[str, ...], phrases: list[list[str]]) -> DataFrame:
    """(id, score) of the rows that hold a phrase in some column. Occurrences and lengths add up over
    the columns. Documents, mean length and holders of each phrase come from one aggregate over all rows."""
    lists = [tokens(F.col(c)) for c in columns]
    counted = rows.select(F.col(id_col).alias("id"), sum((F.size(x) for x in lists), F.lit(0)).alias("dl"), *(sum((_occurrences(x, p) for x in lists), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    held = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(phrases)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf, raw = F.col(f"tf{i}"), F.log((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return held.select("id", score.alias("score"))


def bm25(rows: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(id, score) by single terms in one column."""
    return ranked(rows, id_col, (text_col,), [[t] for t in terms])


def like_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Substring match on name, qualified name or path, case aside; % and _ stay wildcards."""
    pattern = f"%{query}%".replace("\\", "\\\\")
    hit = F.col("name").ilike(pattern) | F.col("node_id").ilike(pattern)
    for c in ("qualified_name", "file_path"):
        if c in nodes.columns:
            hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return nodes.where(hit).orderBy("node_id").limit(limit).select("node_id", "kind", "name")


def search(nodes: DataFrame, query: str, limit: int = 20, entries: DataFrame | None = None) -> DataFrame:
    """The top max(4 * limit, 20) by BM25 over the searched columns that nodes have, else by
    substring, re-ranked by how the name matches, files last, entries (node_id) first, then the first order.
    A query of quotes and spaces alone finds nothing. Nodes need node_id, kind and name."""
    phrases, most = query_phrases(query), max(4 * limit, 20)
    if not query.replace('"', "").split():
        return nodes.limit(0).select("node_id", "kind", "name", F.lit(0).alias("position"))
    columns = tuple(c for c in COLUMNS if c in nodes.columns)
    order = [F.desc(F.round("score", 6)), "id"]
    top = ranked(nodes, "node_id", columns, phrases).orderBy(*order).limit(most) if phrases else None
    if top is None or top.isEmpty():
        top = like_search(nodes, query, most).select(F.col("node_id").alias("id"), F.lit(0.0).alias("score"))
    top = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # at most that many rows
    found = top.withColumnRenamed("id", "node_id").join(nodes, "node_id")
    if entries is not None:
        found = found.join(entries.select("node_id").distinct().withColumn("entry", F.lit(0)), "node_id", "left")
    else:
        found = found.withColumn("entry", F.lit(1))
    qualified = F.col("qualified_name") if "qualified_name" in nodes.columns else F.col("node_id")
    placed = Window.orderBy(name_rank(F.col("name"), qualified, query), F.when(F.col("kind") == "file", 1).otherwise(0), F.coalesce("entry", F.lit(1)), "pos")
    return found.withColumn("position", F.row_number().over(placed)).where(F.col("position") <= limit).select("node_id", "kind", "name", "position")
