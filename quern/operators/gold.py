"""Gold cases: which texts hold which fragments, and each case's missing and forbidden ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the runs that fragments and texts are joined on.
RUN = 4


def _run(words: Column, at: Column, width: Column | int) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, width), " "))


def _runs(width: int) -> Column:
    """All runs of so many words of the column w."""
    every = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: _run(F.col("w"), i, width))
    return F.when(F.size("w") >= width, every).otherwise(F.expr("cast(array() as array<bigint>)"))


def hits(texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """(fragment, hits): for each distinct fragment that any row of texts holds whole, how many do.

    texts has a column text, fragments a column fragment, of any number of rows. What stands between the
    first and the last space of a fragment are whole words of a text that holds it, so the longest run of
    RUN of them is looked up by hash; each pair found is then compared in full. Fragments of less than
    three words are compared with every text. Nulls hold nothing and are held by nothing."""
    texts, fragments = texts.where("text is not null").select("text"), fragments.where("fragment is not null").select("fragment").distinct()
    words = F.split("fragment", " ")
    split = fragments.withColumn("w", words).withColumn("width", F.least(F.lit(RUN), F.size("w") - 2))
    runs = split.where("width > 0").withColumn("at", F.explode(F.sequence(F.lit(2), F.size("w") - F.col("width"))))
    runs = runs.select("fragment", "width", _run(F.col("w"), F.col("at"), F.col("width")).alias("h"), F.length(F.array_join(F.slice("w", F.col("at"), F.col("width")), " ")).alias("n"))
    anchors = runs.groupBy("fragment").agg(F.max(F.struct("n", "h", "width")).alias("a")).select("fragment", "a.h", "a.width")
    widths = sorted(r[0] for r in anchors.select("width").distinct().collect())  # RUN of them at most
    short = texts.join(F.broadcast(split.where("width < 1").select("fragment")), F.contains("text", "fragment")).select("fragment")
    found = short
    if widths:
        keyed = texts.withColumn("k", F.xxhash64("text"))
        each = F.flatten(F.array(*map(_runs, widths)))
        there = keyed.withColumn("w", F.split("text", " ")).select("k", F.explode(F.array_distinct(each)).alias("h"))
        pairs = there.join(anchors.select("fragment", "h"), "h").select("k", "fragment").distinct()
        found = short.unionByName(keyed.join(pairs, "k").where(F.contains("text", "fragment")).select("fragment"))
    return found.groupBy("fragment").agg(F.count("*").alias("hits"))


def verdicts(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Of each case (case_id, expected, forbidden: arrays of fragments, null as empty): case_id, missing
    (expected fragments that nothing holds), forbidden (those that something holds), passed and the
    pass_rate of all cases. found is what hits() gives for the fragments of the cases."""
    whole = lambda c: F.coalesce(F.array_distinct(c), F.expr("cast(array() as array<string>)"))
    want = F.transform(whole(F.col("expected")), lambda f: F.struct(f.alias("fragment"), F.lit(True).alias("needed")))
    never = F.transform(whole(F.col("forbidden")), lambda f: F.struct(f.alias("fragment"), F.lit(False).alias("needed")))
    each = cases.select("case_id", F.explode_outer(F.concat(want, never)).alias("f")).select("case_id", "f.*")
    told = each.join(found, "fragment", "left").withColumn("held", F.col("hits").isNotNull())
    gather = lambda needed: F.sort_array(F.collect_list(F.when((F.col("needed") == needed) & (F.col("held") != needed), F.col("fragment"))))
    out = told.groupBy("case_id").agg(gather(True).alias("missing"), gather(False).alias("forbidden")).withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0))
    return out.crossJoin(F.broadcast(out.agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))))  # one row
