"""References of files to symbols by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

#: Distinct targets of a file at most.
CAP = 60


def enrich(files: DataFrame, definitions: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, target, name): I3, I4, C5 and D8 of files (file, text) over definitions (id, name, file).

    A name counts if it has one definition; any number of files may refer to it, each but the definition's
    own. A file refers to the first cap of its targets in the order of the text. The join is by name with
    one row on the side of the definitions, so that a name that all files hold only makes its own rows."""
    defs = definitions.where(X.distinctive(F.col("name"))).groupBy("name").agg(F.min("id").alias("target"), F.min("file").alias("own"), F.count("*").alias("n")).where("n = 1").drop("n")
    names = files.select("file", F.posexplode(F.array_distinct(X.identifiers(X.strip_comments(F.col("text"))))).alias("at", "name"))
    found = names.where(X.distinctive(F.col("name"))).join(defs, "name").where(~F.col("file").eqNullSafe(F.col("own")))
    found = found.groupBy("file", "target", "name").agg(F.min("at").alias("at"))
    ranked = found.withColumn("rk", F.row_number().over(Window.partitionBy("file").orderBy("at", "target")))
    return ranked.where(F.col("rk") <= cap).select(F.col("file").alias("source"), "target", "name")
