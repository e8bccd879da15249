"""Files of a source tree as a table (path, content), one row a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.extract import GENERIC
from quern.functions.text import excluded

#: Extensions by family (fixed values).
EXTENSIONS = {
    "ts": ("ts", "tsx", "js", "jsx"),
    "language": ("py", "rs", "go", *(e.lstrip(".") for e in GENERIC)),
    "doc": ("md", "mdx", "markdown", "rst", "adoc", "asciidoc"),
    "spec": ("json", "yaml", "yml", "prisma", "sql", "graphql", "gql", "graphqls"),
}
#: A3: paths of specifications: descriptions, models, statements and migrations, types (fixed values).
SPECS = r"(^|/)(openapi|swagger)[^/]*\.(json|ya?ml)$|(^|/)schema\.prisma$|\.sql$|(^|/)migrations/|\.(graphql|gql|graphqls)$"
#: Where traces of each kind lie below the root (fixed values).
TRACES = {"test-trace": r"(^|/)\.test-traces/[^/]*\.json$", "otel-trace": r"(^|/)\.otel-traces/[^/]*\.json$", "coverage-trace": r"(^|/)coverage/lcov\.info$"}


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, rules: list[tuple[str, ...]] = (), matching: str | None = None) -> DataFrame:
    """A1-A3: path below root and whole content of the files of these extensions, or whose path matches
    the pattern, without those that an exclusion rule skips. Paths are chosen before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    found = reader.load(root).select(F.substring(F.col("path"), at + len(base), F.length("path")).alias("path"), "content")
    if extensions:
        found = found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    if matching:
        found = found.where(F.col("path").rlike(matching))
    if rules:
        found = found.where(F.coalesce(excluded(F.col("path"), list(rules)), F.lit("")) != "skip")
    return found.select("path", F.decode("content", "UTF-8").alias("content"))


def traces(spark: SparkSession, root: str) -> DataFrame:
    """Edge facts of all traces below root."""
    from quern.sources.runtime import IMPORTERS

    out = None
    for kind, pattern in TRACES.items():
        part = IMPORTERS[kind](scan(spark, root, matching=pattern))
        out = part if out is None else out.unionByName(part)
    return out
