"""Runtime evidence as edge facts: test traces, OpenTelemetry spans and lcov coverage.

Each importer takes a table with the whole file in one string column, so that a caller may read from
files (sources.files) or from any other table. Malformed or null content gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNTIME = 5
TRACE = "array<struct<testFile:string, testName:string, calls:array<struct<functionName:string, file:string, line:int>>>>"
SPAN = "struct<traceId:string, spanId:string, parentSpanId:string, name:string, attributes:map<string,string>, endTime:string>"
OTEL = f"struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string, value:struct<stringValue:string>>>>, scopeSpans:array<struct<scope:struct<name:string>, spans:array<{SPAN}>>>>>>"
FACT = ("source_id", "target_id", "kind", "verification", "source_method", "metadata")


def fact(df: DataFrame, source: Column, target: Column, kind: str, method: str, **metadata: Column) -> DataFrame:
    """Edge facts in one schema; metadata as a map of strings."""
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    values = (source, target, F.lit(kind), F.lit(RUNTIME), F.lit(method), F.create_map(*pairs))
    return df.select(*(v.alias(n) for n, v in zip(FACT, values, strict=True)))


def test_trace(files: DataFrame, content: str = "content") -> DataFrame:
    """An OBSERVED_CALL from each test to each function that it called."""
    tests = files.select(F.explode(F.from_json(content, TRACE)).alias("t")).select("t.*")
    calls = tests.select("testFile", "testName", F.explode("calls").alias("c"))
    test = F.concat(F.lit("test:"), "testFile", F.lit(":"), "testName")
    called = F.concat(F.lit("function:"), "c.file", F.lit(":"), "c.functionName")
    return fact(calls, test, called, "OBSERVED_CALL", "test-trace", testFile=F.col("testFile"), testName=F.col("testName"), line=F.col("c.line"))


def otel(files: DataFrame, content: str = "content") -> DataFrame:
    """REFERENCES from a span to its parent, and OBSERVED_CALL where the span names its code."""
    services = files.select(F.explode(F.from_json(content, OTEL)["resourceSpans"]).alias("r"))
    named = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    services = services.select(F.coalesce(F.get(named, F.lit(0))["value"]["stringValue"], F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("s"))
    spans = services.select("service", F.coalesce("s.scope.name", F.lit("unknown")).alias("scope"), F.explode("s.spans").alias("p")).select("service", "scope", "p.*")
    own = F.concat(F.lit("otel:"), "service", F.lit(":"), "name", F.lit(":"), F.substring("traceId", 1, 8))
    ids = {"traceId": F.col("traceId"), "spanId": F.col("spanId"), "service": F.col("service")}
    parent = F.concat(F.lit("otel:"), "service", F.lit(":parent:"), "parentSpanId")
    up = fact(spans.where("parentSpanId <> ''"), own, parent, "REFERENCES", "otel-trace", **ids, parentSpanId=F.col("parentSpanId"), duration=F.col("endTime"), scope=F.col("scope"))
    code = F.coalesce(F.get_json_object(F.to_json("attributes"), "$['code.filepath']"), F.get_json_object(F.to_json("attributes"), "$['code.function']"))
    placed = spans.withColumn("code", code).where("code <> ''")
    return up.unionByName(fact(placed, own, F.concat(F.lit("function:"), "code", F.lit(":"), "name"), "OBSERVED_CALL", "otel-trace", **ids, codeFile=F.col("code")))


def lcov(files: DataFrame, content: str = "content") -> DataFrame:
    """COVERS_LINE for each line with hits. A record without its end_of_record does not count."""
    pieces = F.split(content, r"(?m)^[ \t]*end_of_record[^\n]*$")
    records = files.select(F.explode(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("record"))
    files_ = F.regexp_extract_all("record", F.lit(r"(?m)^[ \t]*SF:(.*?)[ \t\r]*$"), F.lit(1))
    # A second SF line begins the record anew.
    body = F.regexp_replace("record", r"(?s)^.*\n?[ \t]*SF:[^\n]*", "")
    hits = lambda k: F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*DA:(\d+),(\d+)"), F.lit(k))
    lines = records.select(F.get(files_, F.size(files_) - 1).alias("file"), F.explode(F.arrays_zip(hits(1).alias("line"), hits(2).alias("hits"))).alias("d")).select("file", "d.*")
    lines = lines.where((F.col("file").isNotNull()) & (F.col("hits").cast("long") > 0))
    return fact(lines, F.concat(F.lit("file:"), "file"), F.concat(F.lit("line:"), "file", F.lit(":"), "line"), "COVERS_LINE", "coverage-trace", line=F.col("line"), hits=F.col("hits"))


IMPORTERS = {"test-trace": test_trace, "otel-trace": otel, "coverage-trace": lcov}


def nodes(facts: DataFrame) -> DataFrame:
    """The nodes that edge facts name, one a target or source: its kind from its name, a line's place with it."""
    ends = facts.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    head, rest = F.substring_index("node_id", ":", 1), F.regexp_replace("node_id", r"^[^:]*:", "")
    kind = F.when(head == "otel", "span").otherwise(head)
    path = F.when(head.isin("test", "function", "line"), F.regexp_replace(rest, r":[^:]*$", "")).when(head == "file", rest).otherwise("")
    line = F.when(head == "line", F.substring_index("node_id", ":", -1).cast("int")).otherwise(F.lit(0))
    name = F.when(head == "file", rest).when(head == "otel", rest).otherwise(F.substring_index("node_id", ":", -1))
    none = F.lit(None).cast("string")
    sha = lambda c: F.sha2(c, 256)
    return ends.select("node_id", sha(F.concat(F.lit("repo::ts::"), "node_id")).alias("stable_id"), sha(name).alias("version_hash"), none.alias("previous_stable_id"), kind.alias("kind"), name.alias("name"), F.col("node_id").alias("qualified_name"), path.alias("file_path"), line.alias("start_line"), line.alias("end_line"), none.alias("signature"), none.alias("doc"), F.lit("ts").alias("language"), F.lit(0).cast("long").alias("seq"))
