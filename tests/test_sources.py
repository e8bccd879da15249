"""Sources and extractors on small exact cases."""

import json

from quern.functions import extract
from quern.sources import files, runtime


def rows(df):
    return sorted(map(tuple, df.collect()))


def content(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def test_trace_gives_a_call_for_each_call(spark):
    tests = [{"testFile": "t.ts", "testName": n, "calls": [{"functionName": f, "file": "a.ts", "line": 1} for f in fs]} for n, fs in (("x", "ab"), ("y", "c"))]
    got = runtime.test_trace(content(spark, json.dumps(tests), None, "not json", "[]"))
    assert rows(got.select("source_id", "target_id", "verification")) == [("test:t.ts:x", "function:a.ts:a", 5), ("test:t.ts:x", "function:a.ts:b", 5), ("test:t.ts:y", "function:a.ts:c", 5)]


def test_otel_spans(spark):
    span = {"traceId": "0123456789", "spanId": "s", "parentSpanId": "p", "name": "n", "attributes": {"code.filepath": "f.ts"}, "endTime": "9"}
    bare = {"traceId": "0123456789", "spanId": "q", "name": "m"}
    tree = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}]}, "scopeSpans": [{"scope": {"name": "sc"}, "spans": [span, bare]}]}]}
    got = runtime.otel(content(spark, json.dumps(tree), None, "{}"))
    assert rows(got.select("source_id", "target_id", "kind")) == [("otel:web:n:01234567", "function:f.ts:n", "OBSERVED_CALL"), ("otel:web:n:01234567", "otel:web:parent:p", "REFERENCES")]


def test_lcov_keeps_lines_with_hits_of_ended_records(spark):
    text = "SF:main.ts\nFN:1,f\nDA:10,1\nDA:15,0\nDA:11,2\nend_of_record\nSF:auth.ts\nDA:5,3\nend_of_record\nSF:open.ts\nDA:1,1\n"
    got = runtime.lcov(content(spark, text, "", None))
    assert rows(got.select("target_id")) == [("line:auth.ts:5",), ("line:main.ts:10",), ("line:main.ts:11",)]


def test_files_and_traces(spark, tmp_path):
    (tmp_path / "coverage").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "coverage/lcov.info").write_text("SF:a\nDA:1,1\nend_of_record\n")
    (tmp_path / "a.ts").write_text("é")
    (tmp_path / "node_modules/b.ts").write_text("x")
    found = files.scan(spark, str(tmp_path), files.EXTENSIONS["ts"], [("**/node_modules/**", "skip")])
    assert rows(found) == [("a.ts", "é")]
    assert rows(files.traces(spark, str(tmp_path)).select("source_id", "target_id")) == [("file:a", "line:a:1")]


def test_schemas(spark):
    sources = [
        ("db/1.sql", "CREATE TABLE users (\n  id INT NOT NULL,\n  name VARCHAR(20),\n  PRIMARY KEY (id)\n);\n"),
        ("schema.prisma", "model User {\n  id Int @id\n  posts Post[]\n  @@index([id])\n}\n"),
        ("s.graphql", "type User {\n  id: ID!\n  # no\n  posts: [Post!]\n}\n"),
    ]
    got = extract.schema_facts(spark.createDataFrame(sources, "path string, content string"))
    assert rows(got.select("column_id", "type")) == [("db_column:User.id", "Int"), ("db_column:User.posts", "Post[]"), ("db_column:users.id", "INT"), ("db_column:users.name", "VARCHAR(20)"), ("property:User.id", "ID!"), ("property:User.posts", "[Post!]")]


def test_openapi_and_docs(spark):
    spec = json.dumps({"paths": {"/a": {"get": {}, "post": {}, "parameters": []}, "/b": {"delete": {}}}})
    got = extract.openapi_endpoints(spark.createDataFrame([("o.json", spec), ("p.json", "["), ("q.json", None)], "path string, content string"))
    assert rows(got.select("target_id")) == [("route:DELETE /b",), ("route:GET /a",), ("route:POST /a",)]
    doc = extract.doc_summary(spark.createDataFrame([("r.md", "# Title\n\nIntro  here.\n\n## One\n\ntext\n\n## Two\n")], "path string, content string"))
    assert rows(doc) == [("r.md", "Title — Intro here.", "Title · One · Two")]


def test_facts_of_empty_and_null_content(spark):
    got = extract.facts(spark.createDataFrame([("a.ts", ""), ("b.py", None), (None, "class A")], "path string, content string"), extract.LANGUAGES + extract.CONTRACTS)
    assert got.count() == 0


def test_files_are_dealt_out_and_read_once(spark):
    from quern.plans.registry import QUERIES

    one = spark.createDataFrame([("a.py", "class A:\n  pass\n")], "path string, content string").coalesce(1)
    assert extract.facts(one)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert "MapInArrow" not in QUERIES["resolved_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
