"""Queries over source trees, state tables and documents that are made from the given tables, and their SQL.

Every file's text is composed from a row, so that the SQL can say from the same row what must be found in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import extract
from quern.functions import text as X
from quern.operators import containers, document, facts, graph, resolve, state
from quern.plans.registry import query
from quern.plans.storage import cut


def said(pattern: str, **columns: str) -> Column:
    """A text with {name} replaced by columns."""
    parts, rest = [], pattern
    while rest:
        hits = [(rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, n = min(hits)
        parts += [F.lit(rest[:at]), F.col(columns[n]).cast("string")]
        rest = rest[at + len(n) + 2 :]
    return F.concat(*parts)


PY = "import os\nfrom lib.m{z} import s{k}\n\n\nclass Part{k}(Base):\n    \"\"\"Part {k} of size {z}.\"\"\"\n\n    def price(self):\n        return 'def no(self)'  # class No\n\n\ndef make_{k}(x):\n    return Part{k}(x)\n"
WEB = (
    "import { nation{n} as there } from './n{n}';\nimport axios from 'axios';\nimport { gone } from './gone{k}';\n/** Supplier {k}. */\nexport function supplier{k}(a: number) {\n  there(a);\n  local{k}();\n  lost{k}.go();\n}\n"
    "function local{k}() {}\nexport class S{k} extends T{k} implements I{k} {\n  run(): void { supplier{k}(1); }\n}\nclass T{k} {}\ninterface I{k} { a: string }\n"
    "app.get('/s/{k}', supplier{k});\napp.use('/all');\nbus.emit('made{n}', 1);\nfetch('/api/{k}');\n// fetch('/no')\ndb().select(users{n});\n"
)
NATION = "export function nation{k}(a) { return process.env.N{k}; }\n"
DDL = "CREATE TABLE IF NOT EXISTS r{k} (\n  id INT NOT NULL,\n  name VARCHAR(2{k}) DEFAULT 'a,b',\n  PRIMARY KEY (id),\n  up INT REFERENCES r0(id)\n);\n"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): parts as Python, suppliers and nations as TypeScript, regions as SQL."""
    t = lambda n: facts.table(spark, d, n)
    parts = t("part").select(said("src/b{b}/p{k}.py", b="p_size", k="p_partkey").alias("path"), said(PY, k="p_partkey", z="p_size").alias("content"))
    web = t("supplier").select(said("web/s{k}.ts", k="s_suppkey").alias("path"), said(WEB, k="s_suppkey", n="s_nationkey").alias("content"))
    nations = t("nation").select(said("web/n{k}.ts", k="n_nationkey").alias("path"), said(NATION, k="n_nationkey").alias("content"))
    ddl = t("region").select(said("db/r{k}.sql", k="r_regionkey").alias("path"), said(DDL, k="r_regionkey").alias("content"))
    return parts.unionByName(web).unionByName(nations).unionByName(ddl)


P, S, N = "'src/b' || p_size || '/p' || p_partkey || '.py'", "'web/s' || s_suppkey || '.ts'", "'web/n' || n_nationkey || '.ts'"


@query(
    f"""SELECT 'file:' || {P} AS source_id, 'class:' || {P} || ':Part' || p_partkey AS target_id, 'CONTAINS' AS kind, 2 AS verification FROM part
UNION ALL SELECT 'class:' || {P} || ':Part' || p_partkey, 'method:' || {P} || ':price', 'CONTAINS', 2 FROM part
UNION ALL SELECT 'file:' || {P}, 'function:' || {P} || ':make_' || p_partkey, 'CONTAINS', 2 FROM part
UNION ALL SELECT 'file:' || {P}, 'file:os.py', 'IMPORTS', 0 FROM part
UNION ALL SELECT 'file:' || {P}, 'file:lib/m' || p_size || '.py', 'IMPORTS', 0 FROM part
UNION ALL SELECT 'file:' || {P}, 'function:lib/m' || p_size || ':s' || p_partkey, 'REFERENCES', 0 FROM part
UNION ALL SELECT 'file:' || {S}, x || ':' || {S} || ':' || y || s_suppkey, 'CONTAINS', 2 FROM supplier, (VALUES ('function', 'supplier'), ('function', 'local'), ('class', 'S'), ('class', 'T'), ('interface', 'I')) v(x, y)
UNION ALL SELECT 'class:' || {S} || ':S' || s_suppkey, 'method:' || {S} || ':run', 'CONTAINS', 2 FROM supplier
UNION ALL SELECT 'file:' || {S}, x || ':' || {S} || ':' || y || s_suppkey, 'EXPORTS', 2 FROM supplier, (VALUES ('function', 'supplier'), ('class', 'S')) v(x, y)
UNION ALL SELECT 'file:' || {N}, 'function:' || {N} || ':nation' || n_nationkey, x, 2 FROM nation, (VALUES ('CONTAINS'), ('EXPORTS')) v(x)"""
)
def source_facts(spark, d):
    """Declarations with their holders, exports, and imports as the text tells them."""
    return extract.facts(files(spark, d), extract.LANGUAGES).where("what in ('node', 'edge')").select("source_id", "target_id", "kind", "verification")


@query(
    f"""SELECT 'file:' || {S} AS source_id, 'route:GET /s/' || s_suppkey AS target_id, 'EXPOSES_ROUTE' AS kind, m AS source_method FROM supplier, (VALUES ('express-routes'), ('fastify-routes')) v(m)
UNION ALL SELECT 'file:' || {S}, 'route:USE /all', 'EXPOSES_ROUTE', 'express-routes' FROM supplier
UNION ALL SELECT 'file:' || {S}, 'event:made' || s_nationkey, 'EMITS_EVENT', 'events-bridge' FROM supplier
UNION ALL SELECT 'file:' || {S}, 'route:UNKNOWN /api/' || s_suppkey, 'CONSUMES_ROUTE', 'generic-bridge' FROM supplier
UNION ALL SELECT 'file:' || {S}, 'db_table:users' || s_nationkey, 'READS_TABLE', 'drizzle-bridge' FROM supplier
UNION ALL SELECT 'file:' || {N}, 'config_key:N' || n_nationkey, 'REFERENCES', 'env-bridge' FROM nation"""
)
def contract_facts(spark, d):
    """L8 to L14."""
    return extract.facts(files(spark, d), extract.CONTRACTS).select("source_id", "target_id", "kind", "source_method")


@query(
    """SELECT 'db_table:r' || r_regionkey AS table_id, 'db_column:r' || r_regionkey || '.' || c AS column_id, CASE c WHEN 'name' THEN 'VARCHAR(2' || r_regionkey || ')' ELSE 'INT' END AS type FROM region, (VALUES ('id'), ('name'), ('up')) v(c)"""
)
def schema_fields(spark, d):
    """L17."""
    return extract.schema_facts(files(spark, d)).select("table_id", "column_id", "type")


@query(
    f"""SELECT 'file:' || {S} AS source_id, 'file:web/n' || s_nationkey || '.ts' AS target_id, 'IMPORTS' AS kind, 2 AS verification FROM supplier
UNION ALL SELECT 'file:' || {S}, 'unresolved::axios', 'UNRESOLVED_IMPORT', 0 FROM supplier
UNION ALL SELECT 'file:' || {S}, 'unresolved::./gone' || s_suppkey, 'UNRESOLVED_IMPORT', 0 FROM supplier
UNION ALL SELECT 'file:' || {S}, 'function:web/n' || s_nationkey || '.ts:nation' || s_nationkey, 'REFERENCES', 2 FROM supplier
UNION ALL SELECT 'function:' || {S} || ':supplier' || s_suppkey, 'function:web/n' || s_nationkey || '.ts:nation' || s_nationkey, 'CALLS', 2 FROM supplier
UNION ALL SELECT 'function:' || {S} || ':supplier' || s_suppkey, 'function:' || {S} || ':local' || s_suppkey, 'CALLS', 2 FROM supplier
UNION ALL SELECT 'method:' || {S} || ':run', 'function:' || {S} || ':supplier' || s_suppkey, 'CALLS', 2 FROM supplier
UNION ALL SELECT 'class:' || {S} || ':S' || s_suppkey, x || ':' || {S} || ':' || y || s_suppkey, k, 2 FROM supplier, (VALUES ('class', 'T', 'EXTENDS'), ('interface', 'I', 'IMPLEMENTS')) v(x, y, k)
UNION ALL SELECT 'function:' || {S} || ':supplier' || s_suppkey, 'unresolved::' || {S} || '::lost' || s_suppkey || '.go', 'UNRESOLVED_CALL', 0 FROM supplier
UNION ALL SELECT 'file:' || {S}, 'unresolved::' || {S} || '::' || c, 'UNRESOLVED_CALL', 0 FROM supplier, (VALUES ('app.get'), ('app.use'), ('bus.emit'), ('fetch'), ('db'), ('select')) v(c)"""
)
def resolved_edges(spark, d):
    """J14, L1, O: imports, bindings, calls and heritage of the suppliers, settled against the other files."""
    f = files(spark, d)
    got = cut(extract.facts(f, extract.LANGUAGES))  # read many times
    both = resolve.import_edges(got, f).unionByName(resolve.symbol_edges(got, f))
    return both.where("source_id like '%:web/s%'").select("source_id", "target_id", "kind", "verification")


@query(
    """WITH k AS (SELECT p_partkey AS k, p_partkey % 7 AS c FROM part)
SELECT 'm/f' || k || '.ts' AS importer, CASE c WHEN 0 THEN './a' || k WHEN 1 THEN './b' || k WHEN 2 THEN './c' || k WHEN 3 THEN '../up' || k WHEN 4 THEN 'lib' || k WHEN 5 THEN '@o/lib' || k || '/sub' ELSE '#own' || k END AS specifier,
CASE c WHEN 0 THEN 'm/a' || k || '.tsx' WHEN 1 THEN 'm/b' || k || '/index.js' WHEN 2 THEN 'm/c' || k || '/c' || k || '/index.ts' WHEN 4 THEN 'node_modules/lib' || k || '/out.js' WHEN 5 THEN 'm/node_modules/@o/lib' || k || '/sub.js' END AS path,
CASE c WHEN 4 THEN 'lib' || k WHEN 5 THEN '@o/lib' || k END AS package FROM k"""
)
def module_resolution(spark, d):
    """Endings, index files, a folder of the folder's name, packages by their entry and by a path in them."""
    k = facts.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("c"))
    pick = lambda *p: F.element_at(F.array(*(said(x, k="k") for x in p)), (F.col("c") + 1).cast("int"))
    imports = k.select(said("m/f{k}.ts", k="k").alias("importer"), pick("./a{k}", "./b{k}", "./c{k}", "../up{k}", "lib{k}", "@o/lib{k}/sub", "#own{k}").alias("specifier"))
    there = k.select(pick("m/a{k}.tsx", "m/b{k}/index.js", "m/c{k}/c{k}/index.ts", "m/up{k}.ts", "node_modules/lib{k}/out.js", "m/node_modules/@o/lib{k}/sub.js", "m/own{k}.ts").alias("path"))
    packages = k.where("c = 4").select(said("node_modules/lib{k}/package.json", k="k").alias("path"), F.lit('{"main": "./out.js"}').alias("content"))
    return resolve.modules(imports, there, packages)


@query(
    """WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS c FROM part)
SELECT path, kind FROM (SELECT CASE c WHEN 0 THEN 'd' || k || '/main.ts' WHEN 1 THEN 'd' || k || '/src/run.ts' WHEN 2 THEN 'd' || k || '/index.js' WHEN 3 THEN 'd' || k || '/go.py' END AS path, CASE c WHEN 0 THEN 'convention' WHEN 1 THEN 'bin' WHEN 2 THEN 'package-main' WHEN 3 THEN 'main-guard' END AS kind FROM k) WHERE path IS NOT NULL"""
)
def entry_points(spark, d):
    """By stem, by a package's bin (built from a source) and exports, by Python's main guard."""
    k = facts.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 6).alias("c"))
    pick = lambda *p: F.element_at(F.array(*(said(x, k="k") for x in p)), (F.col("c") + 1).cast("int"))
    code = k.select(pick("d{k}/main.ts", "d{k}/src/run.ts", "d{k}/index.js", "d{k}/go.py", "d{k}/util.ts", "d{k}/b.py").alias("path"), pick("x", "x", "x", "if __name__ == '__main__':\n  go()\n", "x", "# if __name__\n").alias("content"))
    packages = k.where("c in (1, 2, 4)").select(said("d{k}/package.json", k="k").alias("path"), pick("", '{"bin": {"run": "./dist/run.js"}}', '{"exports": {".": {"import": "./index.js"}}}', "", '{"main": "dist/none.js"}', "").alias("content"))
    return resolve.entry_points(code.unionByName(packages))


@query(
    """WITH p AS (SELECT 'packages/n' || s_nationkey || '/s' || s_suppkey || '.ts' AS path, s_suppkey AS k, s_nationkey AS n FROM supplier),
c AS (SELECT DISTINCT 'packages/n' || n AS path, CASE WHEN n % 2 = 0 THEN '@a/n' || n ELSE 'n' || n END AS name, CAST(CASE WHEN n % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS priority FROM p)
SELECT * FROM c UNION ALL SELECT 'packages', 'packages', 3 UNION ALL SELECT 'db', 'db', 3 UNION ALL SELECT '', 'root-files', 4"""
)
def containers_found(spark, d):
    """Workspaces with even nations, children of packages with odd ones, top-level folders, files at the root."""
    return containers.discovered(_packages(spark, d)).select("path", "name", "priority")


def _packages(spark: SparkSession, d: str) -> DataFrame:
    s = facts.table(spark, d, "supplier")
    code = s.select(said("packages/n{n}/s{k}.ts", n="s_nationkey", k="s_suppkey").alias("path"), F.lit("x").alias("content"))
    own = s.where("s_nationkey % 2 = 0").select("s_nationkey").distinct().select(said("packages/n{n}/package.json", n="s_nationkey").alias("path"), said('{"name": "@a/n{n}", "main": "s0.ts"}', n="s_nationkey").alias("content"))
    rest = spark.createDataFrame([("package.json", '{"workspaces": ["packages/*"]}'), ("go.ts", "x"), ("db/a.sql", "x"), ("dist/a.ts", "x"), (".x/a.ts", "x")], "path string, content string")
    return code.unionByName(own).unionByName(rest)


@query(
    """WITH p AS (SELECT 'packages/n' || s_nationkey || '/s' || s_suppkey || '.ts' AS path, s_nationkey AS n FROM supplier UNION ALL SELECT DISTINCT 'packages/n' || s_nationkey || '/package.json', s_nationkey FROM supplier WHERE s_nationkey % 2 = 0),
c AS (SELECT DISTINCT n, CASE WHEN n % 2 = 0 THEN '@a/n' || n ELSE 'n' || n END AS name FROM p)
SELECT name AS container, 'file:' || path AS node_id FROM p JOIN c ON starts_with(p.path, 'packages/n' || c.n)
UNION ALL SELECT 'packages', 'file:' || path FROM p UNION ALL SELECT 'db', 'file:db/a.sql' UNION ALL SELECT 'root-files', 'file:go.ts'"""
)
def containers_members(spark, d):
    """Members by prefix; a prefix ends anywhere, so that n1 holds the files of n12 too."""
    f = _packages(spark, d)
    found = containers.discovered(f)
    held = containers.members(found, f)
    return held.join(found.select(F.col("id").alias("container_id"), F.col("name").alias("container")), "container_id").select("container", "node_id")


@query(
    f"""SELECT DISTINCT 'function:' || {S} || ':handle' || s_suppkey AS source_id, 'variable:reg.ts:Registry' || s_nationkey AS target_id, 'Registry' || s_nationkey AS registry FROM supplier WHERE s_suppkey % 3 <> 2"""
)
def registrations(spark, d):
    """A decorator above a declaration, with another decorator, a blank line and a comment between
    them; a name that nothing defines, or two files define, is no registry."""
    s = facts.table(spark, d, "supplier")
    text = F.when(F.col("s_suppkey") % 3 == 2, said("@Twice.add\n@unknown\ndef handle{k}(x):\n", k="s_suppkey")).otherwise(said("x = 1\n@Registry{n}.add('a')\n@other\n\n# note\ndef handle{k}(x):\n", k="s_suppkey", n="s_nationkey"))
    f = s.select(said("web/s{k}.ts", k="s_suppkey").alias("path"), text.alias("content"))
    handlers = s.select(said("function:web/s{k}.ts:handle{k}", k="s_suppkey").alias("id"), said("handle{k}", k="s_suppkey").alias("name"), said("web/s{k}.ts", k="s_suppkey").alias("file"))
    registries = facts.table(spark, d, "nation").select(said("variable:reg.ts:Registry{k}", k="n_nationkey").alias("id"), said("Registry{k}", k="n_nationkey").alias("name"), F.lit("reg.ts").alias("file"))
    twice = spark.createDataFrame([("a", "Twice", "a.ts"), ("b", "Twice", "b.ts")], "id string, name string, file string")
    return resolve.registrations(f, handlers.unionByName(registries).unionByName(twice)).select("source_id", "target_id", "registry")


@query("SELECT l_orderkey AS line, 'm' || l_linenumber AS file, max(o.id) AS id FROM lineitem l JOIN (SELECT o_orderkey AS line, 'm1' AS file, 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') o ON o.line = l.l_orderkey AND o.file = 'm' || l_linenumber GROUP BY ALL")
def line_to_symbol(spark, d):
    """D11."""
    refs = facts.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), said("m{n}", n="l_linenumber").alias("file")).distinct()
    o = facts.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return resolve.at_line(refs, o.select(F.lit("m1").alias("file"), F.col("o_orderkey").alias("start_line"), F.col("o_orderkey").alias("end_line"), facts.key("order", "o_orderkey").alias("id"))).select("line", "file", "id")


@query(
    """SELECT 'r' || r || '/n' || n || '/s' || s_suppkey || '.ts' AS path, CASE WHEN s_suppkey % 2 = 0 AND n % 2 = 0 THEN 'r' || r || '/n' || n || '/AGENTS.md' WHEN n % 2 = 0 THEN 'r' || r || '/n' || n || '/AGENTS.md' ELSE 'r' || r || '/README.md' END AS doc
FROM (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
)
def nearest_docs(spark, d):
    """A nation's own document where it has one, the more telling of two, else the region's."""
    n = facts.table(spark, d, "nation")
    s = facts.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    entries = s.select(said("r{r}/n{n}/s{k}.ts", r="n_regionkey", n="n_nationkey", k="s_suppkey").alias("path"))
    even = n.where("n_nationkey % 2 = 0")
    docs = reduce(DataFrame.unionByName, [even.select(said("r{r}/n{n}/" + f, r="n_regionkey", n="n_nationkey").alias("path"), F.lit("x").alias("summary")) for f in ("AGENTS.md", "README.md")])
    docs = docs.unionByName(n.select(said("r{r}/README.md", r="n_regionkey").alias("path"), F.lit("y").alias("summary")).distinct()).unionByName(n.where("n_nationkey % 2 = 1").select(said("r{r}/n{n}/AGENTS.md", r="n_regionkey", n="n_nationkey").alias("path"), F.lit("").alias("summary")))
    return resolve.nearest_doc(entries, docs).select("path", "doc")


@query("SELECT 'd' || item_id || '.md' AS path, 'Item ' || item_id || ' — Some words on ' || item_id || ' and a link.' AS summary, 'Item ' || item_id || ' · Part One · Under' AS headings FROM benchmark")
def doc_summaries(spark, d):
    """Badges, fences and emphasis don't count, nor does a heading told twice."""
    text = "[![badge](u)](v)\n# Item {k}\n\n```\n# not a heading\n```\n\nSome *words* on `{k}`\nand [a link](http://x).\n\n## Part One\n\nmore\n\nUnder\n-----\n\n## Part One\n"
    b = facts.table(spark, d, "benchmark")
    return extract.doc_summary(b.select(said("d{k}.md", k="item_id").alias("path"), said(text, k="item_id").alias("content")))


PATHS = (
    ("a/node_modules/x{k}.js", "skip"), (".git/{k}", "skip"), ("p{k}/dist/a.js", "skip"), ("build/x{k}", "skip"), ("c/.env.{k}", "redact"), ("a{k}/.npmrc", "redact"), ("a{k}/.netrc", "redact"), (".aws/c{k}", "skip"),
    ("h/.config/gcloud/k{k}", "skip"), (".ssh/k{k}", "skip"), ("k{k}.pem", "skip"), ("s/k{k}.key", "skip"), ("k{k}/id_rsa", "skip"), ("k{k}.min.js", "skip"), ("k{k}.min.css", "skip"), ("coverage/k{k}", "skip"), ("a/k{k}.sqlite", "skip"),
    (".context-graph.sqlite-{k}", "skip"), ("src/k{k}.ts", None), ("src/distance{k}.ts", None), ("k{k}/xnode_modules/a", None), ("mine/internal/k{k}", "skip"),
)


@query("SELECT p_partkey AS k, ['" + "', '".join(str(a) for _, a in PATHS) + f"'][1 + p_partkey % {len(PATHS)}] AS action FROM part")
def exclusion_paths(spark, d):
    """The 25 rules and one's own, over paths of each kind."""
    k = facts.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    path = F.element_at(F.array(*(said(p, k="k") for p, _ in PATHS)), (1 + F.col("k") % len(PATHS)).cast("int"))
    return k.select("k", F.coalesce(X.exclusion(path, [("**/internal/**", "own", "skip")])["action"], F.lit("None")).alias("action"))


@query(
    """SELECT s_suppkey AS k, 'a ' || CASE s_suppkey % 6 WHEN 0 THEN 'apiKeys: [REDACTED]' WHEN 1 THEN 'credential= [REDACTED]' WHEN 2 THEN '[REDACTED] x' WHEN 3 THEN '[REDACTED]' WHEN 4 THEN 'refreshToken: [REDACTED] y' ELSE 'ghp_short sk-short AKIASHORT' END || ' z' AS clean FROM supplier"""
)
def redacted_secrets(spark, d):
    """Plural names, one character, whole tokens, and strings too short for a rule."""
    s = facts.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("h"))
    cases = ("apiKeys: '{h}'", "credential=h", "-----BEGIN RSA PRIVATE KEY----- x", "github_pat_{h}abcd", 'refreshToken: "a b" y', "ghp_short sk-short AKIASHORT")
    pick = F.element_at(F.array(*(said(c, h="h") for c in cases)), (1 + F.col("k") % 6).cast("int"))
    return s.select("k", X.redact(F.concat(F.lit("a "), pick, F.lit(" z"))).alias("clean"))


# State


def tables(spark: SparkSession, d: str) -> state.Tables:
    """State tables of the star schema: orders as nodes of the file of their customer, customers that import the
    one with half their key, nations as containers of customers that depend on their region's first."""
    t = lambda n: facts.table(spark, d, n)
    none, zero = F.lit(None).cast("string"), F.lit(0)
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    o = t("orders").select(facts.key("order", "o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("name"), facts.key("customer", "o_custkey").alias("file_path"), F.lit("function").alias("kind"))
    c = t("customer").select(facts.key("customer", "c_custkey").alias("node_id"), F.col("c_name").alias("name"), facts.key("customer", "c_custkey").alias("file_path"), F.lit("file").alias("kind"))
    nodes = o.unionByName(c).select("node_id", none.alias("stable_id"), none.alias("version_hash"), none.alias("previous_stable_id"), "kind", "name", F.col("node_id").alias("qualified_name"), "file_path", zero.alias("start_line"), zero.alias("end_line"), none.alias("signature"), none.alias("doc"), F.lit("ts").alias("language"), F.lit(0).cast("long").alias("seq"))
    e = t("orders").select(facts.key("order", "o_orderkey").alias("source_id"), facts.key("customer", "o_custkey").alias("target_id"), F.lit("CALLS").alias("kind"), F.lit(4).alias("verification"), F.lit("made").alias("source_method"), none.alias("metadata"), now.alias("created_at"), F.col("o_orderkey").cast("long").alias("seq"))
    i = t("customer").where("c_custkey > 1").select(facts.key("customer", "c_custkey").alias("importer_file"), F.expr("concat('customer:', cast(c_custkey div 2 as string))").alias("imported_file"), F.lit("IMPORTS").alias("edge_kind"))
    f = t("customer").select(facts.key("customer", "c_custkey").alias("file_path"), F.sha2("c_name", 256).alias("content_hash"), now.alias("indexed_at"))
    n = t("nation")
    members = t("customer").select(facts.key("nation", "c_nationkey").alias("container_id"), facts.key("customer", "c_custkey").alias("node_id"), F.lit("related").alias("role"))
    held = members.groupBy(F.col("container_id").alias("id")).agg(F.sort_array(F.collect_list("node_id")).alias("member_ids"))
    boxes = n.select(facts.key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, "logical").otherwise("physical").alias("kind"), F.expr("cast(array() as array<string>)").alias("entry_node_ids"), (F.col("n_nationkey") % 3).cast("int").alias("version"), (F.col("n_nationkey") == 4).alias("dirty")).join(held, "id", "left")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    deps = n.join(first, "n_regionkey").where("n_nationkey != first").select(facts.key("nation", "n_nationkey").alias("dependent_id"), facts.key("nation", "first").alias("dependency_id"))
    cache = t("customer").select(said("k{k}", k="c_custkey").alias("cache_key"), facts.key("nation", "c_nationkey").alias("container_id"), F.lit("impact").alias("policy"), F.array(facts.key("customer", "c_custkey")).alias("entry_ids"), F.array(facts.key("customer", "c_custkey"), F.concat(F.lit("customer:"), (F.col("c_custkey") + 5).cast("string"))).alias("node_ids"), F.expr("cast(array() as array<string>)").alias("edge_ids"), (F.col("c_custkey") % 3).cast("int").alias("version"), F.lit(2).alias("n"))
    empty = state.empty(spark)
    return empty | {"nodes": nodes, "evidence": e, "imports": i, "files": f, "members": members, "containers": boxes.withColumn("member_ids", F.coalesce("member_ids", F.expr("cast(array() as array<string>)"))), "deps": deps, "cache": cache, "entries": f.where("file_path like '%7'").select("file_path", F.lit("convention").alias("kind"))}


IMPORTED = "imports AS (SELECT 'customer:' || c_custkey AS importer, 'customer:' || (c_custkey // 2) AS imported FROM customer WHERE c_custkey > 1)"


@query(
    f"""WITH {IMPORTED}
SELECT 'node' AS what, 'order:' || o_orderkey AS id FROM orders WHERE o_custkey NOT IN (2, 5) UNION ALL SELECT 'node', 'customer:' || c_custkey FROM customer WHERE c_custkey NOT IN (2, 5)
UNION ALL SELECT 'edge', 'order:' || o_orderkey FROM orders WHERE o_custkey NOT IN (2, 5) UNION ALL SELECT 'file', 'customer:' || c_custkey FROM customer WHERE c_custkey NOT IN (2, 5)
UNION ALL SELECT 'import', importer FROM imports WHERE importer NOT IN ('customer:2', 'customer:5') AND imported NOT IN ('customer:2', 'customer:5')
UNION ALL SELECT DISTINCT 'dirty', importer FROM imports WHERE imported IN ('customer:2', 'customer:5') AND importer NOT IN ('customer:2', 'customer:5')"""
)
def delete_files(spark, d):
    """Two files go with all that is theirs or reaches them, and their importers turn dirty."""
    t = state.on_delete(tables(spark, d), spark.createDataFrame([("customer:2",), ("customer:5",)], "file_path string"))
    return reduce(DataFrame.unionByName, [t[n].select(F.lit(w).alias("what"), F.col(c).alias("id")) for n, w, c in (("nodes", "node", "node_id"), ("evidence", "edge", "source_id"), ("files", "file", "file_path"), ("imports", "import", "importer_file"), ("dirty", "dirty", "file_path"))])


@query(f"WITH RECURSIVE {IMPORTED}, c AS (SELECT 'customer:3' AS f UNION SELECT importer FROM c JOIN imports ON imported = f) SELECT f AS file_path, CASE f WHEN 'customer:3' THEN 'changed' ELSE 'transitive dependency changed' END AS reason FROM c")
def propagate_dirty(spark, d):
    """Everything that imports a dirty file turns dirty, with its reason."""
    one = spark.createDataFrame([("customer:3",)], "file_path string")
    return state.propagated(state.marked_dirty(tables(spark, d), one, "changed"))["dirty"].select("file_path", "reason")


@query(
    """WITH f AS (SELECT n_regionkey AS r, min(n_nationkey) AS first FROM nation GROUP BY n_regionkey), a AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_custkey IN (1, 2, 3) AND c_nationkey <> 4),
h AS (SELECT n FROM a UNION SELECT n_nationkey FROM nation JOIN f ON r = n_regionkey JOIN a ON a.n = f.first WHERE n_nationkey <> f.first)
SELECT 'nation:' || n_nationkey AS id, CAST(n_nationkey % 3 + CASE WHEN n_nationkey IN (SELECT n FROM h) THEN 1 ELSE 0 END AS INTEGER) AS version, n_nationkey = 4 OR n_nationkey IN (SELECT n FROM h) AS dirty FROM nation"""
)
def containers_dirtied(spark, d):
    """The containers of three changed files and their direct dependents."""
    paths = spark.createDataFrame([(f"customer:{i}",) for i in (1, 2, 3)], "file_path string")
    return state.containers_dirtied(tables(spark, d), paths)[0]["containers"].select("id", "version", "dirty")


@query("SELECT 'k' || c_custkey AS cache_key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 4 AND c_custkey % 3 >= n_nationkey % 3 AND c_custkey + 5 IN (SELECT c_custkey FROM customer)")
def cached_slices(spark, d):
    """D16, K6, B12."""
    return state.valid_cache(tables(spark, d)).select("cache_key")


@query("SELECT count(*) AS containers, count(*) FILTER (n_nationkey = 4) AS dirty, count(*) FILTER (n_nationkey % 4 <> 0) AS physical, (SELECT count(*) FROM customer) AS members FROM nation")
def container_status(spark, d):
    """E8."""
    return state.container_status(tables(spark, d))


@query(
    """SELECT (SELECT count(*) FROM customer) AS files, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS nodes, 0 AS dirty, (SELECT count(*) FROM nation) AS containers, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 7) AS entries, (SELECT count(*) FROM customer) AS cached, (SELECT count(*) FROM orders) AS edges, false AS resolved"""
)
def graph_stats(spark, d):
    """All eight values."""
    return state.counts(tables(spark, d))


@query("SELECT 'customer:' || o_custkey AS node_id, 'in' AS direction, 'CALLS' AS kind, 'order:' || o_orderkey AS other_id, o_orderpriority AS other_name FROM orders WHERE o_custkey % 10 = 1 UNION ALL SELECT 'order:' || o_orderkey, 'out', 'CALLS', 'customer:' || o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 100 = 1")
def explore_neighbours(spark, d):
    """D17."""
    t = tables(spark, d)
    number = F.substring_index("node_id", ":", -1).cast("long")
    ids = t["nodes"].where(((F.col("kind") == "file") & (number % 10 == 1)) | ((F.col("kind") == "function") & (number % 100 == 1)))
    return state.neighbours(t, graph.latest_evidence(t["evidence"]), ids, ("CALLS", "IMPORTS"))


@query("SELECT 'src/b' || p_size AS folder, count(*) AS n, min('src/b' || p_size || '/p' || p_partkey || '.py') AS first FROM part GROUP BY p_size UNION ALL SELECT 'web', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation), 'web/n0.ts' UNION ALL SELECT 'db', (SELECT count(*) FROM region), 'db/r0.sql'")
def files_by_directory(spark, d):
    """E6, I21."""
    return containers.by_directory(files(spark, d)).select("folder", F.size("files").cast("long").alias("n"), F.get("files", F.lit(0)).alias("first"))


@query("SELECT o_custkey AS k, o_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 4")
def fixed_cost_lines(spark, d):
    """lines of 2 tokens within a budget of 7, so four of them."""
    rows = facts.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("line"))
    return document.fixed_cost_prefix(rows, "k", ["line"], 7).select("k", "line")


@query("SELECT 'customer:' || c_custkey AS file_path FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'new:' || s_suppkey FROM supplier")
def changed_set(spark, d):
    """Changed and new files of two scans together."""
    c = facts.table(spark, d, "customer").select(facts.key("customer", "c_custkey").alias("file_path"), F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.sha2("c_name", 256)).alias("content_hash"))
    s = facts.table(spark, d, "supplier").select(facts.key("new", "s_suppkey").alias("file_path"), F.sha2("s_name", 256).alias("content_hash"))
    known = tables(spark, d)["files"]
    return state.changed(c, known).unionByName(state.changed(s, known)).select("file_path")
