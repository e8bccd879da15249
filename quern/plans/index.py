"""Building and refreshing the graph of a source tree, and slices of it: the operators put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import extract
from quern.functions import text as X
from quern.operators import containers, graph, references, resolve, search, state
from quern.operators.document import rendered
from quern.operators.facts import stable_id, upserted, version_hash
from quern.plans.storage import cut
from quern.sources import files as source_files
from quern.sources import runtime

ALL = extract.LANGUAGES + extract.CONTRACTS + extract.SCHEMAS


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of all files of a tree that any extractor reads, redacted where a
    rule says so; ignored folders and skipped files are left out before contents are read."""
    every = tuple(sorted({e.lstrip(".") for e in (*extract.TYPESCRIPT, *extract.GENERIC, *(x for g in extract.GRAMMARS for x in g.extensions))} | {*source_files.EXTENSIONS["doc"], *source_files.EXTENSIONS["spec"]}))
    rules = [(g, "skip") for g in (*X.IGNORED, *ignore)] + [(g, a) for g, _, a in X.EXCLUSIONS]
    found = source_files.scan(spark, root, every, rules)
    return found.withColumn("content", F.when(X.excluded(F.col("path")) == "redact", X.redact(F.col("content"))).otherwise(F.col("content")))


def file_nodes(files: DataFrame) -> DataFrame:
    """One node for each file, with what it says of itself."""
    docs = extract.doc_summary(files.where(F.col("path").rlike(r"\.(" + "|".join(source_files.EXTENSIONS["doc"]) + ")$")))
    said = F.concat(F.lit("file:"), "path")
    rows = files.join(docs, "path", "left")
    return rows.select(said.alias("node_id"), version_hash(F.col("content")).alias("version_hash"), F.lit("file").alias("kind"), F.col("path").alias("name"), said.alias("qualified_name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("headings").alias("signature"), F.col("summary").alias("doc"), F.lit("generic").alias("language"))


def nodes_of(facts: DataFrame, files: DataFrame) -> DataFrame:
    """B1: nodes of the facts and their targets, and of the files, by the upsert rules."""
    own = facts.where("what = 'node'").select("target_id", version_hash(F.col("name")).alias("version_hash"), "target_kind", "name", "path", "start_line", "end_line", "signature", "doc", F.lit(1).alias("seq"))
    far = facts.where("what = 'edge' and target_id not like 'unresolved::%' and kind not in ('EXPORTS')").select("target_id", version_hash(F.col("name")).alias("version_hash"), "target_kind", "name", "path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("doc"), F.lit(0).alias("seq"))
    names = ["node_id", "version_hash", "kind", "name", "file_path", "start_line", "end_line", "signature", "doc", "seq"]
    decl = own.unionByName(far).toDF(*names).withColumn("qualified_name", F.col("node_id")).withColumn("language", F.lit("ts"))
    rows = decl.unionByName(file_nodes(files).withColumn("seq", F.lit(2)))
    rows = rows.withColumn("previous_stable_id", F.lit(None).cast("string"))
    out = upserted(rows, "node_id").withColumn("stable_id", stable_id(F.col("qualified_name"))).withColumn("seq", F.col("seq").cast("long"))
    return out.select(*(x.split()[0] for x in state.SCHEMAS["nodes"].split(", ")))


def index(tables: state.Tables, files: DataFrame, now=None) -> state.Tables:
    """K4: the tables after a scan of the whole tree. Only files that are new or changed are read by the
    extractors; names, registries and modules are settled against all. Vanished files are cleared."""
    spark = files.sparkSession
    now = F.localtimestamp() if now is None else now
    scanned = files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"))
    fresh = state.changed(scanned, tables["files"])
    gone = tables["files"].join(scanned, "file_path", "left_anti").select("file_path")
    tables = state.on_delete(tables, gone)
    tables = state.cleared(tables, fresh)
    some = files.join(fresh.select(F.col("file_path").alias("path")), "path", "left_semi")
    facts = cut(extract.facts(some, ALL))  # read many times
    packages = files.where(X.basename(F.col("path")) == "package.json")
    edges = resolve.all_edges(facts, files, packages)
    tables = tables | {"nodes": state.put(tables["nodes"], nodes_of(facts, some), "node_id")}
    defs = resolve.definitions(tables["nodes"])
    plain = some.where(~F.col("path").rlike(r"\.(ts|tsx|js|jsx|" + "|".join(source_files.EXTENSIONS["doc"]) + ")$"))
    crossed = references.enrich(plain.select(F.concat(F.lit("file:"), "path").alias("file"), F.col("content").alias("text")), defs.select("id", "name", F.concat(F.lit("file:"), "file").alias("file")))
    columns = ["source_id", "target_id", "kind", "verification", "source_method"]
    crossed = crossed.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("REFERENCES").alias("kind"), F.lit(2).alias("verification"), F.lit("cross-ref").alias("source_method"))
    registered = resolve.registrations(some, resolve.definitions(tables["nodes"], registries=True)).select(*columns)
    new = edges.unionByName(crossed).unionByName(registered).select(*columns, F.lit(None).cast("string").alias("metadata"), now.alias("created_at"), F.xxhash64(*columns).alias("seq"))
    tables = tables | {
        "evidence": tables["evidence"].unionByName(new),
        "imports": state.added(tables["imports"], resolve.import_index(edges)),
        "files": state.put(tables["files"], fresh.select("file_path", "content_hash", now.alias("indexed_at")), "file_path"),
        "entries": resolve.entry_points(files).select(F.col("path").alias("file_path"), "kind"),
    }
    return tables | {"dirty": state.without(tables["dirty"], fresh.select("file_path"), "file_path")} if spark else tables


def with_containers(tables: state.Tables, files: DataFrame) -> state.Tables:
    """The tables with all containers built anew."""
    c, m, d = containers.built(files, graph.latest_evidence(tables["evidence"]))
    return tables | {"containers": c, "members": m, "deps": d}


def with_traces(tables: state.Tables, traces: DataFrame) -> state.Tables:
    """Evidence of a run, tier 5 and so on, with the nodes that it names."""
    now = F.localtimestamp()
    new = traces.select("source_id", "target_id", "kind", "verification", "source_method", F.to_json("metadata").alias("metadata"), now.alias("created_at"), F.xxhash64("source_id", "target_id", "kind").alias("seq"))
    return tables | {"evidence": tables["evidence"].unionByName(new), "nodes": state.added(tables["nodes"], runtime.nodes(traces), ["node_id"])}


def found(tables: state.Tables, query: str, limit: int = 10) -> DataFrame:
    """node_id, kind, name, position; nodes of entry files first among equals."""
    entries = tables["nodes"].join(tables["entries"].select("file_path"), "file_path", "left_semi").select("node_id")
    return search.search(tables["nodes"], query, limit, entries)


def slice_text(tables: state.Tables, files: DataFrame, query: str, policy: str = "impact", max_tokens: int = 12_000, mode: str | None = None, seeds: int = 5) -> str:
    """The flagship query: search, close over the policy's steps, render."""
    spark = files.sparkSession
    top = found(tables, query, seeds).orderBy("position").limit(seeds).collect()
    if not top:
        return f"// Nothing found for: {query}"
    entries = [r.node_id for r in top[:1]]
    edges = graph.latest_evidence(tables["evidence"])
    nodes, held = graph.compile_slice(edges.select("source_id", "target_id", "kind", "verification"), tables["nodes"], spark.createDataFrame([(e,) for e in entries], "node_id string"), graph.POLICIES[policy])
    near = None
    where = nodes.where(F.col("node_id").isin(*entries)).select(F.col("file_path").alias("path"))
    docs = extract.doc_summary(files.where(X.basename(F.col("path")).isin(*resolve.DOC_NAMES)))
    hit = resolve.nearest_doc(where, docs).limit(1).collect()
    if hit:
        near = (hit[0].doc, hit[0].summary)
    told = held.join(edges.select("source_id", "target_id", "kind", "metadata"), ["source_id", "target_id", "kind"], "left")
    return rendered(nodes, told, entries, files, policy, max_tokens, mode, doc=near)
