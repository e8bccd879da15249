"""The tables of a graph as DataFrames, with the rules by which they are written, cleared and looked up.

Every change gives new DataFrames; `Store` writes them as new versions of Parquet tables and swaps a pointer,
so that a failed change leaves the old version in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each table.
SCHEMAS = {
    "nodes": "node_id string, stable_id string, version_hash string, previous_stable_id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, doc string, language string, seq long",
    "evidence": "source_id string, target_id string, kind string, verification int, source_method string, metadata string, created_at timestamp_ntz, seq long",
    "imports": "importer_file string, imported_file string, edge_kind string",
    "files": "file_path string, content_hash string, indexed_at timestamp_ntz",
    "resolved": "file_path string",
    "entries": "file_path string, kind string",
    "dirty": "file_path string, reason string, created_at timestamp_ntz",
    "containers": "id string, name string, kind string, entry_node_ids array<string>, member_ids array<string>, version int, dirty boolean",
    "members": "container_id string, node_id string, role string",
    "deps": "dependent_id string, dependency_id string",
    "cache": "cache_key string, container_id string, policy string, entry_ids array<string>, node_ids array<string>, edge_ids array<string>, version int, n int",
}
#: The key of each table whose last row for a key wins.
KEYS = {"files": "file_path", "resolved": "file_path", "entries": "file_path", "dirty": "file_path", "containers": "id", "cache": "cache_key"}
#: Tables whose rows are a set.
SETS = ("imports", "deps")

Tables = dict[str, DataFrame]


def empty(spark: SparkSession) -> Tables:
    """All tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def put(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def added(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose key is not there yet; the first of a key in `old` stays."""
    key = key or old.columns
    return old.unionByName(new.select(*old.columns).dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose column is none of the ids (one column)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of some ids (one column), each once; ids without a node are left out."""
    return nodes.join(ids.select(F.col(ids.columns[0]).alias("node_id")).distinct(), "node_id", "left_semi")


def files_below(nodes: DataFrame, prefix: str) -> DataFrame:
    """File nodes whose path starts with a prefix, a folder's or not."""
    return nodes.where((F.col("kind") == "file") & F.col("file_path").startswith(prefix))


def cleared(tables: Tables, paths: DataFrame, incoming: bool = False) -> Tables:
    """All tables without what some files (file_path) brought: their nodes, the evidence that leaves
    these (and with `incoming`, that reaches them), their rows of the catalog and the ledger, their imports
    of both sides, and their dirty rows."""
    paths = paths.select("file_path").distinct()
    gone = tables["nodes"].join(paths, "file_path", "left_semi").select("node_id")
    evidence = without(tables["evidence"], gone, "source_id")
    out = dict(tables)
    out["nodes"] = without(tables["nodes"], paths, "file_path")
    out["evidence"] = without(evidence, gone, "target_id") if incoming else evidence
    for name in ("files", "resolved", "dirty"):
        out[name] = without(tables[name], paths, "file_path")
    out["imports"] = without(without(tables["imports"], paths, "importer_file"), paths, "imported_file")
    return out


def changed(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files (file_path, content_hash) that are new or whose hash is another."""
    return scanned.join(files.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


def marked_dirty(tables: Tables, paths: DataFrame, reason: str, now: Column | None = None) -> Tables:
    """The files (file_path) with a reason; a new mark replaces an old one."""
    new = paths.select("file_path").distinct().select("file_path", F.lit(reason).alias("reason"), (F.localtimestamp() if now is None else now).alias("created_at"))
    return tables | {"dirty": put(tables["dirty"], new, "file_path")}


def dirty_files(tables: Tables) -> DataFrame:
    """By time, then by path."""
    return tables["dirty"].orderBy("created_at", "file_path")


def on_change(tables: Tables, paths: DataFrame) -> Tables:
    """The direct importers of changed files turn dirty."""
    hit = tables["imports"].join(paths.select(F.col("file_path").alias("imported_file")), "imported_file", "left_semi").select(F.col("importer_file").alias("file_path"))
    return marked_dirty(tables, without(hit, paths, "file_path"), "dependency changed")


def on_delete(tables: Tables, paths: DataFrame) -> Tables:
    """The importers of deleted files turn dirty, and the files are cleared with what reaches them."""
    return cleared(on_change(tables, paths), paths, incoming=True)


def on_rename(tables: Tables, old: str, new: str) -> Tables:
    """The importers of both paths turn dirty."""
    hit = tables["imports"].where(F.col("imported_file").isin(old, new)).select(F.col("importer_file").alias("file_path"))
    return marked_dirty(tables, hit, f"renamed {old} to {new}")


def propagated(tables: Tables) -> Tables:
    """All files that import dirty ones, in the end, turn dirty; those marked keep their reasons."""
    from quern.operators.graph import dependents

    found = dependents(tables["imports"], tables["dirty"].select(F.col("file_path").alias("node_id"))).select(F.col("node_id").alias("file_path"))
    return marked_dirty(tables, without(found, tables["dirty"].select("file_path"), "file_path"), "transitive dependency changed")


def containers_of(tables: Tables, nodes: DataFrame) -> DataFrame:
    """(node_id, container_id, role) of nodes (node_id)."""
    return tables["members"].join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "container_id", "role")


def container_marked(tables: Tables, ids: DataFrame) -> Tables:
    """Containers (id) and their direct dependents turn dirty, each a version up, once."""
    ids = ids.select("id").distinct()
    near = tables["deps"].join(ids.select(F.col("id").alias("dependency_id")), "dependency_id", "left_semi").select(F.col("dependent_id").alias("id"))
    hit = ids.unionByName(near).distinct().withColumn("hit", F.lit(True))
    c = tables["containers"]
    both = c.join(hit, "id", "left")
    return tables | {"containers": both.select(*(F.when(F.col("hit"), F.col("version") + 1).otherwise(F.col("version")).alias("version") if n == "version" else F.coalesce("hit", "dirty").alias("dirty") if n == "dirty" else n for n in c.columns))}


def containers_dirtied(tables: Tables, paths: DataFrame) -> tuple[Tables, DataFrame]:
    """The containers of the nodes of changed files turn dirty with their dependents, those that are dirty
    aside; and their ids."""
    nodes = tables["nodes"].join(paths.select("file_path").distinct(), "file_path", "left_semi")
    held = containers_of(tables, nodes).select(F.col("container_id").alias("id")).distinct()
    affected = held.join(tables["containers"].where("not dirty").select("id"), "id", "left_semi")
    return container_marked(tables, affected), affected


def listed_containers(tables: Tables) -> DataFrame:
    """G5."""
    return tables["containers"].orderBy("kind", "name", "id")


def container_status(tables: Tables) -> DataFrame:
    """One row: containers, dirty, physical, members."""
    return tables["containers"].agg(F.count("*").alias("containers"), F.count_if("dirty").alias("dirty"), F.count_if(F.col("kind") == "physical").alias("physical"), F.coalesce(F.sum(F.size("member_ids")), F.lit(0)).alias("members"))


def valid_cache(tables: Tables) -> DataFrame:
    """The cached slices that still hold: their container is there and clean, its version no newer,
    and all their nodes are there."""
    c = tables["containers"].select(F.col("id").alias("container_id"), F.col("version").alias("now"), "dirty")
    some = tables["cache"].join(c, "container_id").where("not dirty and version >= now").drop("now", "dirty")
    each = some.select("cache_key", F.explode(F.array_distinct("node_ids")).alias("node_id"))
    lost = each.join(tables["nodes"].select("node_id"), "node_id", "left_anti").select("cache_key")
    return without(some, lost, "cache_key").select(*tables["cache"].columns)


def invalidated(tables: Tables, container: str | None = None) -> Tables:
    """The cache without a container's slices, or without any."""
    return tables | {"cache": tables["cache"].where(F.col("container_id") != container) if container else tables["cache"].limit(0)}


def neighbours(tables: Tables, edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(node_id, direction, kind, other_id, other_name) of the edges of some kinds at each node; the other
    end's name is null where it has no row."""
    some = edges.where(F.col("kind").isin(*kinds))
    ids = ids.select("node_id").distinct()
    out = some.select(F.col("source_id").alias("node_id"), F.lit("out").alias("direction"), "kind", F.col("target_id").alias("other_id")).join(ids, "node_id", "left_semi")
    back = some.select(F.col("target_id").alias("node_id"), F.lit("in").alias("direction"), "kind", F.col("source_id").alias("other_id")).join(ids, "node_id", "left_semi")
    names = tables["nodes"].select(F.col("node_id").alias("other_id"), F.col("name").alias("other_name"))
    return out.unionByName(back).join(names, "other_id", "left").select("node_id", "direction", "kind", "other_id", "other_name")


def has_evidence_from(tables: Tables, method: str) -> bool:
    """C9."""
    return not tables["evidence"].where(F.col("source_method") == method).isEmpty()


def counts(tables: Tables) -> DataFrame:
    """One row: files, nodes, edges, dirty, containers, entries, cached slices, and whether any edge was
    resolved by a language server."""
    sizes = [tables[t].agg(F.count("*").alias(n)) for t, n in (("files", "files"), ("nodes", "nodes"), ("dirty", "dirty"), ("containers", "containers"), ("entries", "entries"), ("cache", "cached"))]
    e = tables["evidence"]
    sizes.append(e.select("source_id", "target_id", "kind").distinct().agg(F.count("*").alias("edges")))
    sizes.append(e.agg(F.coalesce(F.max(F.col("source_method").endswith("-lsp")), F.lit(False)).alias("resolved")))
    out = sizes[0]
    for x in sizes[1:]:
        out = out.crossJoin(x)  # one row each
    return out


class Store:
    """The tables in a folder. A change writes new versions and then the pointer that names them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0] if fs.exists(at) else None

    def read(self) -> Tables:
        v = self.version()
        return {n: self.spark.read.schema(s).parquet(f"{self.folder}/{v}/{n}") for n, s in SCHEMAS.items()} if v else empty(self.spark)

    def write(self, tables: Tables) -> None:
        """All tables as a new version; readers see the old one until the last step."""
        v = uuid.uuid4().hex
        for n, s in SCHEMAS.items():
            columns = [x.split()[0] for x in s.split(", ")]
            tables[n].select(*columns).write.parquet(f"{self.folder}/{v}/{n}")
        old = self.version()
        self.spark.createDataFrame([(v,)], "value string").coalesce(1).write.text(f"{self.folder}/next-{v}")
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        fs.delete(path(f"{self.folder}/CURRENT"), True)
        if not fs.rename(path(f"{self.folder}/next-{v}"), path(f"{self.folder}/CURRENT")):
            raise OSError(f"the new version {v} could not be put in place")
        if old:
            fs.delete(path(f"{self.folder}/{old}"), True)

    def transaction(self, change: Callable[[Tables], Tables]) -> Tables:
        """Applies a change to the tables; where it raises, nothing is written."""
        self.write(change(self.read()))
        return self.read()
