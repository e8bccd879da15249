"""Containers of a source tree: their discovery, members, roles and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.facts import stable_id
from quern.operators.resolve import ancestors

#: Folders whose children are containers, and folders that are none (fixed values).
PARENTS = ("src", "services", "packages", "apps")
NEVER = ("node_modules", "dist", "coverage")


def folders(files: DataFrame) -> DataFrame:
    """(folder) of every folder that holds a file, in the end; the root is empty."""
    return files.select(F.explode(ancestors(X.dirname(F.col("path")))).alias("folder")).distinct()


def workspaces(files: DataFrame) -> DataFrame:
    """Priority 0: (path, name, entry) of the packages in the folders that the root's package.json names."""
    packages = files.where(X.basename(F.col("path")) == "package.json")
    said = F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>")
    homes = packages.where("path = 'package.json'").select(F.explode(said).alias("glob")).select(X.resolved_path(F.regexp_replace("glob", r"\*$", "")).alias("home"))
    own = packages.select(X.dirname(F.col("path")).alias("path"), "content").withColumn("home", X.dirname(F.col("path")))
    main = F.get_json_object("content", "$.main")
    return own.join(homes.distinct(), "home", "left_semi").where("path != ''").select("path", F.coalesce(F.get_json_object("content", "$.name"), X.basename(F.col("path"))).alias("name"), X.resolved_path(F.concat_ws("/", "path", main)).alias("entry"))


def discovered(files: DataFrame) -> DataFrame:
    """(path, name, id, kind, priority, entry): workspaces, folders with a tsconfig, children of PARENTS,
    other top-level folders, then the TypeScript files at the root as a group; the first claim on a path wins,
    and ids come from names alone."""
    none = F.lit(None).cast("string")
    hidden = F.col("folder").rlike(r"(^|/)\.")
    a = workspaces(files).select("path", "name", F.lit(0).alias("priority"), F.when(F.col("entry") != F.col("path"), F.col("entry")).alias("entry"))
    config = files.where((X.basename(F.col("path")) == "tsconfig.json") & ~X.dirname(F.col("path")).rlike(r"(^|/)(\.|node_modules(/|$)|dist(/|$))")).select(X.dirname(F.col("path")).alias("folder"))
    b = config.select(F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("path"), F.when(F.col("folder") == "", "root").otherwise(F.translate("folder", "/", "-")).alias("name"), F.lit(1).alias("priority"), none.alias("entry"))
    every = folders(files).where("folder != ''")
    c = every.where(X.dirname(F.col("folder")).isin(*PARENTS) & ~hidden).select(F.col("folder").alias("path"), X.basename(F.col("folder")).alias("name"), F.lit(2).alias("priority"), none.alias("entry"))
    d = every.where(~F.col("folder").contains("/") & ~hidden & ~F.col("folder").isin(*NEVER)).select(F.col("folder").alias("path"), F.col("folder").alias("name"), F.lit(3).alias("priority"), none.alias("entry"))
    e = files.where(~F.col("path").contains("/") & F.col("path").rlike(r"\.tsx?$")).select("path").groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("").alias("path"), F.lit("root-files").alias("name"), F.lit(4).alias("priority"), none.alias("entry"))
    both = a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)
    won = both.groupBy("path").agg(F.min_by(F.struct("name", "priority", "entry"), F.struct("priority", "name")).alias("w")).select("path", "w.*")
    return won.withColumn("kind", F.lit("physical")).withColumn("id", stable_id(F.concat(F.lit("physical:"), "name"), "container"))


def members(found: DataFrame, files: DataFrame) -> DataFrame:
    """(container_id, node_id, role) of the files below each container's path, its entry file primary. A
    path is a prefix of characters, as file nodes are looked up by it; one file may be in several containers."""
    each = files.select("path", F.explode(F.sequence(F.lit(1), F.length("path"))).alias("n")).select("path", F.col("path").substr(F.lit(1), F.col("n")).alias("prefix"))
    by_prefix = each.join(found.where("path not in ('', '.')").select(F.col("path").alias("prefix"), "id", "entry"), "prefix")
    root = found.where("path = ''").select("id", "entry")
    loose = files.where(~F.col("path").contains("/") & F.col("path").rlike(r"\.tsx?$")).crossJoin(F.broadcast(root))  # one row at most
    both = by_prefix.select("id", "entry", "path").unionByName(loose.select("id", "entry", "path"))
    role = F.when(F.col("path").eqNullSafe(F.col("entry")), "primary").otherwise("related")
    return both.groupBy(F.col("id").alias("container_id"), F.concat(F.lit("file:"), "path").alias("node_id")).agg(F.min(role).alias("role"))


def dependencies(found: DataFrame, member: DataFrame, edges: DataFrame) -> DataFrame:
    """(dependent_id, dependency_id): each container of an imported file against the first container, in
    the order of discovery, of the file that imports it; the imported side is the dependent, as the tables have it."""
    order = found.groupBy("id").agg(F.min(F.struct("priority", "path")).alias("o"))
    first = member.join(order.withColumnRenamed("id", "container_id"), "container_id").groupBy("node_id").agg(F.min_by("container_id", "o").alias("source_container"))
    hit = edges.where("kind = 'IMPORTS'").join(member.select(F.col("node_id").alias("target_id"), "container_id"), "target_id").join(first.withColumnRenamed("node_id", "source_id"), "source_id")
    return hit.where("container_id != source_container").select(F.col("container_id").alias("dependent_id"), F.col("source_container").alias("dependency_id")).distinct()


def by_directory(files: DataFrame) -> DataFrame:
    """(folder, files) with the paths sorted."""
    return files.groupBy(X.dirname(F.col("path")).alias("folder")).agg(F.sort_array(F.collect_set("path")).alias("files"))


def built(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(containers, members, deps) of a tree; of containers that share an id the last one found stays."""
    found = discovered(files)
    held = members(found, files)
    ids = held.groupBy(F.col("container_id").alias("id")).agg(F.sort_array(F.collect_set("node_id")).alias("member_ids"), F.sort_array(F.collect_set(F.when(F.col("role") == "primary", F.col("node_id")))).alias("entry_node_ids"))
    last = found.groupBy("id").agg(F.max_by(F.struct("name", "kind"), F.struct("priority", "path")).alias("w")).select("id", "w.*")
    none = F.expr("cast(array() as array<string>)")
    rows = last.join(ids, "id", "left").select("id", "name", "kind", F.coalesce("entry_node_ids", none).alias("entry_node_ids"), F.coalesce("member_ids", none).alias("member_ids"), F.lit(1).alias("version"), F.lit(False).alias("dirty"))
    return rows, held, dependencies(found, held, edges)
