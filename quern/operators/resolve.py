"""Joins that settle what one file's text can't: modules, entry points, calls, heritage, registries, documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

#: Endings and index files that a module may have, in order (fixed values).
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEXES = ("index.ts", "index.tsx", "index.js", "index.jsx")
#: Stems of entry files (fixed values).
ENTRY_STEMS = ("main", "cli", "server", "app", "__main__")
#: Documents that describe a folder, the most telling first (fixed values).
DOC_NAMES = ("AGENTS.md", "CLAUDE.md", "CONTEXT.md", "ARCHITECTURE.md", "README.md", "readme.md", "README.mdx", "index.md", "README.rst")
#: Registrations of a file at most (fixed value).
REGISTRATIONS = 100


def joined(*parts: Column) -> Column:
    return X.resolved_path(F.concat_ws("/", *parts))


def ancestors(folder: Column) -> Column:
    """A folder and those above it, the nearest first; the root is empty."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _tried(base: Column) -> Column:
    """The paths that a module at `base` may have, in order, without those of packages."""
    inner = F.concat_ws("/", base, X.basename(base))
    return F.array(*(F.concat(base, F.lit(e)) for e in ENDINGS), *(F.concat_ws("/", base, F.lit(i)) for i in INDEXES), *(F.concat_ws("/", inner, F.lit(i)) for i in INDEXES))


def first_existing(rows: DataFrame, keys: list[str], candidates: Column, files: DataFrame) -> DataFrame:
    """For each row of keys the first candidate that is a file: keys, path; rows without one are left out.

    The candidates of a row are few; each meets the files by an equal path."""
    each = rows.select(*keys, F.posexplode(candidates).alias("ord", "path"))
    found = each.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy(*keys).agg(F.min_by("path", "ord").alias("path"))


def modules(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(importer, specifier, path, package) for each distinct (importer, specifier); path is null where
    nothing is found, and package is set for what lies in a node_modules folder.

    A relative specifier is tried as it is, with each ending, as a folder's index and as the index of a
    folder of its own name; a bare one in the node_modules folders from the importer's upwards, by the entry
    that its package names (packages: path of the package.json, content); a # specifier is never found."""
    asked = imports.select("importer", "specifier").where("importer is not null and specifier is not null and specifier != ''").distinct()
    keys = ["importer", "specifier"]
    near = asked.where(F.col("specifier").startswith(".")).withColumn("base", joined(X.dirname(F.col("importer")), F.col("specifier")))
    relative = first_existing(near.where("base is not null"), keys, _tried(F.col("base")), files).withColumn("package", F.lit(None).cast("string"))

    bare = asked.where(~F.col("specifier").rlike(r"^[.#]"))
    scope = F.when(F.col("specifier").startswith("@"), 2).otherwise(1)
    parts = F.split("specifier", "/")
    bare = bare.select("*", F.array_join(F.slice(parts, 1, scope), "/").alias("package"), F.array_join(F.slice(parts, scope + 1, F.size(parts)), "/").alias("sub"))
    bare = bare.select("*", F.posexplode(ancestors(X.dirname(F.col("importer")))).alias("up", "folder"))
    bare = bare.withColumn("home", joined(F.col("folder"), F.lit("node_modules"), F.col("package")))
    if packages is not None:
        named = F.coalesce(*(F.get_json_object("content", f"$.{k}") for k in ("import", "module", "main")))
        said = packages.where(F.col("path").endswith("/package.json")).select(X.dirname(F.col("path")).alias("home"), named.alias("named"))
        bare = bare.join(said, "home", "left")
    else:
        bare = bare.withColumn("named", F.lit(None).cast("string"))
    target = joined(F.col("home"), F.when(F.col("sub") != "", F.col("sub")).otherwise(F.coalesce("named", F.lit("index.js"))))
    tried = F.array(*(F.concat(target, F.lit(e)) for e in ENDINGS), *(F.concat_ws("/", target, F.lit(i)) for i in INDEXES))
    each = bare.select(*keys, "package", "up", F.posexplode(tried).alias("ord", "path"))
    found = each.join(files.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.min_by(F.struct("path", "package"), F.struct("up", "ord")).alias("f"))
    both = relative.unionByName(found.select(*keys, "f.path", "f.package"))
    return asked.join(both, keys, "left")


def import_edges(facts: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """IMPORTS to files and packages at tier 2, UNRESOLVED_IMPORT at tier 0, of the module refs of TypeScript."""
    refs = facts.where("what = 'ref' and kind = 'IMPORTS'").select(F.col("path").alias("importer"), F.col("detail").alias("specifier"), "source_id").distinct()
    done = refs.join(modules(refs, files, packages), ["importer", "specifier"])
    target = F.when(F.col("path").isNull(), F.concat(F.lit("unresolved::"), "specifier")).when(F.col("package").isNotNull(), F.concat(F.lit("package:"), "package")).otherwise(F.concat(F.lit("file:"), "path"))
    kind = F.when(F.col("path").isNull(), "UNRESOLVED_IMPORT").otherwise("IMPORTS")
    return done.select("source_id", target.alias("target_id"), kind.alias("kind"), F.when(F.col("path").isNull(), 0).otherwise(2).alias("verification"), F.lit("ts-text").alias("source_method"))


def symbol_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """REFERENCES of import bindings, EXTENDS, IMPLEMENTS, CALLS and the EXPORTS of names, and UNRESOLVED_CALL.

    A name means what its own file declares, else what an import binds in the module that is found for it;
    a default import means that module's first exported declaration. Calls of members are not resolved."""
    decl = facts.where("what = 'node' and target_kind != 'method'").groupBy("path", "name").agg(F.min("target_id").alias("target_id"))
    first = facts.where("what = 'edge' and kind = 'EXPORTS'").groupBy("path").agg(F.min_by("target_id", "start_line").alias("target_id")).withColumn("name", F.lit("default"))
    known = decl.unionByName(first.select("path", "name", "target_id"))
    bound = facts.where("what in ('binding', 'export')").select(F.col("path").alias("importer"), F.col("detail").alias("specifier"), F.col("target_id").alias("wanted"), F.col("name").alias("local"), "source_id", "kind", "what")
    to = modules(bound.where("specifier is not null"), files).where("path is not null and package is null").select("importer", "specifier", "path")
    far = bound.join(to, ["importer", "specifier"]).join(known.select("path", F.col("name").alias("wanted"), "target_id"), ["path", "wanted"])
    own = bound.where("what = 'export' and specifier is null").join(known.select(F.col("path").alias("importer"), F.col("name").alias("wanted"), "target_id"), ["importer", "wanted"])
    bindings = far.select("source_id", "target_id", "kind").unionByName(own.select("source_id", "target_id", "kind")).distinct()
    names = decl.select("path", "name", "target_id").unionByName(far.where("what = 'binding'").select(F.col("importer").alias("path"), F.col("local").alias("name"), "target_id"))
    names = names.groupBy("path", "name").agg(F.min("target_id").alias("to"))
    refs = facts.where("what = 'ref' and kind != 'IMPORTS'").select("path", "source_id", F.col("target_id").alias("expression"), "name", "kind", "detail")
    simple = refs.withColumn("key", F.when((F.col("kind") != "CALLS") | (F.col("detail") == F.col("expression")), F.col("name")))
    met = simple.join(names.withColumnRenamed("name", "key"), ["path", "key"], "left")
    found = met.where("to is not null").select("source_id", F.col("to").alias("target_id"), "kind", F.lit(2).alias("verification"))
    lost = met.where("to is null and kind = 'CALLS'").select("source_id", F.concat_ws("::", F.lit("unresolved"), "path", "expression").alias("target_id"), F.lit("UNRESOLVED_CALL").alias("kind"), F.lit(0).alias("verification"))
    out = bindings.withColumn("verification", F.lit(2)).unionByName(found).unionByName(lost)
    return out.distinct().withColumn("source_method", F.lit("ts-text"))


def all_edges(facts: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """O: every edge of a tree's facts with its tier and method."""
    columns = ["source_id", "target_id", "kind", "verification", "source_method"]
    plain = facts.where("what in ('node', 'edge')").select(*columns)
    return plain.unionByName(import_edges(facts, files, packages)).unionByName(symbol_edges(facts, files)).distinct()


def import_index(edges: DataFrame) -> DataFrame:
    """(importer_file, imported_file, edge_kind) of the IMPORTS between files that were found."""
    files = edges.where("kind = 'IMPORTS' and verification > 0 and source_id like 'file:%' and target_id like 'file:%'")
    return files.select(F.substring("source_id", 6, 1 << 20).alias("importer_file"), F.substring("target_id", 6, 1 << 20).alias("imported_file"), F.col("kind").alias("edge_kind")).distinct()


# Entry points


def package_targets(packages: DataFrame) -> DataFrame:
    """(folder, target, kind) of bin, main, module and exports of each package.json, whatever their nesting."""
    strings = lambda c: F.filter(F.regexp_extract_all(c, F.lit(r'"(?:\\.|[^"\\])*"\s*:|"((?:\\.|[^"\\])*)"'), F.lit(1)), lambda s: s != "")
    out = None
    for field, kind in (("bin", "bin"), ("main", "package-main"), ("module", "package-main"), ("exports", "package-main")):
        value = F.get_json_object("content", f"$.{field}")
        every = F.when(value.rlike(r"^\s*[\[{]"), strings(value)).otherwise(F.array(value))
        part = packages.where(value.isNotNull()).select(X.dirname(F.col("path")).alias("folder"), F.explode(every).alias("target"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def entry_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind): built output means its source where that is a file: dist, build, out or lib as src,
    and a script's ending as a source's."""
    base = F.regexp_replace("target", r"^\./", "")
    both = F.array_distinct(F.array(base, F.regexp_replace(base, r"(^|/)(?:dist|build|out|lib)/", "$1src/")))
    more = F.flatten(F.transform(both, lambda c: F.array(*(F.regexp_replace(c, r"\.(?:js|cjs|mjs)$", e) for e in (".ts", ".tsx", ".mts", ".cts")))))
    tried = F.transform(F.array_distinct(F.concat(both, more)), lambda c: X.resolved_path(F.concat_ws("/", "folder", c)))
    return first_existing(targets.where("target != ''").distinct(), ["folder", "target", "kind"], F.filter(tried, lambda c: c.isNotNull()), files).select("path", "kind").distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(path, kind) of the entry files of a tree (path, content): by stem, else by what a package
    names, else by Python's main guard; of several kinds for a file the last of these that holds is kept."""
    packages = files.where(X.basename(F.col("path")) == "package.json")
    named = entry_targets(package_targets(packages), files).withColumn("seq", F.when(F.col("kind") == "bin", 0).otherwise(1))
    code = files.where(~X.basename(F.col("path")).isin("package.json"))
    stem = F.lower(X.stem(F.col("path"))).isin(*ENTRY_STEMS)
    guard = F.lower("path").endswith(".py") & F.col("content").rlike(r"""(?m)^\s*if\s+__name__\s*==\s*['"]__main__['"]\s*:""")
    own = code.select("path", F.when(stem, "convention").when(guard, "main-guard").alias("kind"), F.lit(2).alias("seq")).where("kind is not null")
    return named.unionByName(own).groupBy("path").agg(F.max_by("kind", "seq").alias("kind"))


# Names


def definitions(nodes: DataFrame, registries: bool = False) -> DataFrame:
    """(id, name, file, start_line, end_line) of six kinds of declarations; of variables too for registries."""
    kinds = ("function", "class", "method", "interface", "type", "enum", *(("variable",) if registries else ()))
    return nodes.where(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("id"), "name", F.col("file_path").alias("file"), "start_line", "end_line")


def unique_definitions(defs: DataFrame) -> DataFrame:
    """Distinctive names with one definition each: name, id, file."""
    return defs.where(X.distinctive(F.col("name"))).groupBy("name").agg(F.min("id").alias("id"), F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").drop("n")


def registrations(files: DataFrame, defs: DataFrame, cap: int = REGISTRATIONS) -> DataFrame:
    """An edge from what a decorator stands above to the registry that its root name means, both
    uniquely defined; at most `cap` a file, in the order of its lines."""
    decorator = r"^\s*@\s*([A-Za-z_]\w*)"
    declared = r"\b(?:def|class|function|func|fn|const|let|var|interface|enum|struct|trait|type|object|val|record|module)\s+([A-Za-z_]\w*)"
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    passed = (F.trim("line") == "") | F.col("line").rlike(decorator) | F.col("line").rlike(r"^\s*(#|//)")
    after = Window.partitionBy("path").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    rooted = lines.withColumn("next", F.first(F.when(~passed, F.col("line")), ignorenulls=True).over(after)).where(F.col("line").rlike(decorator))
    named = rooted.select("path", "at", F.regexp_extract("line", decorator, 1).alias("registry"), F.regexp_extract("next", declared, 1).alias("handler"))
    one = unique_definitions(defs)
    met = named.join(one.select(F.col("name").alias("registry"), F.col("id").alias("target_id")), "registry").join(one.select(F.col("name").alias("handler"), F.col("id").alias("source_id")), "handler").where("source_id != target_id")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return met.withColumn("rk", rank).where(F.col("rk") <= cap).select("source_id", "target_id", F.lit("REFERENCES").alias("kind"), F.lit(2).alias("verification"), F.lit("registry").alias("source_method"), "registry")


def enclosing(refs: DataFrame, defs: DataFrame, block: int = 64) -> DataFrame:
    """Each reference (file, line, ...) with the id of the innermost interval (file, start_line,
    end_line, id) around its line: the latest start, of these the latest end; else the file itself.

    Intervals are dealt to blocks of lines, so that the join is by equal keys; one of more than 64 blocks is
    dealt to blocks 64 times as large, and so on, so that none makes more than 65 rows."""
    keys = refs.columns
    spans = defs.select(F.col("file").alias("f__"), "start_line", "end_line", "id", F.ceil(F.log(F.greatest(F.lit(1.0), (F.col("end_line") - F.col("start_line") + 1) / float(block))) / math.log(block)).cast("int").alias("level"))
    size = lambda level: F.pow(F.lit(float(block)), level + F.lit(1))
    spans = spans.withColumn("b__", F.explode(F.sequence(F.floor(F.col("start_line") / size(F.col("level"))), F.floor(F.col("end_line") / size(F.col("level"))))))
    levels = [r[0] for r in spans.select("level").distinct().limit(16).collect()]  # a few: a level is a power of 64 lines
    probes = refs.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels or [0])))).withColumn("b__", F.floor(F.col("line") / size(F.col("level"))))
    on = (probes["file"] == spans["f__"]) & (probes["level"] == spans["level"]) & (probes["b__"] == spans["b__"]) & probes["line"].between(spans["start_line"], spans["end_line"])
    met = probes.join(spans, on, "left").groupBy(*keys).agg(F.max_by("id", F.struct("start_line", "end_line", "id")).alias("id"))
    return met.withColumn("id", F.coalesce("id", F.concat(F.lit("file:"), "file")))


def at_line(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References (file, line) with the id of what is declared on just that line, the last one where there are several."""
    last = defs.groupBy("file", F.col("start_line").alias("line")).agg(F.max_by("id", F.struct("end_line", "id")).alias("id"))
    return refs.join(last, ["file", "line"])


def nearest_doc(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, doc, summary) for each entry file: the document of the nearest folder above it, of these
    the most telling; documents (path, summary) without summary don't count, nor does a file itself."""
    ranks = F.create_map(*(x for i, n in enumerate(DOC_NAMES) for x in (F.lit(n), F.lit(i))))
    held = docs.where("summary is not null and summary != ''").select(F.col("path").alias("doc"), X.dirname(F.col("path")).alias("folder"), "summary", ranks[X.basename(F.col("path"))].alias("rank")).where("rank is not null")
    climbed = entries.select("path").distinct().select("path", F.posexplode(ancestors(X.dirname(F.col("path")))).alias("up", "folder"))
    met = climbed.join(held, "folder").where("doc != path")
    return met.groupBy("path").agg(F.min_by(F.struct("doc", "summary"), F.struct("up", "rank")).alias("d")).select("path", "d.*")
