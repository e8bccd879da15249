"""The command line: `python -m quern.cli COMMAND`, over a source tree and a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import graph, state
from quern.plans import index as plans
from quern.sources import files as source_files
from quern.sources import runtime

MODES = ("balanced", "source-first", "edges-first")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("command", choices=["init", "index", "watch", "query", "slice", "invalidate", "reindex", "container", "cache", "import-test-trace", "import-otel", "import-coverage", "security", "serve", "stats"])
    p.add_argument("action", nargs="?", help="build, list or status (container); clear or status (cache); status, check or redact (security)")
    p.add_argument("--root", default=".")
    p.add_argument("--db", default="")
    p.add_argument("--limit", type=int)
    p.add_argument("--query", default="")
    p.add_argument("--policy", default="impact", choices=sorted(graph.POLICIES))
    p.add_argument("--max-tokens", type=int, default=12_000)
    p.add_argument("--render-mode", choices=MODES)
    p.add_argument("--ignore-patterns", default="")
    p.add_argument("--file", default="")
    p.add_argument("--text", default="")
    return p


def padded(rows, *widths: int) -> list[str]:
    """Rows of values in columns."""
    return ["  ".join(str("" if v is None else v).ljust(w) for v, w in zip(r, [*widths, *[0] * len(r)], strict=False)).rstrip() for r in rows]


class Session:
    """What the commands and the server share: the tree's files, the stored tables."""

    def __init__(self, spark: SparkSession, root: str, db: str = "", ignore: tuple[str, ...] = ()):
        self.spark, self.root, self.ignore = spark, root, ignore
        self.store = state.Store(spark, db or f"{root.rstrip('/')}/.quern")

    def files(self):
        return plans.read_tree(self.spark, self.root, self.ignore)

    def index(self) -> list[str]:
        self.store.transaction(lambda t: plans.index(t, self.files()))
        return self.stats()

    def stats(self) -> list[str]:
        return [f"{k}: {v}" for k, v in state.counts(self.store.read()).first().asDict().items()]

    def imported(self, kind: str, path: str) -> list[str]:
        matching = source_files.TRACES[kind]
        found = self.spark.read.text(path, wholetext=True).select(F.col("value").alias("content")) if path else source_files.scan(self.spark, self.root, matching=matching)
        traces = runtime.IMPORTERS[kind](found)
        self.store.transaction(lambda t: plans.with_traces(t, traces))
        return [f"imported {traces.count()} edges"]


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """The lines that a command prints; errors are raised."""
    a = parser().parse_args(argv)
    s = Session(spark, a.root, a.db, tuple(x for x in a.ignore_patterns.split(",") if x))
    if a.command == "init":
        s.store.write(state.empty(spark))
        return ["initialised"]
    if a.command == "index":
        return s.index()
    if a.command == "reindex":
        s.store.write(state.empty(spark))
        return s.index()
    if a.command == "query":
        return padded([(r.kind, r.name, r.node_id) for r in plans.found(s.store.read(), a.query, a.limit or 10).orderBy("position").collect()], 10, 30)
    if a.command == "slice":
        return plans.slice_text(s.store.read(), s.files(), a.query, a.policy, a.max_tokens, a.render_mode, a.limit or 5).split("\n")
    if a.command == "invalidate":
        X.guarded(a.file, a.root)
        one = spark.createDataFrame([(a.file,)], "file_path string")
        t = s.store.transaction(lambda t: state.containers_dirtied(state.propagated(state.marked_dirty(state.on_change(t, one), one, "invalidated")), one)[0])
        return padded([(r.file_path, r.reason) for r in state.dirty_files(t).limit(a.limit or 1000).collect()], 50)
    if a.command == "container":
        if a.action == "build":
            s.store.transaction(lambda t: plans.with_containers(t, s.files()))
        t = s.store.read()
        if a.action == "status":
            return [f"{k}: {v}" for k, v in state.container_status(t).first().asDict().items()]
        return padded([(r.id[:12], r.kind, r.name, len(r.member_ids), "dirty" if r.dirty else "clean") for r in state.listed_containers(t).limit(a.limit or 1000).collect()], 12, 10, 30, 6)
    if a.command == "cache":
        if a.action == "clear":
            s.store.transaction(state.invalidated)
        t = s.store.read()
        return [f"cached: {t['cache'].count()}", f"valid: {state.valid_cache(t).count()}"]
    if a.command.startswith("import-"):
        kind = {"import-test-trace": "test-trace", "import-otel": "otel-trace", "import-coverage": "coverage-trace"}[a.command]
        return s.imported(kind, a.file)
    if a.command == "security":
        if a.action == "redact":
            return [spark.createDataFrame([(a.text,)], "t string").select(X.redact(F.col("t"))).first()[0]]
        if a.action == "check":
            got = spark.createDataFrame([(a.file,)], "p string").select(X.exclusion(F.col("p")).alias("e")).first().e
            return [f"{got.action}: {got.reason} ({got.pattern})" if got else "included"]
        return padded(X.EXCLUSIONS, 30, 10)
    if a.command == "stats":
        return s.stats()
    if a.command == "watch":
        from quern.streaming.changes import watch

        watch(spark, a.root, lambda: s.index())
        return ["stopped"]
    from quern.server import serve

    serve(s, sys.stdin, sys.stdout)
    return []


def main() -> int:
    spark = SparkSession.builder.appName("quern").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print("\n".join(run(spark, sys.argv[1:])))
        return 0
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
