"""Graph operators: latest evidence, capped adjacency, closure, policies, slices, tiers, invalidation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.storage import cut, dealt, drop, partitions


@dataclass(frozen=True)
class Step:
    kinds: tuple[str, ...]
    direction: str = "both"  # forward, reverse or both
    cap: int = 25
    stops: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    name: str
    max_tokens: int
    steps: tuple[Step, ...]


_CLIMB = Step(("CONTAINS",), "reverse", 1)
_QUIET = ("^console$", "^logger$")
#: Traversal policies (fixed values): kinds, direction, cap and stop patterns of each step.
POLICIES = {
    p.name: p
    for p in (
        Policy("minimal", 4000, (_CLIMB, Step(("CONTAINS", "CALLS", "REFERENCES", "IMPORTS"), "forward", 10, (*_QUIET, "^_")))),
        Policy("function_edit", 8000, (_CLIMB, Step(("CONTAINS", "CALLS", "REFERENCES"), "forward", 20, _QUIET), Step(("IMPORTS", "EXPORTS"), "both", 10), Step(("CALLS", "REFERENCES"), "reverse", 15, ("^test", "spec$")))),
        Policy("endpoint_edit", 12000, (_CLIMB, Step(("EXPOSES_ROUTE", "CONSUMES_ROUTE"), "both", 10), Step(("CONTAINS", "CALLS", "REFERENCES"), "forward", 20, _QUIET), Step(("READS_TABLE", "WRITES_TABLE"), "forward", 10), Step(("IMPORTS", "EXPORTS"), "both", 10))),
        Policy("schema_edit", 8000, (_CLIMB, Step(("READS_TABLE", "WRITES_TABLE"), "forward", 20), Step(("CALLS", "REFERENCES"), "both", 15), Step(("CALLS", "REFERENCES"), "reverse", 10))),
        Policy("impact", 16000, (_CLIMB, Step(("CALLS", "REFERENCES", "IMPORTS", "EXPORTS"), "both", 25, (*_QUIET, "^_")), Step(("EXPOSES_ROUTE", "CONSUMES_ROUTE", "READS_TABLE", "WRITES_TABLE"), "forward", 10), Step(("EXTENDS", "IMPLEMENTS"), "both", 10), Step(("UNRESOLVED_CALL", "UNRESOLVED_IMPORT"), "forward", 5))),
    )
}


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """D3: one row for each edge with the tier, method and metadata of its latest observation."""
    last = F.max_by(F.struct("verification", "source_method", "metadata"), F.struct("created_at", "seq"))
    return evidence.groupBy("source_id", "target_id", "kind").agg(last.alias("e")).select("source_id", "target_id", "kind", "e.*")


def expand(edges: DataFrame, frontier: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges that leave (forward) or reach (reverse) the nodes of the frontier."""
    some = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    end = "source_id" if direction == "forward" else "target_id"
    return some.join(frontier.select(F.col("node_id").alias(end)).distinct(), end, "left_semi").select(*edges.columns)


def adjacency(edges: DataFrame, nodes: DataFrame, step: Step, of: DataFrame | None = None) -> DataFrame:
    """For each node its neighbours over one step: the `cap` of highest tier, none for a node
    whose name matches a stop pattern. Ties go by direction (out first), kind, neighbour. `of` (node_id) are a
    few nodes whose neighbours alone are wanted: they are broadcast, and other edges are not shuffled."""
    kinds = sorted(step.kinds)
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "kind")]
    place = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(kinds))).alias("k__")  # shorter than a name
    some = edges.where(F.col("kind").isin(*kinds))
    out = some.select(F.col("source_id").alias("node"), F.col("target_id").alias("nbr"), F.lit(0).alias("dir"), place, *rest)
    back = some.select(F.col("target_id").alias("node"), F.col("source_id").alias("nbr"), F.lit(1).alias("dir"), place, *rest)
    both = {"forward": out, "reverse": back, "both": out.unionByName(back)}[step.direction]
    few = None if of is None else F.broadcast(of.select(F.col("node_id").alias("node")))
    if few is not None:
        both = both.join(few, "node", "left_semi")
    if step.stops:
        stopped = nodes.where(F.col("name").rlike("|".join(f"({s})" for s in step.stops))).select(F.col("node_id").alias("node"))
        stopped = cut(stopped.distinct() if few is None else stopped.join(few, "node", "left_semi"))
        n = stopped.count()
        if n:
            both = both.join(F.broadcast(stopped) if n <= NARROW else stopped, "node", "left_anti")
    order = Window.partitionBy("node").orderBy(F.desc("verification"), "dir", "k__", "nbr")
    kept = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= step.cap)
    outward = F.col("dir") == 0
    ends = {"source_id": F.when(outward, F.col("node")).otherwise(F.col("nbr")), "target_id": F.when(outward, F.col("nbr")).otherwise(F.col("node")), "kind": F.element_at(F.array(*map(F.lit, kinds)), F.col("k__") + 1)}
    return kept.select("node", "nbr", "dir", *(ends[c].alias(c) if c in ends else c for c in edges.columns))


#: Nodes of a frontier up to which it is broadcast (its size is known before); frontiers of a step that are looked
#: up among all edges before all links are made; levels after which the nodes seen are written anew as one table;
#: estimated bytes of links a bucket.
NARROW, LOOKS, LEVELS, BUCKET = 20_000, 12, 8, 16 << 20


def buckets(df: DataFrame) -> int:
    """Buckets for the links of df: more of them, not larger ones, where there are more links."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(4096, max(df.sparkSession.sparkContext.defaultParallelism, size // BUCKET))


def _levels(links: DataFrame, seen: list[DataFrame], n: int, limit: int) -> DataFrame:
    """The nodes reached over links (n buckets by node), from the last of seen (tables of n buckets by node_id).

    Each level joins what lies in equal buckets, and moves only the ends of the frontier's links."""
    spark = links.sparkSession
    for _ in range(limit):
        with partitions(spark, n):
            near = links.join(seen[-1].hint("shuffle_hash"), links.node == F.col("node_id")).select(F.col("nbr").alias("node_id")).distinct()
            for old in seen:
                near = near.join(old.hint("shuffle_hash"), "node_id", "left_anti")
            frontier = dealt(near, "node_id", n)
            done = frontier.isEmpty()
            if not done:
                seen = [*seen, frontier]
            if len(seen) > (1 if done else LEVELS):
                last = [] if done else [seen.pop()]
                whole = dealt(_all(seen).repartition(n, "node_id"), "node_id", n)
                drop(*seen)
                seen = [whole, *last]
        if done:
            drop(frontier)
            return seen[0]
    raise RuntimeError("the closure did not end")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def closure(links: DataFrame, seeds: DataFrame, limit: int = 10_000) -> DataFrame:
    """Nodes reached from the seeds (node_id) over links (node, nbr), seeds included; `limit` levels raise
    an error. Links are written once, in buckets by node."""
    n = buckets(links)
    with partitions(links.sparkSession, n):
        links = dealt(links.select("node", "nbr").distinct().repartition(n, "node"), "node", n)
        first = dealt(seeds.select("node_id").where("node_id is not null").distinct().repartition(n, "node_id"), "node_id", n)
    found = _levels(links, [first], n, limit)
    drop(links)
    return found


def reached(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, step: Step, n: int | None = None, limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(node_id) of what a step reaches from the seeds, and the links taken, with the columns of edges.

    While frontiers are narrow, the links of each are looked up among the edges, which shuffles no others. A wide
    frontier, or a long way, has the links of all nodes written once, in buckets by node."""
    frontier = cut(seeds.select("node_id").where("node_id is not null").distinct())
    seen, found = [frontier], []
    for _ in range(min(LOOKS, limit)):
        if frontier.count() > NARROW:
            break
        links = cut(adjacency(edges, nodes, step, frontier))
        found.append(links.select(*edges.columns))
        near = links.select(F.col("nbr").alias("node_id")).where("node_id is not null").distinct()
        frontier = cut(near.join(_all(seen), "node_id", "left_anti"))
        if frontier.isEmpty():
            return cut(_all(seen)), _all(found)
        seen.append(frontier)
    n = n or buckets(edges)
    with partitions(edges.sparkSession, n):
        links = dealt(adjacency(edges, nodes, step).where("node is not null and nbr is not null"), "node", n)
        tables = [dealt(t.repartition(n, "node_id"), "node_id", n) for t in ([_all(seen[:-1])] if seen[1:] else []) + seen[-1:]]
    whole = _levels(links, tables, n, limit)
    return whole, links.join(whole.withColumnRenamed("node_id", "node").hint("shuffle_hash"), "node", "left_semi").select(*edges.columns)


def _nothing(df: DataFrame) -> bool:
    """Whether the plan alone says that there are no rows."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


def few(rows: DataFrame) -> DataFrame:
    """rows (stored), to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= NARROW else rows


def compile_slice(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a slice. Each step closes over all that was seen before it; a step whose
    kinds don't occur is passed over."""
    seen, found = cut(seeds.select("node_id").distinct()), edges.limit(0)
    for step in policy.steps:
        if not _nothing(edges.where(F.col("kind").isin(*step.kinds))):
            seen, mine = reached(edges, nodes, seen, step)
            found = found.unionByName(mine)
    return nodes.join(few(seen), "node_id", "left_semi"), found.dropDuplicates(["source_id", "target_id", "kind"])


def token_estimate(slice_nodes: DataFrame, slice_edges: DataFrame) -> DataFrame:
    """The estimated tokens of a slice (no signatures: they are null here)."""
    n = slice_nodes.agg(F.coalesce(F.sum(0.25 * F.length("name") + 5), F.lit(0.0)).alias("n"))
    e = slice_edges.agg(F.coalesce(F.sum(0.25 * (F.length("source_id") + F.length("target_id") + F.length("kind")) + 2), F.lit(0.0)).alias("e"))
    return n.crossJoin(e).select(F.ceil(F.col("n") + F.col("e")).cast("long").alias("tokens"))  # one row each


def dependents(imports: DataFrame, seeds: DataFrame, transitive: bool = True, keep_seeds: bool = False) -> DataFrame:
    """Files that import the seeds, directly or in the end; the seeds themselves left out."""
    links = imports.select(F.col("imported_file").alias("node"), F.col("importer_file").alias("nbr"))
    seeds = seeds.select("node_id")
    found = closure(links, seeds) if transitive else links.join(seeds, links.node == seeds.node_id).select(F.col("nbr").alias("node_id")).distinct()
    return found if keep_seeds else found.join(seeds, "node_id", "left_anti")


def assign_tiers(slice_nodes: DataFrame, slice_edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Tier 0 for entries, 1 for files of a CONTAINS edge, functions and classes, else 2; a long
    signature moves 0 and 1 to 2, but never a file."""
    ends = slice_edges.where("kind = 'CONTAINS'").select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct().withColumn("held", F.lit(True))
    entry = entries.select("node_id").distinct().withColumn("entry", F.lit(True))
    marked = slice_nodes.join(ends, "node_id", "left").join(entry, "node_id", "left")
    first = F.when(F.col("entry"), 0).when(F.col("kind").isin("function", "class") | F.coalesce("held", F.lit(False)), 1).otherwise(2)
    long = F.length(F.coalesce("signature", F.lit(""))) > 200
    return marked.withColumn("tier", F.when(long & (first < 2), F.when(F.col("kind") == "file", F.least(first, F.lit(1))).otherwise(2)).otherwise(first)).drop("held", "entry")
