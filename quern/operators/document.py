"""The text of a slice: header, nearest document, and five phases under one budget of tokens."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graph, render

#: Costs in tokens, and the longest text of an edge (fixed values).
HEADER, TITLE, PLAIN, EDGE_CHARS, PER_TOKEN = 50, 5, 2, 200, 3.2
ROUTES = ("EXPOSES_ROUTE", "CONSUMES_ROUTE")


def tok(n: int) -> int:
    return math.ceil(n / PER_TOKEN)


@dataclass
class Page:
    """The lines so far and what is left of the whole budget."""

    left: int
    lines: list[str] = field(default_factory=list)

    def title(self, text: str) -> bool:
        if TITLE > self.left:
            return False
        self.left -= TITLE
        self.lines.append(f"// --- {text} ---")
        return True


def with_excerpts(nodes: DataFrame, files: DataFrame, context: int = 2) -> DataFrame:
    """Nodes with a tier, and the lines of their files (path, content) that they span; files, functions
    and classes (tier 0 and 1) with lines of context around them."""
    around = F.when(F.col("tier") <= 1, context).otherwise(0)
    lines = F.split("content", "\n")
    first = F.greatest(F.lit(0), F.col("start_line") - 1 - around)
    last = F.least(F.size(lines), F.col("end_line") + around)
    text = F.when(last > first, F.array_join(F.slice(lines, first + 1, last - first), "\n")).otherwise("")
    return nodes.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left").withColumn("excerpt", F.coalesce(text, F.lit(""))).drop("content")


def edge_lines(edges: DataFrame) -> DataFrame:
    """Edges above tier 1 and at tier 0 with their line, its cost, and their order by tier."""
    meta = F.when(F.col("metadata").isNotNull(), F.concat(F.lit(" "), F.col("metadata"))).otherwise("") if "metadata" in edges.columns else F.lit("")
    text = F.concat(F.lit("// "), "source_id", F.lit(" --["), "kind", F.lit("]--> "), "target_id", F.lit(" ["), F.col("verification").cast("string"), F.lit("]"), meta)
    shown = F.when(F.length(text) > EDGE_CHARS, F.concat(F.substring(text, 1, EDGE_CHARS), F.lit(" ..."))).otherwise(text)
    return edges.where("verification != 1").withColumn("line", shown).withColumn("cost", F.greatest(F.lit(3), F.ceil(F.length("line") / PER_TOKEN)).cast("int"))


EDGE_ORDER = (F.desc, "verification"), (F.asc, "kind"), (F.asc, "source_id"), (F.asc, "target_id")


def edge_phase(page: Page, edges: DataFrame, name: str, cap: int) -> None:
    """edges in order until one doesn't fit; then how many remain. No more than cap / 3 can fit."""
    total = edges.count()
    if not total or cap <= 0:
        return
    spent = TITLE if page.title(f"{name} Edges") else 0
    rows = edges.orderBy(*(f(c) for f, c in EDGE_ORDER)).limit(cap // 3 + 2).select("line", "cost").collect()  # bounded by the budget
    for i, r in enumerate(rows):
        if spent >= cap or spent + r.cost > cap:
            page.lines.append(f"// [{name.lower()} edges truncated, {total - i} remaining]")
            return
        page.lines.append(r.line)
        spent += r.cost
        page.left -= r.cost


def source_phase(page: Page, nodes: Iterator, total: int, cap: int) -> None:
    """whole or cut excerpts of tiers 0 and 1, signatures of the others; what doesn't fit is passed over."""
    if page.title("Source"):
        cap -= TITLE
    for i, n in enumerate(nodes):
        if n.entry:
            continue
        if cap <= 0:
            page.lines.append(f"// [budget exhausted, skipping {total - i} remaining nodes]")
            return
        at = f"{n.kind}: {n.qualified_name} ({n.file_path}:{n.start_line}"
        if n.tier <= 1:
            cost = min(tok(len(n.excerpt)), cap)
            if cost < 10:
                continue
            page.lines.append(f">>> {at}-{n.end_line})")
            told = tok(len(n.doc) + 6) if n.doc else 0
            if n.doc and told <= cap - cost:
                page.lines.append(f"// » {n.doc}")
                cap, page.left = cap - told, page.left - told
            page.lines += ["```", n.excerpt[: math.ceil(cost * PER_TOKEN)], "```"]
        elif n.signature:
            after = f"  — {n.doc}" if n.doc else ""
            cost = tok(len(n.signature) + len(after))
            if cost > cap:
                continue
            page.lines += [f"// SIG {at})", f"// {n.signature}{after}"]
        else:
            continue
        cap, page.left = cap - cost, page.left - cost


def plain_phase(page: Page, edges: DataFrame, title: str, arrow, cap: int) -> int:
    """each line costs the same until nothing is left; the rest of the cap."""
    if edges.isEmpty() or not page.title(title):
        return cap
    cap -= TITLE
    for r in edges.orderBy("source_id", "kind", "target_id").limit(max(0, -(-cap // PLAIN))).collect():  # bounded by the budget
        page.lines.append(arrow(r))
        cap, page.left = cap - PLAIN, page.left - PLAIN
    return cap


def rendered(nodes: DataFrame, edges: DataFrame, entries: list[str], files: DataFrame, policy: str = "impact", max_tokens: int = 12_000, mode: str | None = None, context: int = 2, doc: tuple[str, str] | None = None, container: str | None = None) -> str:
    """The text of one slice.

    nodes: node_id, kind, name, qualified_name, file_path, start_line, end_line, signature, doc; edges:
    source_id, target_id, kind, verification and, if wanted, metadata (JSON); files: path, content; doc: path
    and summary of the nearest document. Nodes without a place are counted but not shown. Nodes stream in
    order, one at a time; all else that is collected is bounded by the budget."""
    spark = nodes.sparkSession
    seeds = spark.createDataFrame([(e,) for e in entries], "node_id string")
    caps = render.phase_caps(policy, max_tokens, mode)
    head = ["// Context: Slice", "", f"// Entry: {', '.join(entries)}", *([f"// Container: {container}"] if container else []), f"// Nodes: {nodes.count()} | Edges: {edges.count()}", ""]
    page = Page(max_tokens - HEADER, head)
    if doc and max_tokens >= 1500:
        cost = tok(len(doc[0]) + len(doc[1]) + 12)
        if cost <= min(300, math.floor(max_tokens * 0.08), page.left):
            page.lines += [f"// --- Nearest doc: {doc[0]} ---", f"// » {doc[1]}", ""]
            page.left -= cost
    placed = graph.assign_tiers(nodes, edges, seeds).where("start_line > 0 and file_path != ''")
    placed = placed.join(seeds.distinct().withColumn("entry", F.lit(True)), "node_id", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    shown = with_excerpts(placed, files, context)
    first = shown.where("entry").orderBy("file_path", "start_line", "node_id").limit(1).collect()
    if first and caps[0] > 0:
        n = first[0]
        page.title("Entry Source")
        cost = min(tok(len(n.excerpt)), caps[0] - TITLE)
        if cost > 10:
            page.lines.append(f">>> ENTRY {n.kind}: {n.qualified_name} ({n.file_path}:{n.start_line}-{n.end_line})")
            if n.doc and tok(len(n.doc) + 6) <= page.left:
                page.lines.append(f"// » {n.doc}")
                page.left -= tok(len(n.doc) + 6)
            page.lines += ["```", n.excerpt[: math.ceil(cost * PER_TOKEN)], "```"]
            page.left -= cost
    lined = edge_lines(edges)
    touches = F.col("source_id").isin(*entries) | F.col("target_id").isin(*entries)
    edge_phase(page, lined.where(touches), "Entry", caps[1])
    source_phase(page, shown.orderBy("file_path", "start_line", "node_id").toLocalIterator(), placed.count(), caps[2])
    edge_phase(page, lined.where(~touches), "Other", caps[3])
    left = plain_phase(page, edges.where(F.col("kind").isin(*ROUTES)), "Routes", lambda r: f"// {r.source_id} --{r.kind}--> {r.target_id}", caps[4])
    plain_phase(page, lined.where("verification = 0"), "Unresolved", lambda r: f"// {r.source_id} -> {r.target_id}", left)
    if page.left < 0:
        page.lines.append(f"// [token budget exceeded by {-page.left} tokens]")
    return "\n".join(page.lines)


def fixed_cost_prefix(rows: DataFrame, by: str, order: list, budget: int, cost: int = PLAIN) -> DataFrame:
    """F5 over many groups: the first rows of each group, as each costs the same until nothing is left."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= math.ceil(budget / cost))


def with_diff(text: str, hunks: list[dict], max_tokens: int = 12_000, margin: float = 0.15) -> str:
    """M6: a slice's text, then hunks (file, old_text, new_text) as - and + lines as far as the budget of both goes."""
    left, out = render.capacity(max_tokens, margin) - math.ceil(len(text) / 4), [text, "", "// --- Diff ---"]
    for i, h in enumerate(hunks):
        body = "\n".join([f"// {h['file']}", *(f"- {x}" for x in h["old_text"].split("\n")), *(f"+ {x}" for x in h["new_text"].split("\n"))])
        if math.ceil(len(body) / 4) > left:
            out.append(f"// [{len(hunks) - i} more omitted]")
            break
        left -= math.ceil(len(body) / 4)
        out.append(body)
    return "\n".join(out)


def metadata_json(d: dict | None) -> str | None:
    return json.dumps(d, separators=(",", ":")) if d else None
