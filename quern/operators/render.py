"""Budgets of rendering: allocation, cuts in order, greedy fits, diffs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import budget_tokens, render_tokens

#: Budget shares (fixed values): entry source, entry edges, other source, other edges, routes.
SHARES = {
    "minimal": (0.40, 0.20, 0.20, 0.15, 0.05),
    "function_edit": (0.30, 0.10, 0.45, 0.10, 0.05),
    "endpoint_edit": (0.20, 0.20, 0.20, 0.30, 0.10),
    "schema_edit": (0.15, 0.15, 0.15, 0.45, 0.10),
    "impact": (0.15, 0.35, 0.10, 0.35, 0.05),
    "balanced": (0.30, 0.20, 0.30, 0.15, 0.05),
    "source-first": (0.40, 0.10, 0.35, 0.10, 0.05),
    "edges-first": (0.15, 0.35, 0.10, 0.35, 0.05),
}
#: Changes of the shares under 2,000 tokens, and their bounds (fixed values).
SMALL = ((0.20, 0, 0.50), (0.10, 0, 0.35), (-0.15, 0.05, 1), (-0.10, 0.05, 1), (-0.05, 0.01, 1))


def allocation(policy: str, mode: str | None = None, max_tokens: int = 12_000, profile: dict[str, float] | None = None) -> tuple[float, ...]:
    """The shares of the mode, else of the policy, moved by a profile, normalised; tilted to the
    entry when small."""
    shares = SHARES.get(mode or policy, SHARES["impact"])
    shares = profiled(shares, profile) if profile else tuple(x / sum(shares) for x in shares)
    if max_tokens < 2000:
        shares = tuple(min(high, max(low, x + by)) for x, (by, low, high) in zip(shares, SMALL, strict=True))
    return shares


def phase_caps(policy: str, max_tokens: int, mode: str | None = None) -> list[int]:
    """M3."""
    return [math.floor((max_tokens - 50) * x) for x in allocation(policy, mode, max_tokens)]


def capacity(max_tokens: int, margin: float = 0.25) -> int:
    """M5."""
    return math.floor(max_tokens * (1 - margin))


#: Changes of the shares by a project's profile (fixed values): what exceeds what moves which shares.
PROFILE = (("edge_density", 20, (-0.05, 0.05, -0.05, 0.05, 0)), ("average_lines", 500, (0.05, -0.05, 0.05, -0.05, 0)), ("containers", 30, (0.05, 0, -0.05, 0, 0)))


def profiled(shares: tuple[float, ...], profile: dict[str, float]) -> tuple[float, ...]:
    """M1: shares moved by a profile, those moved kept within 0.05 and 0.6, then normalised."""
    moved = list(shares)
    for key, above, deltas in PROFILE:
        if profile.get(key, 0) > above:
            moved = [m + d for m, d in zip(moved, deltas, strict=True)]
    kept = [m if m == s else min(0.6, max(0.05, m)) for m, s in zip(moved, shares, strict=True)]
    return tuple(x / sum(kept) for x in kept)


def edges_within(edges: DataFrame, by: str, cap: int, text_of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """For each value of `by` the edges in order of tier whose costs fit, and how many remain
    after each; a section title costs 5, a line at least 3.

    So no more than cap / 3 can fit: the first of each group are ranked before costs are added up, which Spark
    does in each task before it shuffles, and the sizes of the groups come from a partial aggregate. No task
    holds all edges of a hub. Ids may be short codes that sort as their texts (`text_of`): those are made of the
    first of each group only, so that a task sorts numbers."""
    text = F.concat_ws(" ", text_of(F.col("source_id")), "kind", text_of(F.col("target_id")))
    shown = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit(" ..."))).otherwise(text)
    order = Window.partitionBy(by).orderBy(F.desc("verification"), "kind", "source_id", "target_id")
    first = edges.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= cap // 3 + 1)
    costed = first.withColumn("line", shown).withColumn("cost", F.greatest(F.lit(3), render_tokens(F.col("line"))))
    spent = costed.withColumn("spent", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 5).where(F.col("spent") <= cap)
    sizes = edges.groupBy(F.col(by).alias("by__")).agg(F.count("*").alias("n__"))
    return spent.join(sizes, F.col(by).eqNullSafe(F.col("by__"))).withColumn("remaining", F.col("n__") - F.col("rk")).drop("by__", "n__", "rk")


def greedy_fit(items: DataFrame, by: str, order: str, cost: str, cap: int) -> DataFrame:
    """items in order; one that does not fit is skipped and the scan goes on: what is spent and how many
    are kept in each group. Groups stream in order, and a running total is all that is held."""
    import pyarrow as pa

    kind = items.select(by).schema[0].dataType
    name = kind.simpleString()

    def run(batches):
        now, spent, kept, began = None, 0, 0, False
        for batch in batches:
            out = []
            for g, c in zip(batch.column(by).to_pylist(), batch.column("cost").to_pylist(), strict=True):
                if began and g != now:
                    out.append((now, spent, kept))
                    spent = kept = 0
                now, began = g, True
                if c is not None and spent + c <= cap:
                    spent, kept = spent + c, kept + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((batch.schema.field(by).type, pa.int64(), pa.int64()))], [by, "spent", "n_kept"])
            last = batch.schema.field(by).type
        if began:
            yield pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([spent], pa.int64()), pa.array([kept], pa.int64())], [by, "spent", "n_kept"])

    rows = items.select(by, order, F.col(cost).cast("long").alias("cost")).where(F.col("cost") <= cap)
    lost = items.select(by).distinct()
    found = rows.repartition(F.col(by)).sortWithinPartitions(by, order).select(by, "cost").mapInArrow(run, f"`{by}` {name}, spent long, n_kept long")
    done = lost.join(found.withColumnRenamed(by, "by__"), F.col(by).eqNullSafe(F.col("by__")), "left")
    return done.select(by, F.coalesce("spent", F.lit(0)).alias("spent"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def render_diff(hunks: DataFrame, max_tokens: int = 1000, margin: float = 0.15) -> DataFrame:
    """For each file its hunks as - and + lines, as far as the budget goes, then how many are left out.
    Hunks need file, ord, old_text and new_text."""
    mark = lambda c, sign: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), x)), "\n")
    rows = hunks.withColumn("body", F.concat_ws("\n", mark(F.col("old_text"), "- "), mark(F.col("new_text"), "+ ")))
    order = Window.partitionBy("file").orderBy("ord")
    rows = rows.withColumn("spent", F.sum(budget_tokens(F.col("body"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("spent") <= capacity(max_tokens, margin)
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("ord", "body")))), lambda x: x["body"]), "\n").alias("text"), F.count_if(~fits).alias("omitted"))
