"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Distinct vectors are dealt to shards by their length and hash. A shard's vectors get one more coordinate, so that
all are equally long and the largest inner product is the least distance. Its graph grows in batches:
greedy beam searches from the entry propose neighbours, and relaxed distance pruning keeps the near and
diverse ones; reverse edges are added and pruned alike. Queries, in blocks, search every shard's graph
by beam; the best of all shards are ranked by the exact inner product of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import stored

#: Vectors of a shard, out-degree, width of the build's and of the query's beam, pruning factor, queries of a block.
SHARD, DEGREE, BUILD, BEAM, ALPHA, BLOCK = 8192, 32, 80, 64, 1.2, 1024


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the `width` nearest nodes found (-1 if fewer) and their squared distances; and how many
    distances to nodes were taken for all of them."""
    n, m = len(x), len(q)
    norm = (x * x).sum(1)
    ids, d = np.full((m, width), -1), np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], done[:, 0] = entry, False
    d[:, 0] = norm[entry] - 2 * (q @ x[entry])
    seen[:, entry] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        pick = np.where(done[live], np.inf, d[live]).argmin(1)
        todo = ~done[live, pick]
        live, pick = live[todo], pick[todo]
        if not len(live):
            break
        done[live, pick] = True
        near = graph[ids[live, pick]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(fresh, near, 0)
        dist = norm[near] - 2 * np.einsum("mrd,md->mr", x[near], q[live])
        dist = np.where(fresh, dist, np.inf).astype(np.float32)
        all_d = np.concatenate([d[live], dist], 1)
        top = np.argpartition(all_d, width - 1, 1)[:, :width]
        rows = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)[rows, top]
        done[live] = np.concatenate([done[live], ~fresh], 1)[rows, top]
        d[live] = all_d[rows, top]
    return np.where(np.isfinite(d), ids, -1), d, int(seen[:, :n].sum())


def robust_prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The candidates kept: each the nearest left, which takes away those that it is nearer to by alpha."""
    c = np.unique(candidates[(candidates >= 0) & (candidates != p)])
    if not len(c):
        return c
    v = x[c]
    to_p = ((v - x[p]) ** 2).sum(1)
    order = np.argsort(to_p, kind="stable")
    c, v, to_p = c[order], v[order], to_p[order]
    sq = (v * v).sum(1)
    among = sq[:, None] + sq[None, :] - 2 * v @ v.T
    left, out = np.ones(len(c), bool), []
    while left.any() and len(out) < degree:
        i = int(left.argmax())
        out.append(i)
        left &= alpha * alpha * among[i] > to_p
        left[i] = False
    return c[out]


def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """(graph, entry): neighbours of each node, -1 where there are fewer than `degree`. While it grows, a
    node may hold twice as many, so that it is pruned once for many reverse edges; in the end all are pruned."""
    n, room = len(x), 2 * degree
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, room), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]]
    a = 1
    while a < n:
        batch = order[a : a + max(1, min(256, a))]  # batches grow with the graph
        found, _, _ = beam_search(x, graph, x[batch], entry, min(width, n))
        incoming: dict[int, list[int]] = {}
        for p, near in zip(batch.tolist(), found, strict=True):
            kept = robust_prune(x, p, np.r_[near, batch if len(batch) < 16 else batch[:0]], degree, alpha)
            graph[p, : len(kept)] = kept
            for k in kept.tolist():
                incoming.setdefault(k, []).append(p)
        for k, new in incoming.items():
            have = graph[k][graph[k] >= 0]
            both = np.union1d(have, new)
            kept = both if len(both) <= room else robust_prune(x, k, both, degree, alpha)
            graph[k] = -1
            graph[k, : len(kept)] = kept
        a += len(batch)
    for k in np.flatnonzero((graph >= 0).sum(1) > degree).tolist():
        kept = robust_prune(x, k, graph[k], degree, alpha)
        graph[k] = -1
        graph[k, : len(kept)] = kept
    return graph[:, :degree], entry


def valid(column: str):
    v = F.col(column)
    ok = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return v.isNotNull() & F.forall(v, ok) & F.exists(v, lambda e: e != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its k nearest others by
    inner product, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Vectors
    of different lengths never meet: each query gets results of its own length. Of several vectors of one id
    the least counts. Equal vectors are one node; its k + 1 least ids, of which no more can be among k results,
    stand for it. An empty table gives an empty result; other columns are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda e: e.cast("double") + 0.0).alias("v")).where(valid("v") & F.col("vec_id").isNotNull())
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.withColumn("i", place).where(F.col("i") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(least.withColumn("h", F.xxhash64("v")).withColumn("dim", F.size("v")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        v = np.stack(part["v"]).astype(np.float64)
        sq = (v * v).sum(1)
        x = np.c_[v, np.sqrt(np.maximum(sq.max() - sq, 0))].astype(np.float32)
        graph, entry = build(x)
        ids = np.full((len(v), k + 1), -1)
        for i, some in enumerate(part["ids"]):
            ids[i, : len(some)] = some
        return pd.DataFrame([(int(key[0]), int(key[1]), entry, v.tobytes(), x.tobytes(), graph.astype(np.int32).tobytes(), ids.astype(np.int64).tobytes())], columns=["dim", "shard", "entry", "v", "x", "graph", "ids"])

    schema = "dim int, shard int, entry int, v binary, x binary, graph binary, ids binary"
    graphs = stored(nodes.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(grow, schema), "graphs")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("dim", F.size("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), int(key[1]), part["vec_id"].to_numpy(np.int64).tobytes(), np.stack(part["v"]).astype(np.float64).tobytes())], columns=["dim", "block", "qids", "q"])

    packed = asked.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, qids binary, q binary")
    # Each block of the stated query set meets each shard. A shard's graph goes to a few tasks once, ahead of the
    # blocks of each, which stream past it: a task holds one graph and one block.
    slots = min(blocks, max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // shards)))
    empty = F.lit(None).cast("binary")
    told = graphs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select("dim", "shard", "slot", F.lit(-1).alias("block"), "entry", "v", "x", "graph", "ids", empty.alias("qids"), empty.alias("q"))
    posed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", F.pmod("block", F.lit(slots)).cast("int").alias("slot"), "block", F.lit(0).alias("entry"), *(empty.alias(c) for c in ("v", "x", "graph", "ids")), "qids", "q")
    met = told.unionByName(posed).repartition(shards * slots, "dim", "shard", "slot").sortWithinPartitions("dim", "shard", "slot", "block")

    def look(parts):
        held = None
        for part in parts:
            for r in part.itertuples():
                if r.block < 0:
                    v, x = np.frombuffer(r.v).reshape(-1, r.dim), np.frombuffer(r.x, np.float32).reshape(-1, r.dim + 1)
                    held = (r.dim, r.shard, r.slot), v, x, np.frombuffer(r.graph, np.int32).reshape(len(v), -1), np.frombuffer(r.ids, np.int64).reshape(len(v), -1), r.entry
                    continue
                if held is None or held[0] != (r.dim, r.shard, r.slot):
                    continue  # the shard has no vector of this length
                _, v, x, graph, ids, entry = held
                qids, q = np.frombuffer(r.qids, np.int64), np.frombuffer(r.q).reshape(-1, r.dim)
                for a in range(0, len(q), 256):
                    some, names = q[a : a + 256], qids[a : a + 256]
                    found, _, _ = beam_search(x, graph, np.c_[some, np.zeros(len(some))].astype(np.float32), entry, min(BEAM, len(x)))
                    score = np.where(found >= 0, np.einsum("mrd,md->mr", v[found], some), -np.inf)
                    near = np.where((found >= 0)[:, :, None], ids[found], -1).reshape(len(some), -1)
                    score = np.repeat(score, ids.shape[1], 1)
                    score = np.where((near >= 0) & (near != names[:, None]), score, -np.inf)
                    order = np.lexsort((near, -score), axis=1)[:, :k]
                    at = np.arange(len(some))[:, None]
                    s, n = score[at, order], near[at, order]
                    good = np.isfinite(s)
                    yield pd.DataFrame({"query_id": np.repeat(names, good.sum(1)), "vec_id": n[good], "score": s[good]})

    columns = ["dim", "shard", "slot", "block", "entry", "v", "x", "graph", "ids", "qids", "q"]
    got = met.select(columns).mapInPandas(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
