"""Soft-membership mixing of sources to target weights.

A softmax classifier over hashed words, trained from the labelled table, gives each document the
posterior of each domain. Nonnegative rates, one for each document, are fitted by least squares so that
the expected tokens of the domains match their targets. Where the projected gradient is zero, a rate
depends on the document's posterior and on one multiplier for each domain alone; these few numbers are
found by Newton's method on the dual, each step of which aggregates over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import WordHashes, stored, texts, unused, words_of

#: Domains by (quality, toxic) of the labelled table.
DOMAINS = ("clean", "toxic", "low")
#: Hashed word features.
BITS = 13


def domain() -> Column:
    return F.when(F.col("quality") == 0, 2).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


_hashes = WordHashes()


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets, their values (square roots of shares, so that long texts weigh no more), words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), 0
    counts = np.bincount((_hashes.of(words) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / len(words)), len(words)


def softmax_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: np.ndarray, rounds: int = 200, ridge: float = 1e-6) -> np.ndarray:
    """Weights, one row for each bucket and one for the constant, with classes weighted to `prior`."""
    x = np.zeros((len(rows), (1 << BITS) + 1), np.float32)
    for i, (at, value) in enumerate(rows):
        x[i, at], x[i, -1] = value, 1
    share = np.array([max(1, (y == k).sum()) for k in range(len(prior))])
    weight = (prior / share)[y].astype(np.float32)
    weight /= weight.sum()
    w, m, s = (np.zeros((x.shape[1], len(prior)), np.float32) for _ in range(3))
    want = np.eye(len(prior), dtype=np.float32)[y]
    for step in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((p - want) * weight[:, None]) + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_domain: int = 800) -> np.ndarray:
    """Classifier weights from at most `per_domain` labelled texts of each domain, those whose ids have
    the least hashes. A domain without labelled texts gets a posterior near 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain().alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts:
        return np.zeros(((1 << BITS) + 1, len(DOMAINS)), np.float32)
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(per_domain) for k in sorted(counts)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())], ["doc_id", "y", "at", "value"])

    got = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at binary, value binary").toPandas().sort_values(["doc_id", "y"])
    if got.empty:
        return np.zeros(((1 << BITS) + 1, len(DOMAINS)), np.float32)
    prior = np.array([counts.get(k, 0) for k in range(len(DOMAINS))], float)
    return softmax_fit([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(got["at"], got["value"], strict=True)], got["y"].to_numpy(), prior / prior.sum())


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens (words) and p, the posterior of each domain to three digits, of each row."""

    def run(batches):
        for batch in batches:
            z, n = np.zeros((batch.num_rows, weights.shape[1])), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, value, n[i] = features(text)
                z[i] = value @ weights[at] + weights[-1]
            p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            p = np.round(p / p.sum(1, keepdims=True), 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rate_of(p: Column, multipliers: list[float], ridge: float) -> Column:
    """The rate at which the projected gradient is zero, given the multiplier of each domain."""
    push = sum((F.get(p, F.lit(k)) * float(x) for k, x in enumerate(multipliers)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - push / ridge)


def fitted_rates(found: DataFrame, weights: dict[str, float], ridge: float = 1e-3, close: float = 1e-6, most: int = 200) -> tuple[list[float], list[float]]:
    """The multipliers, and the residuals (tokens over target, less 1), of the least of
    sum_d (tokens_d - target_d)^2 / tokens_d(at rate 1) + ridge * sum tokens * (rate - 1)^2.

    Targets are in proportion to the weights, and the first domain keeps its tokens. Rows with the same
    posterior have the same rate, so the rows that a step reads are first combined by posterior. It is an
    error if the gradient is not within `close` of the targets after `most` steps."""
    cells = stored(found.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("t")).where("t > 0"), "cells")
    n = len(DOMAINS)
    p = [F.get("p", F.lit(k)) for k in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def at(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens of the domains, the products of posteriors over rows with a rate, and the squares of rates."""
        rate = rate_of(F.col("p"), multipliers.tolist(), ridge)
        some = cells.select("p", "t", rate.alias("r")).where("r > 0")
        got = some.agg(*(F.sum(F.col("t") * F.col("r") * x) for x in p), *(F.sum(F.col("t") * p[i] * p[j]) for i, j in pairs), F.sum(F.col("t") * F.col("r") * F.col("r"))).first()
        got = [x or 0.0 for x in got]
        products = np.zeros((n, n))
        for (i, j), x in zip(pairs, got[n:], strict=False):
            products[i, j] = products[j, i] = x
        return np.array(got[:n]), products, got[-1]

    now, x = at(np.zeros(n)), np.zeros(n)
    first = now[0]
    share = np.array([weights[d] for d in DOMAINS])
    target = share / share[0] * first[0]
    scale = np.maximum(first, 1e-9 * max(first.sum(), 1.0))
    use = np.flatnonzero(first > 0)
    bound = close * np.maximum(target, 1e-6 * max(first.sum(), 1.0))
    cost = lambda x, now: 0.5 * (scale * x * x).sum() + target @ x + 0.5 * ridge * now[2]
    for _ in range(most):
        gradient = np.where(first > 0, scale * x + target - now[0], 0.0)
        if (np.abs(gradient) <= bound).all():
            break
        step = np.zeros(n)
        step[use] = np.linalg.solve((np.diag(scale) + now[1] / ridge)[np.ix_(use, use)], -gradient[use])
        size = 1.0
        while True:
            then = at(x + size * step)
            if cost(x + size * step, then) <= cost(x, now) + 1e-4 * size * (gradient @ step) + 1e-12 * abs(cost(x, now)) or size < 1e-6:
                break
            size /= 2
        x, now = x + size * step, then
    else:
        raise RuntimeError(f"the rates did not converge: gradient {gradient.tolist()} for targets {target.tolist()}")
    return x.tolist(), [float(a / b - 1) if b > 0 else 0.0 for a, b in zip(now[0], target, strict=True)]


#: Target token shares of the domains.
TARGETS = {"clean": 0.97, "toxic": 0.01, "low": 0.02}


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, ridge: float = 1e-3) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, p_clean, p_toxic, p_low, rate, copies.

    copies is the rate rounded up or down by the hash of the id, so that its mean over ids is the rate.
    Null and empty texts have no tokens, the posterior of the constant alone, and a rate like any other;
    repeated rows have equal results; an empty table gives an empty result; without labels all domains
    are equally likely and every rate is 1; other columns are left out."""
    rows = texts(docs)
    learnt = fit(rows, labels)
    found = stored(posteriors(rows, learnt), "posteriors")
    rate = rate_of(F.col("p"), fitted_rates(found, weights or TARGETS, ridge=ridge)[0] if learnt.any() else [], ridge)
    out = found.select("doc_id", "n_tokens", *(F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round(rate, 6).alias("rate"))
    coin = F.pmod(F.xxhash64("doc_id", F.lit(55)), F.lit(1_000_000)) / 1_000_000
    return out.withColumn("copies", (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, in all their columns, each as often as mixture() says; rows without doc_id stay.

    Rows that repeat a doc_id with several texts follow the largest number of copies among them; an empty
    table stays empty; columns of any name stay."""
    n, i = (unused(docs, x) for x in ("copies", "copy"))
    copies = mixture(docs, labels, weights).groupBy("doc_id").agg(F.max("copies").alias(n))
    out = docs.join(copies, "doc_id", "left")
    return out.withColumn(i, F.explode(F.array_repeat(F.lit(1), F.coalesce(n, F.lit(1))))).select(*docs.columns)
