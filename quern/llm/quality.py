"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters over bytes run along the whole document. Its chunks overlap by half; each filter is
max-pooled within a chunk, and the chunks' values are combined (largest, mean, least) with a logistic
layer into one probability. Filters are trained on a bounded sample of labelled windows by gradient
descent through the pooling, the last layer on whole documents of the same sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import fold, texts

#: Bytes of a chunk (two halves), width of a filter (even), number of filters.
CHUNK, WIDTH, FILTERS = 512, 6, 12


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 * FILTERS
    shift: float

    def pairs(self) -> list[np.ndarray]:
        """The filters as tables over pairs of bytes."""
        f = self.filters
        return [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.shift, -30, 30)))


def pooled(values: list[str], tables: list[np.ndarray], bias: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """For each text: the largest, mean and least chunk value of each filter, over the whole text."""
    half, out = CHUNK // 2, np.zeros((len(values), 3 * len(bias)), np.float32)
    raws = [v.encode("utf-8", "replace") for v in values]
    for i, raw in enumerate(raws):
        halves, n = [], len(raw)
        data = np.frombuffer(raw + bytes(WIDTH), np.uint8)
        for a in range(0, max(n, 1), block):  # memory is bounded however long the text
            part = data[a : min(max(n, 1), a + block) + WIDTH - 1].astype(np.int32)
            two = part[:-1] * 256 + part[1:]
            m = max(len(part) - WIDTH + 1, 1)
            act = tables[0].take(two[:m], axis=0)
            for k in range(1, len(tables)):
                act += tables[k].take(two[2 * k : 2 * k + m], axis=0)
            halves.append(np.maximum.reduceat(act, np.arange(0, m, half), axis=0))
        h = np.maximum(np.concatenate(halves) + bias, 0)
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        out[i] = np.concatenate([chunks.max(0), chunks.mean(0), chunks.min(0)])
    return out


def trained_filters(windows: np.ndarray, y: np.ndarray, steps: int = 160, batch: int = 96, seed: int = 7):
    """Filters and bias, by Adam on the logistic loss of max-pooled windows (rows of bytes)."""
    rng = np.random.default_rng(seed)
    t, b, v, c = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0
    params = [t, b, v, np.array([c])]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(y == k) for k in (0, 1)]
    span = windows.shape[1] - WIDTH + 1
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, batch // 2) for k in by])
        x, want = windows[pick], y[pick]
        act = sum(params[0][k].astype(np.float32)[x[:, k : k + span]] for k in range(WIDTH))
        where = act.argmax(1)
        top = np.take_along_axis(act, where[:, None, :], 1)[:, 0] + params[1]
        h = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-(h @ params[2] + params[3][0])))
        d = (p - want) / len(pick)
        dh = d[:, None] * params[2] * (top > 0)
        grads = [np.zeros_like(t), dh.sum(0), h.T @ d, np.array([d.sum()])]
        rows = np.arange(len(pick))[:, None]
        for k in range(WIDTH):
            np.add.at(grads[0][k], (x[rows, where + k], np.arange(FILTERS)[None, :]), dh)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            params[i] = params[i] - 0.03 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return params[0].astype(np.float32), params[1].astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last for a constant) of a weighted ridge logistic regression, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep @ w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, windows: int = 4) -> Net:
    """The network, from at most `per_class` labelled texts of each class, those whose ids have the
    least hashes, outside the held-out fold. Without both classes it is constant (the mean label, or 1)."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), 4) != 2)
    counts = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        p = 0.999 if 1 in counts or not counts else 0.001
        return Net(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS), float(np.log(p / (1 - p))))
    order = F.xxhash64("doc_id", F.lit(10))
    one = lambda q: rows.where(F.col("quality") == q).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).orderBy(order).limit(per_class)
    chosen = F.broadcast(one(0).unionByName(one(1)).groupBy("doc_id").agg(F.max("y").alias("y")))  # 2 * per_class rows at most
    some = docs.join(chosen, "doc_id")

    def cut(batches):
        for batch in batches:
            ys, out = [], []
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                for a in {int(x) for x in np.linspace(0, max(0, len(raw) - CHUNK), windows)}:
                    ys.append(int(y))
                    out.append(raw[a : a + CHUNK].ljust(CHUNK, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.binary())], ["y", "raw"])

    got = some.select("y", "text").mapInArrow(cut, "y int, raw binary").toPandas()
    got = got.sort_values(["raw", "y"])
    x, y = np.frombuffer(b"".join(got["raw"]), np.uint8).reshape(-1, CHUNK), got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return fit(docs, labels.limit(0))
    filters, bias = trained_filters(x, y)
    net = Net(filters, bias, np.zeros(3 * FILTERS), 0.0)

    def pool(batches):
        tables = net.pairs()
        for batch in batches:
            vectors = pooled(batch.column("text").to_pylist(), tables, bias)
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(list(vectors), pa.list_(pa.float32()))], ["y", "v"])

    found = some.select("y", "text").mapInArrow(pool, "y int, v array<float>").toPandas()
    v, y = np.stack(found["v"]).astype(float), found["y"].to_numpy(float)
    order = np.lexsort(np.c_[y, v].T)  # however the rows are dealt, the sums below are the same
    v, y = v[order], y[order]
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    w = logistic(v, y, weight * len(y) / weight.sum())
    return Net(filters, bias, w[:-1], float(w[-1]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1200) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from `threshold` on).

    Only the text is an input of a score. Null and empty texts are scored as a text of no bytes; a null
    doc_id is not held out unless the crc32 of nothing is; repeated rows are scored each; an empty
    table gives an empty result; labels that are null or neither 0 nor 1 are not learnt from. Whole texts are
    scored, however long; only the filters are learnt from four windows of a labelled text. Of labelled ids with
    the same hash any may be taken."""
    rows = texts(docs)
    net = fit(rows, labels, per_class)

    def run(batches):
        tables = net.pairs()
        for batch in batches:
            score = net.score(pooled(batch.column("text").to_pylist(), tables, net.bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, in all their columns, that the classifier does not reject. Null and empty texts are
    scored as a text of no bytes, repeated rows share their fate, an empty table stays empty; columns of any name stay."""
    net, columns, schema = fit(texts(docs), labels), docs.columns, docs.schema

    def run(batches):
        tables = net.pairs()
        for batch in batches:
            values = [x or "" for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(net.score(pooled(values, tables, net.bias)) >= threshold))

    return docs.mapInArrow(run, schema).select(*columns)
