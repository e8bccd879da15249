"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, and each decision has its own tree of contexts, the DEPTH bytes
before it. A node keeps the counts of its decision; its Krichevsky-Trofimov estimate and what its
children mix are weighted by how well each coded the training texts. The code length of a text is the
sum over its bytes (A-Z lower-cased) and one end.

Counts are kept as the distinct runs of DEPTH + 1 bytes of each batch of documents, dealt by the two
bytes before the last, so that all contexts below depth 2 meet in one task. Above it there are at most
65,536 contexts and bytes, which are broadcast. A batch asks for its runs and gets their log-probabilities
back, and its words get their counts in the same way, so that no task holds the whole model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import _LOWER, fold, grouped, parts_of, release, stored, texts, tidy, word_hashes

#: Bytes of context, and bytes of text of a batch.
DEPTH, BATCH = 6, 12 << 20
#: Buckets of words and of runs are told apart by sign.
ROWS = "batch long, bucket int, keys binary, counts binary"
HELD = 1


def squeeze(a: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, which packs better than value after value."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).ravel().view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def stretch(b: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def runs_of(raws: list[bytes]) -> np.ndarray:
    """For each byte of each text and its end: the bytes before it, the nearest highest, and itself; all
    texts one after another. Before a text there are zeros, and its end is a zero."""
    data = np.frombuffer(b"".join(bytes(DEPTH) + r + b"\0" for r in raws), np.uint8)
    low = _LOWER[data].astype(np.uint64)
    n = len(low) - DEPTH
    x = np.zeros(max(n, 0), np.uint64)
    for k in range(1, DEPTH + 1):
        x = (x << np.uint64(8)) | low[DEPTH - k : DEPTH - k + n]
    x = (x << np.uint64(8)) | low[DEPTH:]
    sizes = np.array([len(r) + 1 for r in raws])
    ends = np.cumsum(sizes + DEPTH)
    keep = np.ones(n, bool)
    for e in ends[:-1]:
        keep[e - DEPTH : e] = False
    return x[keep]


def keyed(raws: list[bytes], sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some texts, runs or words by sign, and the number of each text's."""
    if sign > 0:
        return runs_of(raws), np.array([len(r) + 1 for r in raws])
    hs, starts = word_hashes(b"\n".join(raws))
    return hs, np.diff(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])))


def counted(raws: list[bytes], train: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts and how many of each are in training texts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for a, b in grouped(raws):
        all_keys, n = keyed(raws[a:b], sign)
        found, at = np.unique(all_keys, return_inverse=True)
        keys.append(found)
        counts.append(np.bincount(at, np.repeat(train[a:b], n), len(found)).astype(np.int32))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def by_bucket(keys: np.ndarray, sign: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct keys by bucket, and each bucket's bounds in it."""
    group = keys >> np.uint64(8 * DEPTH - 8) if sign > 0 else keys
    b = ((group * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def scanned(docs: DataFrame, buckets: int) -> DataFrame:
    """Bucket 0: the batch's texts, with ids, folds and bounds. Buckets above: distinct runs and their
    training counts; below: distinct words."""

    def of(number: int, ids: list, held: list, values: list[str]):
        raws = [v.encode("utf-8", "replace") for v in values]
        yield number, 0, squeeze(np.frombuffer(b"".join(raws), np.uint8)), squeeze(np.array([[-(1 << 63) if i is None else i for i in ids], held, [len(r) for r in raws]], np.int64))
        for sign in (1, -1):
            keys, n = counted(raws, ~np.array(held, bool), sign)
            order, cuts = by_bucket(keys, sign, buckets)
            for k in range(buckets):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    yield number, sign * (k + 1), squeeze(np.diff(keys[at], prepend=np.uint64(0))), squeeze(n[at].astype(np.int32))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, held, values = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
            i = 0
            while i < len(values):
                j, n = i, 0
                while j < len(values) and (j == i or n + len(values[j]) <= BATCH):
                    n += len(values[j])
                    j += 1
                rows = list(of(number, ids[i:j], held[i:j], values[i:j]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["batch", "bucket", "keys", "counts"])
                rows = None
                tidy()
                number, i = number + 1, j

    return docs.mapInArrow(run, ROWS)


def gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket, their counts over all batches, and each batch's keys."""
    parts = [np.cumsum(stretch(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([stretch(c, np.int32) for c in rows["counts"]]), len(keys)), parts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series above 8."""
    shift, x = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x[small] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(n: np.ndarray) -> np.ndarray:
    """Log of the KT probability of sequences with counts n (rows: zeros, ones)."""
    return log_gamma(n[0] + 0.5) + log_gamma(n[1] + 0.5) - np.log(np.pi) - log_gamma(n[0] + n[1] + 1)


def decisions(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes, their eight decisions: nodes (8 rows, 1 to 255) and bits."""
    x = last.astype(np.int64) + 256
    k = np.arange(8, 0, -1)[:, None]
    return x[None, :] >> k, (x[None, :] >> (k - 1)) & 1


class Level:
    """Nodes of one depth: (context, decision) with counts, and log-weights once the deeper depth is known."""

    def __init__(self, contexts: np.ndarray, last: np.ndarray, counts: np.ndarray):
        node, bit = decisions(last)
        names = (contexts.astype(np.uint64)[None, :] << np.uint64(8)) | node.astype(np.uint64)
        self.names, at = np.unique(names.ravel(), return_inverse=True)
        n = np.tile(counts, (8, 1)).ravel()
        self.n = np.stack([np.bincount(at, n * (bit.ravel() == b), len(self.names)) for b in (0, 1)]).astype(float)
        self.own = log_kt(self.n)
        self.all, self.weight = self.own, np.ones(len(self.names))

    def over(self, below: Level | None, parent=None, sums: np.ndarray | None = None) -> None:
        if below is not None:
            sums = np.bincount(np.searchsorted(self.names, parent(below.names)), below.all, len(self.names)).astype(float)
        self.all = np.logaddexp(self.own, sums) - np.log(2)
        self.weight = np.exp(self.own - np.log(2) - self.all)

    def mixed(self, names: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of the bits: the estimate here against what the deeper depths say (nan: nothing)."""
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        if not len(self.names):
            return deeper
        there = self.names[at] == names
        n = self.n[:, at]
        kt = (np.where(bits == 1, n[1], n[0]) + 0.5) / (n.sum(0) + 1)
        w = np.where(np.isnan(deeper), 1.0, self.weight[at])
        return np.where(there, w * kt + (1 - w) * np.nan_to_num(deeper), np.nan)


def levels(keys: np.ndarray, counts: np.ndarray, first: int = 2) -> dict[int, Level]:
    use = counts > 0
    keys, counts = keys[use], counts[use]
    found = {d: Level(keys >> np.uint64(8 * (DEPTH - d) + 8), keys & np.uint64(255), counts) for d in range(DEPTH, first - 1, -1)}
    for d in range(DEPTH - 1, first - 1, -1):
        found[d].over(found[d + 1], lambda names: (names >> np.uint64(16) << np.uint64(8)) | (names & np.uint64(255)))
    return found


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte (code length over the bytes and the end).

    Learns from documents outside the held-out fold. Null and empty texts are an end alone. A null doc_id
    stays null and its fold is that of no text; repeated rows are learnt from and scored each; with no
    training document, the model is uniform over bytes; an empty table gives an empty result; other
    columns are left out."""
    rows = texts(docs, id_col, text_col).select("doc_id", (fold(F.col("doc_id"), 5) == HELD).alias("held_out"), "text")
    buckets = parts_of(rows, 8)
    table = stored(scanned(rows, buckets), "batches")
    runs, words = table.where("bucket > 0"), table.where("bucket < 0")

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """What is above depth 2: counts of (byte before, byte), and what depth 2 says of each decision."""
        keys, counts, _ = gathered(part)
        two = levels(keys, counts)[2]
        place = ((keys >> np.uint64(8 * DEPTH)).astype(np.int64) << 8) | (keys & np.uint64(255)).astype(np.int64)
        pairs = np.bincount(place, counts, 65536)
        said = np.bincount(((two.names >> np.uint64(16) << np.uint64(8)) | (two.names & np.uint64(255))).astype(np.int64), two.all, 65536)
        at = np.flatnonzero((pairs > 0) | (said != 0))
        return pd.DataFrame({"k": at, "n": pairs[at], "said": said[at]})

    above = runs.groupBy("bucket").applyInPandas(top, "k int, n double, said double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("said").alias("said")).toPandas()  # 65,536 rows at most
    counts, said = np.zeros(65536), np.zeros(65536)
    counts[above["k"]], said[above["k"]] = above["n"], above["said"]
    at = np.flatnonzero(counts)
    one = Level(at >> 8, at & 255, counts[at])
    one.over(None, sums=said[one.names.astype(np.int64)])
    zero = Level(np.zeros(len(at), np.int64), at & 255, counts[at])
    zero.over(one, lambda names: names & np.uint64(255))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((one, zero))

    def priced(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys, counts, parts = gathered(part)
        tree = levels(keys, counts)
        tree[1], tree[0] = shared.value
        node, bits = decisions(keys & np.uint64(255))
        total = np.zeros(len(keys))
        for j in range(8):
            p = np.full(len(keys), np.nan)
            for d in range(DEPTH, -1, -1):
                context = keys >> np.uint64(8 * (DEPTH - d) + 8) if d else np.zeros(len(keys), np.uint64)
                p = tree[d].mixed((context << np.uint64(8)) | node[j].astype(np.uint64), bits[j], p)
            total += np.log10(np.where(np.isnan(p), 0.5, p))
        del tree
        tidy()
        return pd.DataFrame([(b, k, squeeze(total[np.searchsorted(keys, p)].astype(np.float32))) for b, k, p in zip(part["batch"], part["bucket"], parts, strict=True)], columns=["batch", "bucket", "values"])

    def known(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys, counts, parts = gathered(part)
        return pd.DataFrame([(b, k, squeeze(counts[np.searchsorted(keys, p)].astype(np.int64))) for b, k, p in zip(part["batch"], part["bucket"], parts, strict=True)], columns=["batch", "bucket", "values"])

    def totals(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, counts, _ = gathered(part)
        return pd.DataFrame({"n": [counts.sum()], "v": [(counts > 0).sum()]})

    told = words.groupBy("bucket").applyInPandas(totals, "n double, v long").agg(F.sum("n"), F.sum("v")).first()
    release(rows.sparkSession)
    ends = rows.where(~F.col("held_out")).count()  # each training text has one end
    n_train, distinct = int(told[0] or 0) + ends, int(told[1] or 0) + (ends > 0)
    reply = "batch long, bucket int, values binary"
    answers = stored(runs.groupBy("bucket").applyInPandas(priced, reply).unionByName(words.groupBy("bucket").applyInPandas(known, reply)), "answers")
    release(rows.sparkSession)
    whole = stored(table.where("bucket = 0"), "texts")
    release(rows.sparkSession, table)  # the keys are done with before answers and texts move to their batches
    # A batch finds its distinct keys again from its texts, in the same order, so no key travels back.
    everything = answers.select("batch", "bucket", F.col("values").alias("a"), F.lit(None).cast("binary").alias("b")).unionByName(whole.select("batch", "bucket", F.col("keys").alias("a"), F.col("counts").alias("b")))

    def score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lone = part[part["bucket"] == 0].iloc[0]
        data, (ids, held, sizes) = stretch(lone["a"], np.uint8).tobytes(), stretch(lone["b"], np.int64).reshape(3, -1)
        ends_at = np.cumsum(sizes)
        raws = [data[e - s : e] for e, s in zip(ends_at, sizes, strict=True)]

        bottom = n_train + 0.5 * (distinct + 1)

        def sums(sign: int, kind, *measures) -> list[np.ndarray]:
            """For each text the sums of what the measures make of the answers to its keys."""
            kept, names = [], []
            for a, b in grouped(raws):
                keys, n = keyed(raws[a:b], sign)
                own, at = np.unique(keys, return_inverse=True)
                kept.append((at.astype(np.int32), n))
                names.append(own)
            found = np.unique(np.concatenate(names))
            names = [np.searchsorted(found, own).astype(np.int32) for own in names]
            order, cuts = by_bucket(found, sign, buckets)
            values = np.zeros(len(found), kind)
            for r in part[part["bucket"] * sign > 0].itertuples():
                values[order[cuts[abs(r.bucket) - 1] : cuts[abs(r.bucket)]]] = stretch(r.a, kind)
            del order, found
            out = [np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), f(values[own])[at], len(n)) for own, (at, n) in zip(names, kept, strict=True)]) for f in measures]
            tidy()
            return out

        value = sums(1, np.float32, lambda x: x.astype(np.float64))[0]
        n, hit, base = sums(-1, np.int64, np.ones_like, lambda x: x > 0, lambda x: np.log10((x + 0.5) / bottom))
        end = float(np.log10((ends + 0.5) / bottom))
        return pd.DataFrame({"doc_id": pd.array([None if i == -(1 << 63) else i for i in ids.tolist()], "Int64"), "held_out": held.astype(bool), "n_tokens": n.astype(np.int64) + 1, "n_known": hit.astype(np.int64) + (ends > 0), "train_tokens": n_train, "base_score": base + end, "score": value, "bits_per_byte": -value / np.log10(2) / (sizes + 1)})

    return everything.groupBy("batch").applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
