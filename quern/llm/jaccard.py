"""Exact Jaccard self-join of documents on word shingles, as a join in a metric space.

Jaccard distance is a metric, so pivots and the triangle inequality decide which documents can be near.

1. Vertices are the distinct shingle sets, named by 128-bit digests. Each set gives its prefix: in an
   order of all shingles that puts frequent ones last, so many first shingles that two sets within the
   distance share one of them. All sets that share a prefix shingle fall to a pivot, the holder with the
   least hash: the finite part of the pivot's Voronoi region, since sets that share nothing with it are at
   distance 1. Overlapping regions replicate their boundary sets.
2. Each vertex has a sketch, the parities of its shingles by hash: two or four bits a shingle, whose Hamming
   distance is never above the size of the symmetric difference. It gives a lower bound of every distance,
   and whole sets are read only for what it can't rule out. Sets within the distance of their pivot are its
   ball, and linked with it.
3. Of a ball, only the window that the triangle inequality leaves within reach of a set outside meets the
   region's other sets; members of one ball never meet, as their pivot connects them. A large rest of a
   region is dealt anew, by further pivots of its own and the windows about them, until what is left is
   small; then sketches pick the members that may have a partner, and these are joined exactly.
4. Components of the links are found with every round stored in the shared folder.

A batch sends each shingle once, with the least holder of the batch, so that a shingle that a third of
all documents hold sends one row a batch. The order of the shingles only decides the cost, not the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import MIX, dealt, grouped, mixed, parts_of, release, stored, texts, words_by_text

#: Shingles that the common order ranks by frequency; beyond so many they count as rare, which costs
#: time only. And the local count in a batch from which a shingle is counted at all.
FREQUENT, OFTEN = 1 << 17, 2
#: Holders of a shingle in a batch beyond which it sends one row and not all.
HOT = 8
#: Members of a region that one task joins exactly, or compares by sketches; beyond the latter, a region's
#: rest is dealt anew by about PIVOTS further pivots a round, as long as that makes it smaller.
LEAF, WIDE, PIVOTS = 512, 2048, 32
#: Members up to which a region shares a task's group with others, for speed.
SMALL = 64
#: Vertices whose texts are picked by a broadcast of their ids (24 bytes each); more are picked by a shuffled join.
FEW = 1 << 20
NULL_ID = -(1 << 63)
ROWS = 5000


def shingle_sets(values: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `width` words; of the whole text
    if it has fewer."""
    out = []
    for i, j in grouped(values):
        h, bounds = words_by_text(values[i:j])
        runs = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width):
            runs = runs * MIX + h[k : len(h) - width + 1 + k]
        runs = mixed(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            else:
                x = np.full(min(1, b - a), b - a, np.uint64)
                for w in h[a:b]:
                    x = x * MIX + w
                out.append(mixed(x))
    return out


def digest(s: np.ndarray) -> bytes:
    """The vertex of a set: a 128-bit hash of its shingles."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """The parities of the set's shingles by their low bits: a power of two of bits, two for each shingle at least."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of a from those of b: at most the sizes of the symmetric differences."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def folded(rows: np.ndarray) -> np.ndarray:
    """Sketches of half the length: the same as if they had been made so."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> tuple[float, bool]:
    """A lower bound of the distance of two sets by their sketches and sizes, and whether they may link."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    common = min(n, m, (n + m - int(np.bitwise_count(x ^ y).sum())) // 2)
    return distance(common, n, m), bool(linked(common, n, m, percent))


def needed(n, percent: int):
    """Common shingles that a set of n must have with any set that it links to."""
    return -(-percent * n // 100)


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def distance(common, n, m):
    return 1 - common / (n + m - common)


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts, from all batches in which they are common."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                sets = shingle_sets(list(set(whole.column("text").slice(a, ROWS).to_pylist())), width)  # copies say nothing
                keys, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
                keys, n = keys[n >= OFTEN], n[n >= OFTEN]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    counts = stored(docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "counts")
    # From how many on the shingles are no more than FREQUENT; so only these go to the driver.
    often, least, total = F.least("n", F.lit(1 << 16)), 1 << 16, 0
    for r in counts.groupBy(often.alias("n")).count().orderBy(F.desc("n")).collect():  # 65,536 rows at most
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["n"]
    got = counts.where(F.col("n") >= least).limit(FREQUENT).toPandas()
    release(docs.sparkSession, counts)
    keys = got["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def prefix(s: np.ndarray, keys: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    size = len(s) - needed(len(s), percent) + 1
    if not len(keys):
        return s[:size]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    weight = np.where(keys[at] == s, counts[at], 0)
    if not weight.any():
        return s[:size]
    return s[np.lexsort((s, weight))[:size]]


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that link are in the same or in neighbouring classes."""
    return (np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.uint64) & np.uint64(255)


BATCHES = "batch long, bucket int, keys binary, low binary, sizes binary, docs binary, hot_keys binary, hot_sizes binary, hot_docs binary"


def scanned(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """For each batch of at most ROWS documents: in bucket -1 all of them (keys: vertices, low: sketches of
    the distinct ones, sizes: set sizes, docs: ids), and in each other bucket its prefix shingles with their holders' size class (48 and
    8 bits, in keys and low), their numbers of holders (sizes) and the holders (docs, as places in the batch; of a hot shingle the
    least alone, and all of them in the hot columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))  # FREQUENT entries at most
    names = [x.split()[0] for x in BATCHES.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def rows_of(number: int, ids: list, values: list[str]):
        sets = shingle_sets(values, width)
        vertices = [digest(s) for s in sets]
        sizes = np.array([len(s) for s in sets], np.int64)
        first: dict[bytes, int] = {}
        for i, v in enumerate(vertices):
            first.setdefault(v, i)
        one = np.array([i for i in first.values() if sizes[i]], np.int64)
        drawn = {vertices[i]: sketch(sets[i]) for i in one.tolist()}  # of copies in a batch only the first carries the sketch
        yield (number, -1, b"".join(vertices), b"".join(drawn.pop(v, b"") for v in vertices), sizes.tobytes(), np.array([NULL_ID if i is None else i for i in ids], np.int64).tobytes(), b"", b"", b"")
        if not len(one):
            return
        cuts = [prefix(sets[i], *shared.value, percent) for i in one.tolist()]
        flat, owner = np.concatenate(cuts) >> np.uint64(16) << np.uint64(8), np.repeat(one, [len(c) for c in cuts])
        flat |= size_class(sizes, percent)[owner]
        order = np.lexsort((mixed((np.uint64(number) << np.uint64(16)) + owner.astype(np.uint64)), flat))
        flat, owner = flat[order], owner[order].astype("<u2")
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        ends = np.r_[starts, len(flat)]
        held = np.diff(ends)
        hot = held > HOT
        for b, ks, at in dealt(flat[starts] << np.uint64(8), buckets, np.arange(len(starts))):
            ks = ks >> np.uint64(8)
            i, j = ends[at[0]], ends[at[-1] + 1]
            h = hot[at]
            each = np.repeat(h, held[at])
            lead = np.isin(np.arange(i, j), starts[at])
            yield (number, b, (ks >> np.uint64(24)).astype("<u4").tobytes(), (ks << np.uint64(8)).astype("<u4").tobytes(), held[at].astype("<u2").tobytes(), owner[i:j][~each | lead].tobytes(), ks[h].tobytes(), held[at][h].astype("<u2").tobytes(), owner[i:j][each].tobytes())

    def run(batches):
        from pyspark import TaskContext

        number, out = TaskContext.get().partitionId() << 20, []
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                out += rows_of(number, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                number += 1
                for k in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256], strict=True), types, strict=True)], names)
                out = []

    return docs.mapInArrow(run, BATCHES)


def pivots(batches: DataFrame) -> DataFrame:
    """Two kinds of rows. Without key: the set x of a batch falls to the pivot p; more: some shared shingle
    has further holders. With key: p is a pivot of that hot shingle and size class of the batch x. Sets
    are named by batch and place in it. A shingle has a region for each size class, of the sets of that
    class and the one below, so that no two sets whose sizes rule out a link meet for nothing."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in rows.itertuples():
            k = (np.frombuffer(r.keys, "<u4").astype(np.uint64) << np.uint64(24)) | (np.frombuffer(r.low, "<u4").astype(np.uint64) >> np.uint64(8))
            held = np.frombuffer(r.sizes, "<u2").astype(np.int64)
            each = np.where(held > HOT, 1, held)
            parts.append((np.repeat(k, each), (np.int64(r.batch) << 16) + np.frombuffer(r.docs, "<u2"), np.repeat(held, each)))
        own, name, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # Shingles that one set alone holds, the great majority, go at once.
        order = np.argsort(own, kind="stable")
        own, name, held = own[order], name[order], held[order]
        shingle = own >> np.uint64(8)
        same = shingle[1:] == shingle[:-1]
        use = np.r_[same, False] | np.r_[False, same] | (held > 1)
        own, name, held = (np.tile(c[use], 2) for c in (own, name, held))
        region = own.copy()
        region[len(own) // 2 :] += np.uint64(1)
        order = np.lexsort((mixed(name.view(np.uint64)), region))
        own, name, held, region = own[order], name[order], held[order], region[order]
        first = np.r_[True, region[1:] != region[:-1]][: len(region)]
        starts, group = np.flatnonzero(first), np.cumsum(first) - 1
        pivot = name[starts][group]
        hot = held > HOT
        count = np.add.reduceat(np.where(hot, held, 1), starts)[group] if len(starts) else held
        pairs, at = np.unique(np.c_[name, pivot][~first], axis=0, return_inverse=True)
        more = np.zeros(len(pairs), bool)
        np.logical_or.at(more, at.ravel(), count[~first] > 2)
        plain = pd.DataFrame({"x": pairs[:, 0], "p": pairs[:, 1], "key": pd.array([None] * len(pairs), "Int64"), "more": more})
        lists = pd.DataFrame({"x": name[hot] >> 16, "p": pivot[hot], "key": pd.array(own[hot].astype(np.int64), "Int64"), "more": True})
        return pd.concat([plain, lists], ignore_index=True) if len(lists) else plain

    return batches.where("bucket >= 0").select("batch", "bucket", "keys", "low", "sizes", "docs").groupBy("bucket").applyInPandas(run, "x long, p long, key long, more boolean")


def members(batches: DataFrame, known: DataFrame) -> DataFrame:
    """(x, p, n, m, more): the vertices of each pivot's region, without the pivot, and the two set sizes."""

    def hot(them):
        for t in them:
            out = []
            for number, keys, sizes, docs in zip(*(t.column(c).to_pylist() for c in ("batch", "hot_keys", "hot_sizes", "hot_docs")), strict=True):
                sizes = np.frombuffer(sizes, "<u2")
                out.append(np.c_[np.full(sizes.sum(), number), np.repeat(np.frombuffer(keys, np.int64), sizes), (number << 16) + np.frombuffer(docs, "<u2").astype(np.int64)])
            both = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(3)], ["batch", "key", "h"])

    chosen = stored(pivots(batches), "pivots")
    lists = batches.where("bucket >= 0 and length(hot_keys) > 0").select("batch", "hot_keys", "hot_sizes", "hot_docs").mapInArrow(hot, "batch long, key long, h long")
    told = chosen.where("key is not null").select(F.col("x").alias("batch"), "key", "p")
    both = chosen.where("key is null").select("x", "p", "more").unionByName(lists.join(told, ["batch", "key"]).select(F.col("h").alias("x"), "p", F.lit(True).alias("more")))
    both = both.where("x != p").groupBy("x", "p").agg(F.max("more").alias("more"))
    named = both.join(known.select(F.col("h").alias("x"), F.col("v").alias("vx"), F.col("n_shingles").alias("n")), "x").join(known.select(F.col("h").alias("p"), F.col("v").alias("vp"), F.col("n_shingles").alias("m")), "p")
    return named.where("vx != vp").groupBy(F.col("vx").alias("x"), F.col("vp").alias("p")).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("more").alias("more"))


def sets_of(docs: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(v, s): the shingle set of each vertex of names, whose doc_id is one document that has it; twice if
    that row is there twice, which does no harm. Where that doc_id is null, the set is one of the rows
    without doc_id, once."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            found = [digest(s) for s in sets]
            rows = [i for i, (v, d) in enumerate(zip(batch.column("v").to_pylist(), found, strict=True)) if v is None or v == d]
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in rows], pa.binary()), pa.array([sets[i].tobytes() for i in rows], pa.binary())], ["v", "s"])

    kind = "v binary, s binary"
    small = F.broadcast if names.count() <= FEW else lambda df: df
    known = docs.join(small(names.where("doc_id is not null")), "doc_id").select("v", "text").mapInArrow(run, kind)
    lone = docs.where("doc_id is null").select("text").distinct().select(F.lit(None).cast("binary").alias("v"), "text").mapInArrow(run, kind)
    lone = lone.join(small(names.where("doc_id is null").select("v")), "v", "left_semi").dropDuplicates(["v"])
    return known.unionByName(lone)


def bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(x, p, d, may, more): a lower bound of the distance of each pair, by sketches, and whether it may link."""

    def run(batches):
        for b in batches:
            got = [may_link(*r, percent) for r in zip(*(b.column(c).to_pylist() for c in ("s", "t", "n", "m")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("p"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_()), b.column("more")], ["x", "p", "d", "may", "more"])

    own = pairs.join(sketches.select(F.col("v").alias("x"), F.col("k").alias("s")), "x").join(sketches.select(F.col("v").alias("p"), F.col("k").alias("t")), "p")
    return own.select("x", "p", "s", "t", "n", "m", "more").mapInArrow(run, "x binary, p binary, d double, may boolean, more boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, p, d, near) for the pairs (x, p), by the whole sets."""

    def run(batches):
        for b in batches:
            d, near = [], []
            for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                d.append(distance(common, len(s), len(t)))
                near.append(bool(linked(common, len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("p"), pa.array(d, pa.float64()), pa.array(near, pa.bool_())], ["x", "p", "d", "near"])

    own = pairs.select("x", "p").join(sets.select(F.col("v").alias("x"), "s"), "x").join(sets.select(F.col("v").alias("p"), F.col("s").alias("t")), "p")
    return own.select("x", "p", "s", "t").mapInArrow(run, "x binary, p binary, d double, near boolean")


def forest(links: list[tuple]) -> list[tuple]:
    """Links that join the same components, each to its least member: fewer than there are members."""
    root: dict = {}

    def top(v):
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = root[v]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [(top(v), v) for v in list(root) if top(v) != v]


def joined_region(names: list, sets: list[np.ndarray], percent: int, core: np.ndarray | None = None) -> list[tuple]:
    """Links that connect what the links of the region connect, by recursive pivots; those between two
    members of the core are left out.

    A pivot is linked with all its partners and leaves. A partner also leaves when no other member is
    within reach of it by the triangle inequality. The rest splits at its median distance, with those
    within the join's distance beyond it on both sides, as long as both sides get smaller."""
    eps, out = 1 - percent / 100, []
    core = np.zeros(len(sets), bool) if core is None else core
    sizes = np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(sizes)]
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(universe), bool)
    work = [np.argsort(core, kind="stable")]
    while work:
        left = work.pop()
        while len(left) > 1 and not core[left[0]]:
            p, left = left[0], left[1:]
            mark[flat[ends[p] : ends[p + 1]]] = True
            spread = np.concatenate([flat[ends[i] : ends[i + 1]] for i in left])
            common = np.add.reduceat(mark[spread].astype(np.int64), np.r_[0, np.cumsum(sizes[left])[:-1]])
            mark[flat[ends[p] : ends[p + 1]]] = False
            near = linked(common, sizes[left], sizes[p], percent)
            d = distance(common, sizes[left], sizes[p])
            out += [(names[p], names[i]) for i in left[near]]
            reach = d[~near].min() - eps - 1e-9 if (~near).any() else np.inf
            stay = ~near | (d >= reach)
            left, d = left[stay], d[stay]
            if len(left) > 16:
                mid = float(np.median(d))
                low, high = d <= mid + eps + 1e-9, d > mid
                if max(low.sum(), high.sum()) < 0.8 * len(left):
                    work.append(left[high])
                    left = left[low]
    return forest(out)


def partnered(ks: list[bytes], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which members may link with another, of the pairs of a left and a right one, by sketches."""
    active = np.zeros(len(ks), bool)
    length = np.array([len(k) for k in ks])
    rows = {b: np.frombuffer(b"".join(ks[i] for i in np.flatnonzero(length == b)), np.uint64).reshape(-1, b // 8) for b in np.unique(length).tolist()}
    at = {b: np.flatnonzero(length == b) for b in rows}

    def meet(i, a, j, b) -> None:
        if not len(i) or not len(j):
            return
        step = max(1, (1 << 21) // len(j))
        for k in range(0, len(i), step):
            s = slice(k, k + step)
            n, m = sizes[i[s], None], sizes[None, j]
            common = np.minimum(np.minimum(n, m), (n + m - unlike(a[s], b)) // 2)
            found = linked(common, n, m, percent) & (i[s, None] != j[None, :])
            active[i[s]] |= found.any(1)
            active[j] |= found.any(0)

    for b, own in rows.items():
        # Sizes of sets that link differ by less than two, so the lengths of their sketches by two at most.
        meet(at[b][left[at[b]]], own[left[at[b]]], at[b][right[at[b]]], own[right[at[b]]])
        if 2 * b in rows:
            small = folded(rows[2 * b])
            for i, x, j, y in ((at[b], own, at[2 * b], small), (at[2 * b], small, at[b], own)):
                meet(i[left[i]], x[left[i]], j[right[j]], y[right[j]])
    return active


def blocked(work: DataFrame, leaf: int) -> DataFrame:
    """(t, g, cell, i, j, x, a, b): the members x of each region g in blocks, so that each member of the rest
    (a) meets all others (b), or in a cell those of its core, and no group (t, i, j) holds over about
    2 * leaf members of a region. Members of a core never meet, so regions with a small rest are dealt in
    proportion to their size. Regions of up to SMALL members share groups of about `leaf` members."""
    counts = work.groupBy("g", "cell").agg(F.count_if(~F.col("core")).alias("r"), F.count("*").alias("n"))
    counts = counts.where("r > 0 and n > 1").select("g", "cell", "n", F.ceil(F.col("r") / leaf).cast("int").alias("ra"), F.ceil(F.col("n") / leaf).cast("int").alias("rb"))
    packs = max(1, -(-work.count() // leaf))
    t = F.xxhash64("g", "cell")
    placed = work.join(counts.withColumn("t", F.when(F.col("n") <= SMALL, F.pmod(t, F.lit(packs))).otherwise(t)), ["g", "cell"])
    one = placed.where("ra = 1 and rb = 1").select("t", "g", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "x", (~F.col("core")).alias("a"), (F.col("core") | ~F.col("cell")).alias("b"))
    many = placed.where("ra > 1 or rb > 1")
    own = lambda n: F.pmod(F.xxhash64("x", F.lit(3)), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = many.where(~F.col("core")).select("t", "g", "cell", own("ra").alias("i"), span("rb").alias("j"), "x", F.lit(True).alias("a"), F.lit(False).alias("b"))
    second = many.where(F.col("core") | ~F.col("cell")).select("t", "g", "cell", span("ra").alias("i"), own("rb").alias("j"), "x", F.lit(False).alias("a"), F.lit(True).alias("b"))
    return one.unionByName(first).unionByName(second)


def active(work: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows of work that may have a partner in their region, by sketches."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ks, n, a, b = rows["k"].to_numpy(), rows["n"].to_numpy(), rows["a"].to_numpy(bool), rows["b"].to_numpy(bool)
        hit = np.zeros(len(rows), bool)
        for at in rows.groupby(["g", "cell"]).indices.values():
            hit[at] = partnered(ks[at].tolist(), n[at], a[at], b[at], percent)
        return rows.loc[hit, ["g", "cell", "x"]]

    placed = blocked(work, WIDE).join(sketches.select(F.col("v").alias("x"), "k", "n"), "x")
    hit = placed.groupBy("t", "i", "j").applyInPandas(run, "g binary, cell boolean, x binary").distinct()
    return work.join(hit, ["g", "cell", "x"], "left_semi")


def near_pivots(rows: pd.DataFrame, percent: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Members and pivots of a block (q marks the pivots), and for each pair the lower bound and whether it may link."""
    members, some = rows[~rows["q"]], rows[rows["q"]]
    d, may = np.ones((len(members), len(some))), np.zeros((len(members), len(some)), bool)
    for i, (x, k, n) in enumerate(zip(members["x"], members["k"], members["n"], strict=True)):
        for j, (q, l, m) in enumerate(zip(some["x"], some["k"], some["n"], strict=True)):
            if x != q:
                d[i, j], may[i, j] = may_link(k, l, n, m, percent)
    return members["x"].tolist(), some["x"].tolist(), d, may


def redealt(work: DataFrame, sketches: DataFrame, sets, percent: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Rounds of further pivots for the regions with a large rest: (work, links, tables to release).

    About PIVOTS members of each large rest become pivots, by a hash of the round. Each member tries its nearest
    pivot alone: if they link, it is in that pivot's ball and leaves the rest. Pivots that link share one cell,
    whose core is all their balls; its window are the other members within twice the join's distance of one of
    its pivots, so nothing that leaves misses a partner, and members that are connected already never meet. A
    round that makes no rest smaller by a tenth ends this."""
    eps, links, cells, old = 1 - percent / 100, None, None, []
    for turn in range(16):
        sizes = work.groupBy("g").agg(F.count_if(~F.col("core")).alias("r")).where(F.col("r") > WIDE)
        before = sizes.agg(F.sum("r")).first()[0]
        if not before:
            break
        chance = F.pmod(F.xxhash64("x", F.lit(turn + 11)), F.lit(1 << 30)) / float(1 << 30)
        blocks = F.ceil(F.col("r") / WIDE).cast("int")
        chosen = ~F.col("core") & (chance * F.col("r") < PIVOTS)
        several = stored(work.join(sizes, "g").join(sketches.select(F.col("v").alias("x"), "k", "n"), "x").select("g", "x", "core", "k", "n", blocks.alias("blocks"), chosen.alias("pivot")), "large")
        # Blocks of members in proportion to the rest; every block of a region gets the region's pivots.
        dealt_out = several.select("g", "x", "k", "n", "pivot", F.pmod(F.xxhash64("x"), "blocks").cast("int").alias("z"), F.lit(False).alias("q"))
        told = several.where("pivot").select("g", "x", "k", "n", "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("z"), F.lit(True).alias("q"))
        both = dealt_out.unionByName(told)

        def tries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            names, some, d, may = near_pivots(rows, percent)
            pivot, out = set(some), []
            for i, x in enumerate(names):
                mine = np.flatnonzero(may[i])
                if len(mine):
                    out += [(key[0], x, some[j]) for j in (mine if x in pivot else mine[[d[i, mine].argmin()]])]
            return pd.DataFrame(out, columns=["g", "x", "q"])

        tried = stored(both.groupBy("g", "z").applyInPandas(tries, "g binary, x binary, q binary"), "tried")
        exact = verified(tried.select("x", F.col("q").alias("p")).distinct(), sets(tried.select(F.explode(F.array("x", "q")).alias("v"))), percent).where("near")
        near = stored(tried.join(exact.select("x", F.col("p").alias("q")), ["x", "q"]), "balls")
        new = near.select(F.col("x").alias("a"), F.col("q").alias("b"))
        links = new if links is None else links.unionByName(new)

        def named(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            """For each pivot of a region the least one that it is connected with."""
            own = set(rows.loc[rows["a"] == rows["b"], "a"])
            top = dict((v, u) for u, v in forest([(a, b) for a, b in zip(rows["a"], rows["b"], strict=True) if a != b and a in own and b in own]))
            return pd.DataFrame([(key[0], v, top.get(v, v)) for v in sorted(own)], columns=["g", "q", "label"])

        pivots_ = several.where("pivot").select("g", F.col("x").alias("q"))
        pairs = near.join(pivots_.select("g", F.col("q").alias("x")), ["g", "x"], "left_semi").select("g", F.col("x").alias("a"), F.col("q").alias("b"))
        labels = stored(pairs.unionByName(pivots_.select("g", F.col("q").alias("a"), F.col("q").alias("b"))).groupBy("g").applyInPandas(named, "g binary, q binary, label binary"), "pivots")
        own = near.join(labels, ["g", "q"]).select("g", "x", "label").unionByName(labels.select("g", F.col("q").alias("x"), "label")).groupBy("g", "x").agg(F.min("label").alias("label"))

        def placed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            names, some, d, _ = near_pivots(rows, percent)
            mine = dict(zip(rows.loc[~rows["q"], "x"], rows.loc[~rows["q"], "label"], strict=True))
            label = dict(zip(rows.loc[rows["q"], "x"], rows.loc[rows["q"], "label"], strict=True))
            out = []
            for i, x in enumerate(names):
                near_by = {label[some[j]] for j in np.flatnonzero(d[i] <= 2 * eps + 1e-9)}
                out += [(v, x, v == mine[x]) for v in near_by | ({mine[x]} if mine[x] is not None else set())]
            return pd.DataFrame(out, columns=["g", "x", "core"])

        around = both.join(own, ["g", "x"], "left").groupBy("g", "z").applyInPandas(placed, "g binary, x binary, core boolean").groupBy("g", "x").agg(F.max("core").alias("core")).withColumn("cell", F.lit(True))
        around = stored(around, "cells")
        cells = around if cells is None else cells.unionByName(around)
        work = stored(work.join(own.withColumn("left", F.lit(True)).select("g", "x", "left"), ["g", "x"], "left").where("core or left is null").select("g", "x", "core", "cell"), "work")
        old += [several, tried, near, labels, around, work]
        after = work.groupBy("g").agg(F.count_if(~F.col("core")).alias("r")).join(sizes.select("g"), "g", "left_semi").agg(F.sum("r")).first()[0] or 0
        if after > 0.9 * before:
            break
    return (work if cells is None else work.unionByName(cells)), links, old


def regions(found: DataFrame, sketches: DataFrame, sets, percent: int) -> DataFrame:
    """Links (a, b) among what the first pivots leave; sets(names) gives the whole sets of vertices."""
    eps = 1 - percent / 100
    # A shingle that only a set and its pivot hold brings no third set to meet.
    found = found.where("more")
    rings = found.groupBy("p").agg(F.min(F.when(~F.col("near"), F.col("d"))).alias("least")).where("least is not null")
    rest = found.join(rings, "p").where(~F.col("near") | (F.col("d") >= F.col("least") - eps - 1e-9))
    work = stored(rest.select(F.col("p").alias("g"), "x", F.col("near").alias("core"), F.lit(False).alias("cell")), "rest")
    work, links, old = redealt(work, sketches, sets, percent)
    left = stored(active(work, sketches, percent), "active")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = []
        for _, own in rows.sort_values("a", ascending=False).groupby(["g", "cell"]):
            own = own.drop_duplicates("x")  # a member of the rest may meet its own block
            if len(own) > 1:
                got += joined_region(own["x"].tolist(), [np.frombuffer(s, np.uint64) for s in own["s"]], percent, ~own["a"].to_numpy(bool))
        return pd.DataFrame(got, columns=["a", "b"])

    whole = sets(left.select(F.col("x").alias("v")))
    exact = stored(blocked(left, LEAF).join(whole.select(F.col("v").alias("x"), "s"), "x").groupBy("t", "i", "j").applyInPandas(run, "a binary, b binary"), "links")
    exact = exact if links is None else exact.unionByName(stored(links, "links"))
    release(found.sparkSession, left, whole, *old)
    return exact


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their shingle sets. component_id is
    the least doc_id that links reach. Null, empty and blank texts have no shingles and link with
    nothing. A null doc_id is never a component's id unless all are null. Rows that repeat a doc_id get
    a row each, with its own text's links. An empty table gives an empty result; other columns are left out."""
    rows = texts(docs, id_col, text_col)
    spark = rows.sparkSession
    batches = stored(scanned(rows, width, percent, parts_of(rows, 2)), "shingles")

    def unpack(them):
        for t in them:
            for number, v, drawn, n, i in zip(*(t.column(c).to_pylist() for c in ("batch", "keys", "low", "sizes", "docs")), strict=True):
                ids, n = np.frombuffer(i, np.int64), np.frombuffer(n, np.int64)
                names, ks, at = [v[j : j + 16] for j in range(0, len(v), 16)], [], 0
                seen = set()
                for name, size in zip(names, n.tolist(), strict=True):
                    step = 0 if name in seen or not size else max(64, 1 << (2 * size - 1).bit_length()) // 8
                    ks.append(drawn[at : at + step] if step else None)
                    at += step
                    seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array((number << 16) + np.arange(len(ids))), pa.array(names, pa.binary()), pa.array(n), pa.array(ks, pa.binary())], ["doc_id", "h", "v", "n_shingles", "k"])

    known = stored(batches.where("bucket = -1").select("batch", "keys", "low", "sizes", "docs").mapInArrow(unpack, "doc_id long, h long, v binary, n_shingles long, k binary"), "vertices")
    pairs = stored(members(batches, known), "pairs")
    release(spark, batches)
    # Sets of too different sizes are at least 1 - n / m apart, which is all that is needed of them.
    could = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    apart = pairs.where(~could).select("x", "p", (1 - F.least("n", "m") / F.greatest("n", "m")).alias("d"), F.lit(False).alias("near"), "more")
    needs = pairs.where(could | F.col("more")).select(F.explode(F.array("x", "p")).alias("v")).distinct()
    sketches = stored(known.where("k is not null").join(needs, "v", "left_semi").select("v", "k", F.col("n_shingles").alias("n")).dropDuplicates(["v"]), "sketches")
    one = known.groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    bounds = stored(bounded(pairs.where(could), sketches, percent), "bounds")
    release(spark)

    def sets(names: DataFrame) -> DataFrame:
        return stored(sets_of(rows, stored(one.join(names.distinct(), "v", "left_semi"), "names"), width), "sets")

    may = bounds.where("may")
    whole = sets(may.select(F.explode(F.array("x", "p")).alias("v")))
    told = verified(may, whole, percent).join(may.select("x", "p", "more"), ["x", "p"]).select("x", "p", "d", "near", "more")
    found = stored(told.unionByName(bounds.where("not may").select("x", "p", "d", F.lit(False).alias("near"), "more")).unionByName(apart), "distances")
    release(spark, pairs, bounds, whole)
    links = found.where("near").select(F.col("x").alias("a"), F.col("p").alias("b")).unionByName(regions(found, sketches, sets, percent))
    labels = components(links)
    release(spark, found, sketches)
    # The least id of each vertex, then of each component; vertices without links are their own.
    least = known.where("n_shingles > 0").groupBy("v").agg(F.min("doc_id").alias("least"))
    named = stored(least.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"), "least"), "named")
    whole = named.groupBy("label").agg(F.min("least").alias("component"))
    final = named.join(whole, "label").select("v", "component")
    return known.join(final, "v", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of docs, in all their columns, whose doc_id is its component's; rows without one stay.

    Null and empty texts all stay, as they link with nothing; of rows that repeat a doc_id with several texts
    all stay if one does; an empty table stays empty; columns of any name stay."""
    found = stored(near_duplicates(docs, percent, width).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")), "found")
    gone = found.where("not stays").select("doc_id")
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
