"""What several operators of this subpackage need: tables, the shared folder, blobs dealt by key."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets the shuffle files of past queries go."""
    import gc

    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts empty; other columns never clash as they are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, where it can; else the worker keeps it for later."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def parts_of(df: DataFrame, per: int = 1, least: int = 12) -> int:
    """A number of buckets in proportion to the input: per for each task that scans it."""
    return max(least, per * df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Odd multipliers of the word and shingle hashes (fixed values).
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    x = x * MIX2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound on the memory of a worker."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the high half of the keys, so that a bucket is a range of them."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(keys: np.ndarray, buckets: int, *columns: np.ndarray):
    """(bucket, keys, columns...) for every bucket that has keys; keys must be sorted."""
    if not len(keys):
        return
    cuts = np.flatnonzero(np.diff(bucket_of(keys, buckets))) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
    names = bucket_of(keys[starts], buckets)
    for b, i, j in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield (b, keys[i:j], *(c[i:j] for c in columns))


#: A fixed random 64-bit value for each byte, and the powers of MIX by a byte's place in its word.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX2)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_powers = np.cumprod(np.full(1 << 10, MIX), dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data (between ASCII white space, A-Z lower-cased), and their starts."""
    global _powers
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    sizes = np.diff(np.r_[first, len(at)])
    while sizes.max() > len(_powers):
        _powers = np.cumprod(np.full(2 * len(_powers), MIX), dtype=np.uint64)
    place = np.arange(len(at)) - np.repeat(first, sizes)
    values = _BYTES[_LOWER[raw[at]]] * _powers[place]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64)), at[first]


def grouped(values: list[str], most: int = 1 << 20):
    """(first, end) of runs of texts of about `most` characters, so that arrays over a run stay small."""
    i = 0
    while i < len(values):
        j, n = i, 0
        while j < len(values) and (j == i or n + len(values[j]) <= most):
            n += len(values[j])
            j += 1
        yield i, j
        i = j


def words_by_text(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all the texts, one after another, and the bounds of each text's words."""
    raws = [v.encode("utf-8", "surrogatepass") for v in values]
    hashes, starts = word_hashes(b"\n".join(raws))
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
