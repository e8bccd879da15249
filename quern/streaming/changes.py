"""Change streams: debounce by session, in batch and in Structured Streaming, and batch application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounced(events: DataFrame, keys: list[str], ts: str, seq: str, gap: str) -> DataFrame:
    """K2: sessions of each key that `gap` of silence ends: start, the last event, number of events."""
    grouped = events.groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.max_by(seq, F.struct(ts, seq)).alias("last_id"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "last_id", "n")


def debounced_stream(events: DataFrame, keys: list[str], ts: str, seq: str, gap: str, late: str = "1 second") -> DataFrame:
    """K1, K2: the same over a stream, with a watermark for late events; ts must be a timestamp."""
    return debounced(events.withWatermark(ts, late), keys, ts, seq, gap)


def apply_changes(stream: DataFrame, apply: Callable[[SparkSession, DataFrame, int], None], checkpoint: str):
    """K3: runs `apply` (session, rows, batch id) on each micro-batch until the input ends. `apply` must
    give the same result when a batch id comes again."""
    return stream.writeStream.foreachBatch(lambda df, i: apply(df.sparkSession, df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, refresh: Callable[[], object], rounds: int | None = None, settle: float = 0.3, poll: float = 0.05) -> int:
    """Refreshes whenever the files below root have changed and then stayed as they are for
    `settle` seconds; what is there at the start counts as known. Ends after `rounds` refreshes, if given."""
    import time

    def seen() -> tuple:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("path not like '%/.quern/%'").select("path", "modificationTime", "length")
        r = found.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("path", "modificationTime", "length"), F.lit(1 << 40))), F.lit(0))).first()
        return tuple(r)

    known, done = seen(), 0
    while rounds is None or done < rounds:
        now = seen()
        if now == known:
            time.sleep(poll)
            continue
        while True:
            time.sleep(settle)
            later = seen()
            if later == now:
                break
            now = later
        refresh()
        known, done = now, done + 1
    return done
