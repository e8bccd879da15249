"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; sentences of many words are cut further at words whose hash says so, which
are the same words wherever a passage stands. Every run of `run` consecutive sentences with enough words
is hashed. Runs are joined globally by hash; the first occurrence of a run is the one with the least
(doc_id, row, place), where each row of the input has a number of its own. All sentences that a non-first
occurrence covers are removed.

A batch keeps, for each hash, its first occurrence only for the global join, as its others are not the
first in any case; so a run that a third of all documents hold sends one row a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import MIX, dealt, mixed, parts_of, release, stored, texts, word_hashes

#: Ends of sentences: a mark and white space after it, or a line break.
END = re.compile(rb"[.!?][\x20\t\r]+|\n")
#: Words of a sentence after which it may be cut, and the share of words that cut it.
LONG, CUT = 6, 4
NULL_ID = -(1 << 63)


def sentences(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the sentences (the first at 0), their hashes and numbers of words; hashes see words alone."""
    h, at = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.int64), h, at
    ends = np.array([m.end() for m in END.finditer(data)], np.int64)
    starts = np.unique(np.searchsorted(at, ends))  # words that begin a sentence
    begin = np.zeros(len(h), bool)
    begin[starts[starts < len(h)]] = begin[0] = True
    # Content-defined cuts: after a word of the right hash, LONG words or more into what precedes it.
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(begin, np.arange(len(h)), 0))
    chosen = np.r_[False, h[:-1] % np.uint64(CUT) == 0] & (place >= LONG)
    begin |= chosen & ~np.r_[False, chosen[:-1]]
    first = np.flatnonzero(begin)
    n = np.diff(np.r_[first, len(h)])
    inside = np.arange(len(h)) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        value = np.add.reduceat(h * _powers(n.max())[inside], first)
    return np.r_[0, at[first[1:]]], mixed(value + n.astype(np.uint64)), n


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, MIX), dtype=np.uint64)


def runs_of(h: np.ndarray, n: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs and their places (first sentences)."""
    if len(h) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x, total = np.full(len(h) - run + 1, run, np.uint64), np.zeros(len(h) - run + 1, np.int64)
    for k in range(run):
        x = x * MIX + h[k : len(h) - run + 1 + k]
        total += n[k : len(h) - run + 1 + k]
    at = np.flatnonzero(total >= words)
    return mixed(x[at]), at


FOUND = "bucket int, keys binary, docs binary, rows binary, places binary"


def occurrences(rows: DataFrame, run: int, words: int, buckets: int) -> DataFrame:
    """Bucket -1: (rows, places) of runs that are not the first even in their batch. Other buckets: the
    first occurrence of each run in the batch."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def scan(batches):
        for batch in batches:
            ids = [NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            keys, docs, numbers, places = [], [], [], []
            for i, number, text in zip(ids, batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                _, h, n = sentences(text.encode("utf-8", "surrogatepass"))
                k, at = runs_of(h, n, run, words)
                keys.append(k)
                docs.append(np.full(len(k), i, np.int64))
                numbers.append(np.full(len(k), number, np.int64))
                places.append(at)
            keys, docs, numbers, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, docs, numbers, places))
            order = np.lexsort((places, numbers, docs, keys))
            keys, docs, numbers, places = keys[order].astype(np.uint64), docs[order], numbers[order], places[order].astype(np.int32)
            first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            out = [(-1, b"", b"", numbers[~first].tobytes(), places[~first].tobytes())]
            out += [(b, *(x.tobytes() for x in c)) for b, *c in dealt(keys[first], buckets, docs[first], numbers[first], places[first])]
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 256], strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names)

    return rows.mapInArrow(scan, FOUND)


def repeats(found: DataFrame) -> DataFrame:
    """(row, place) of every non-first occurrence."""

    def later(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        docs, numbers = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("docs", "rows"))
        places = np.concatenate([np.frombuffer(x, np.int32) for x in rows["places"]])
        order = np.lexsort((places, numbers, docs, keys))
        again = np.r_[False, keys[order][1:] == keys[order][:-1]]
        return pd.DataFrame({"row": numbers[order][again], "place": places[order][again]})

    def local(them):
        for t in them:
            for d, p in zip(t.column("rows").to_pylist(), t.column("places").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d, np.int64)), pa.array(np.frombuffer(p, np.int32))], ["row", "place"])

    far = found.where("bucket >= 0").groupBy("bucket").applyInPandas(later, "row long, place int")
    near = found.where("bucket = -1").select("rows", "places").mapInArrow(local, "row long, place int")
    return near.unionByName(far)


def without_repeats(docs: DataFrame, run: int = 3, words: int = 10, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences, n_removed, removed (start:end byte offsets of the
    removed stretches of the UTF-8 text, comma-joined), clean_text.

    Runs of `run` consecutive sentences with at least `words` words count, and stretches of covered sentences
    with at least `least` words in all are removed: shorter ones are phrases that many texts share. Null and empty texts have no
    sentences and stay empty. Each row is a place of its own, in the order of doc_id, null before all
    others, then as the table is read; so one of equal rows keeps what the others lose. An empty table gives an empty result; other columns are left out."""
    # Stored, as a row must have the same number when it is cut.
    rows = stored(texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = stored(occurrences(rows, run, words, parts_of(rows, 2)), "runs")
    marks = stored(repeats(found).groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("places")), "repeats")
    release(rows.sparkSession, found)

    def cut(batches):
        for batch in batches:
            out = []
            for i, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                starts, _, sizes = sentences(data)
                gone = np.zeros(len(starts) + 1, np.int64)
                for p in places or ():
                    if p < len(starts):
                        gone[p] += 1
                        gone[min(p + run, len(starts))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                ends = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
                    gone[a:b] = sizes[a:b].sum() >= least
                bounds = [*starts.tolist(), len(data)]
                stretches, kept = [], []
                for k, dead in enumerate(gone.tolist()):
                    if not dead:
                        kept.append(data[bounds[k] : bounds[k + 1]])
                    elif stretches and stretches[-1][1] == bounds[k]:
                        stretches[-1][1] = bounds[k + 1]
                    else:
                        stretches.append([bounds[k], bounds[k + 1]])
                clean = b"".join(kept) if len(starts) else data
                out.append((i, len(starts), int(gone.sum()), ",".join(f"{a}:{b}" for a, b in stretches), clean.decode("utf-8", "replace")))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["doc_id", "n_sentences", "n_removed", "removed", "clean_text"])

    joined = rows.join(marks, "row", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, removed string, clean_text string")
