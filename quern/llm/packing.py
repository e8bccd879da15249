"""Hierarchical packing of documents into windows of several context sizes.

A document's ids (with its end id) give whole windows of the longest size first; what remains, and every
shorter document, is routed to the shortest tier whose context holds it. Each tier is packed into windows of
its own size: a window opens with the tier's longest piece, takes the longest of its tier that still fit, and
its gap is filled from shorter tiers in the same way; the last gap takes the front of a piece, whose rest is
routed again. What is left at the end of a task, less than one window of the shortest tier, is cut into
windows of powers of two. So every window is full. Windows are dealt to step groups of equal token counts,
each size evenly over the groups that are open.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.shared import texts
from quern.llm.tokens import tokenizer, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Pieces of one tier by length; a piece is (doc_id, start, length, tokens of the document, ids, their start)."""

    def __init__(self):
        self.lengths, self.by_length, self.tokens = [], {}, 0

    def add(self, piece: tuple) -> None:
        n = piece[2]
        if n not in self.by_length:
            self.by_length[n] = []
            insort(self.lengths, n)
        self.by_length[n].append(piece)
        self.tokens += n

    def _pop(self, n: int) -> tuple:
        found = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.by_length[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.tokens -= n
        return found

    def longest(self, most: int) -> tuple | None:
        """The longest piece of at most `most` tokens."""
        i = bisect_right(self.lengths, most)
        return self._pop(self.lengths[i - 1]) if i else None

    def shortest_over(self, room: int) -> tuple | None:
        i = bisect_right(self.lengths, room)
        return self._pop(self.lengths[i]) if i < len(self.lengths) else None


class Tiers:
    def __init__(self, sizes: tuple[int, ...]):
        self.sizes = tuple(sorted(sizes))
        self.pools = {s: Pool() for s in self.sizes}

    def add(self, piece: tuple) -> None:
        """Routes a piece to the shortest tier that holds it."""
        self.pools[next(s for s in self.sizes if s >= piece[2])].add(piece)

    def below(self, size: int) -> int:
        """Tokens of a tier and all shorter ones."""
        return sum(self.pools[s].tokens for s in self.sizes if s <= size)

    def window(self, size: int, room: int | None = None) -> list[tuple]:
        """A full window for a tier, from its own pieces first, then from ever shorter tiers; these must hold enough."""
        out, room = [], room or size
        order = [self.pools[s] for s in reversed(self.sizes) if s <= size]
        while room:
            piece = next((p for pool in order if (p := pool.longest(room))), None)
            if piece is None:
                i, start, n, *rest = next(p for pool in reversed(order) if (p := pool.shortest_over(room)))
                piece = (i, start, room, *rest)
                self.add((i, start + room, n - room, *rest))
            out.append(piece)
            room -= piece[2]
        return out

    def rest(self) -> list[tuple[int, list[tuple]]]:
        """Windows of all that is left, by tier from the longest; a tier without enough for one of its windows
        gives its pieces to the next one, cut to its size."""
        out = []
        for size in reversed(self.sizes):
            pool = self.pools[size]
            while pool.tokens and self.below(size) >= size:
                out.append((size, self.window(size)))
            shorter = [s for s in self.sizes if s < size]
            while pool.tokens and shorter:
                i, start, n, *more = pool.longest(size)
                for a in range(0, n, shorter[-1]):
                    self.add((i, start + a, min(shorter[-1], n - a), *more))
        least = self.sizes[0]
        while self.pools[least].tokens:
            room = 1 << (self.pools[least].tokens.bit_length() - 1)
            out.append((room, self.window(least, min(room, least))))
        return out


class Steps:
    """Step groups of equal token counts: a window goes to the open group that has the fewest of its size."""

    def __init__(self, tokens: int, width: int = 4):
        self.tokens, self.width, self.open, self.next = tokens, width, [], 0

    def place(self, size: int) -> int:
        fits = [g for g in self.open if g[1] + size <= self.tokens]
        if not fits or len(self.open) < self.width:
            fits = [[self.next, 0, {}]]
            self.open.append(fits[0])
            self.next += 1
        g = min(fits, key=lambda g: (g[2].get(size, 0), g[1], g[0]))
        g[1] += size
        g[2][size] = g[2].get(size, 0) + 1
        if g[1] == self.tokens:
            self.open.remove(g)
        return g[0]


def packed(docs: DataFrame, name: str = "byte_bpe_50k.json", window: int = 1024, end_id: int = 0, hold: int = 64, step: int = 64, tiers: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the window's tier (its length) and step_group.

    window must be a power of two; there are `tiers` context sizes, each half of the next, as far as they are
    above 1. A null or empty text is its end id alone; very long texts give their windows one by one; repeated
    rows are packed each; a null doc_id stays null; an empty table gives no pieces; other columns are left out.
    A task holds the pieces of at most `hold` windows of each tier before it closes some. sequence_id and
    step_group hold the number of the task in their high bits, so no shuffle is needed; a step group has
    `step` windows' worth of tokens, but for the last ones of a task."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    sizes = tuple(window >> k for k in range(tiers) if window >> k)

    def run(batches):
        from pyspark import TaskContext

        t = tokenizer(vocabulary(name))
        high, held, steps, rows = TaskContext.get().partitionId() << 32, Tiers(sizes), Steps(window * step), []
        end, sequences = end_id.to_bytes(4, "little"), 0

        def emit(pieces):
            nonlocal sequences
            at, total = 0, sum(p[2] for p in pieces)
            group = high + steps.place(total)
            for doc, start, n, tokens, raw, base in pieces:
                cut = raw[4 * (start - base) : 4 * (start - base + n)]
                rows.append((doc, start, n, zlib.crc32(cut), tokens, high + sequences, at, total, group))
                at += n
            sequences += 1

        def flush():
            table = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            rows.clear()
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(table, types, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = t.ids(text) + end
                tokens, start = len(raw) // 4, 0
                while tokens - start >= window:
                    emit([(doc, start, window, tokens, raw, 0)])
                    start += window
                if start < tokens:
                    held.add((doc, start, tokens - start, tokens, raw[4 * start :], start))
                for size in sizes:
                    while held.pools[size].tokens >= hold * size:
                        emit(held.window(size))
            if rows:
                yield flush()
        for _, pieces in held.rest():
            emit(pieces)
        if rows:
            yield flush()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
