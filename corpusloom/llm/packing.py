"""Harmonic packing of token documents into sequences of a fixed capacity.

A document longer than the capacity gives whole sequences first; what remains has a length t and belongs to the
reciprocal class k = capacity // t. Every class fills its own bins with k documents each, whole. The
gap that such a bin leaves is then given to a later document that fits, the tightest gap first; a
document is cut over several gaps only where more than ``open_gaps`` of them are open and none
holds it. Each task fills its bins alone, without any exchange of rows; at its end the documents
of unfinished classes go to the gaps and then, cut where a sequence ends, one after another.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_runs
from .units import default_tokenizer, encoder, give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Bins:
    """Bins of one task. Placed pieces are tuples (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, task: int = 0, least_gap: int = 8, open_gaps: int = 64):
        self.capacity, self.task, self.least_gap, self.open_gaps = capacity, task, least_gap, open_gaps
        self.waiting: dict[int, list[tuple]] = {}
        self.gaps: list[tuple[int, int]] = []  # (free places at the end, sequence), ascending
        self.free = 0
        self.made = 0

    def _sequence(self) -> int:
        self.made += 1
        return (self.task << 40) + self.made - 1

    def _open(self, sequence: int, gap: int) -> None:
        """Keep a gap for later; one below ``least_gap``, or the smallest of too many, stays padding."""
        if gap >= self.least_gap:
            insort(self.gaps, (gap, sequence))
            self.free += gap
            if len(self.gaps) > 4 * self.open_gaps:
                self.free -= self.gaps.pop(0)[0]

    def _fits(self, document, start: int, n: int) -> list[tuple] | None:
        """Whole into the tightest gap, or cut over the largest ones if there are many."""
        i = bisect_left(self.gaps, (n, -1))
        if i < len(self.gaps):
            gap, sequence = self.gaps.pop(i)
            self.free -= gap
            self._open(sequence, gap - n)
            return [(document, start, n, sequence, self.capacity - gap)]
        if len(self.gaps) <= self.open_gaps or self.free < n:
            return None
        return self._spread(document, start, n)

    def _spread(self, document, start: int, n: int) -> list[tuple]:
        out = []
        while n and self.gaps:
            gap, sequence = self.gaps.pop()
            self.free -= gap
            take = min(gap, n)
            out.append((document, start, take, sequence, self.capacity - gap))
            self._open(sequence, gap - take)
            start, n = start + take, n - take
        return out

    def add(self, document, size: int) -> list[tuple]:
        """Take a document; return the pieces that are now placed."""
        out, start = [], 0
        while size - start >= self.capacity:
            out.append((document, start, self.capacity, self._sequence(), 0))
            start += self.capacity
        n = size - start
        if not n:
            return out
        placed = self._fits(document, start, n)
        if placed is not None:
            return out + placed
        k = self.capacity // n
        members = self.waiting.setdefault(k, [])
        members.append((document, start, n))
        if len(members) == k:
            del self.waiting[k]
            sequence, at = self._sequence(), 0
            for name, begin, length in members:
                out.append((name, begin, length, sequence, at))
                at += length
            self._open(sequence, self.capacity - at)
        return out

    def finish(self) -> list[tuple]:
        """Place what waits: into gaps, then one after another."""
        out, sequence, at = [], 0, self.capacity
        for document, start, n in sorted((m for ms in self.waiting.values() for m in ms), key=lambda m: -m[2]):
            i = bisect_left(self.gaps, (n, -1))
            if i < len(self.gaps):
                out += self._fits(document, start, n)
                continue
            while n:
                if at == self.capacity:
                    if self.gaps and self.free >= n:
                        out += self._spread(document, start, n)
                        break
                    sequence, at = self._sequence(), 0
                take = min(n, self.capacity - at)
                out.append((document, start, take, sequence, at))
                start, n, at = start + take, n - take, at + take
        self.waiting = {}
        return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    least_gap: int = 8,
    open_gaps: int = 64,
) -> DataFrame:
    """One row a piece: its document's id, place in the document, checksum, sequence and offset there.

    A null text packs as an empty one, so its document is the end id alone; repeated rows are
    documents of their own; a null id stays null; a very long text gives many whole sequences; an empty
    table gives an empty result; other columns are ignored. Sequence ids are unique, not gapless. A
    task holds at most ``capacity`` ids a class that waits, and one batch of texts.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId(), least_gap, open_gaps)
        encode = encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = [(key, start, n, zlib.crc32(ids[start * 4 : (start + n) * 4]), len(ids) // 4, sequence, offset) for (key, ids), start, n, sequence, offset in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in text_runs(offsets, 2 << 20):
                ids, sizes = encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data = ids.astype("<u4").tobytes()
                at = 0
                for key, n in zip(keys[a:b], sizes.tolist()):
                    held += bins.add((key, data[at : at + 4 * n] + end), n + 1)
                    at += 4 * n
                    if len(held) >= 8192:
                        yield out()
                if held:
                    yield out()
            give_back()
        held += bins.finish()
        if held:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
