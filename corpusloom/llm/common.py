"""Helpers shared by the training-data operators: files, ordered layout, text columns."""

from __future__ import annotations

import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_path, table  # noqa: F401 - for the operators beside this module

#: Bytes of text that one ordered partition should hold.
PARTITION_BYTES = 32 << 20
#: Rows of the sample for each bound between ordered partitions.
SAMPLE_ROWS = 40
FIRST = -(1 << 63)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain local path; s3a and s3n are read as s3."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


class AtomicFile:
    """A file of the shared folder that appears whole or not at all.

    A task that is run again writes the same name, so a lost executor leaves no half of a file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, one text at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, b
        a = b


class Order:
    """Parts of rows in the order of two longs, the second telling rows of one key apart.

    ``bounds`` are the last pairs of all parts but the last. They are one a part, and go to the tasks in
    the function that looks them up, so there may be any number of them.
    """

    def __init__(self, bounds: list[tuple[int, int]]):
        self.bounds = bounds
        self.parts = len(bounds) + 1

    def part(self, key: str, tie: str, firsts: dict[tuple[int, int], int] | None = None):
        """Column of part numbers, or, with ``firsts``, of what that holds for the pair, else -1."""
        bounds = self.bounds
        keys = np.array([k for k, _ in bounds], np.int64)

        @F.arrow_udf("int")
        def of(a: pa.Array, b: pa.Array) -> pa.Array:
            k = np.asarray(a)
            if firsts is not None:
                known = np.fromiter((f for f, _ in firsts), np.int64, len(firsts))
                out = np.full(len(k), -1, np.int32)
                for i in np.flatnonzero(np.isin(k, known)).tolist():
                    out[i] = firsts.get((int(k[i]), b[i].as_py()), -1)
                return pa.array(out)
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                lo[i] = bisect_left(bounds, (int(k[i]), b[i].as_py()))
            return pa.array(lo.astype(np.int32))

        return of(F.col(key), F.col(tie))


def ordered_parts(rows: DataFrame, key: str, text: str, partition_bytes: int = PARTITION_BYTES, seed: int = 17) -> tuple[DataFrame, Order]:
    """Add ``_key``, ``_tie`` and ``_part``, which ascends with them; also the order itself.

    ``repartitionById(order.parts, "_part")`` then lays the rows out by key (null first), and rows of one
    key by the hash of their text, so a key that many rows share is spread over parts as well. Bounds
    come from a sample of ``SAMPLE_ROWS`` rows a part, weighed by the bytes of their texts; parts grow
    in number with the input. The driver holds three longs a row of the sample.
    """
    keyed = rows.withColumn("_key", F.coalesce(F.col(key), F.lit(FIRST))).withColumn("_tie", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    total, count = rows.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = int(max(1, min(count, -(-(total or 0) // partition_bytes))))
    bounds: list[tuple[int, int]] = []
    if n > 1:
        sized = keyed.select("_key", "_tie", F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
        sample = sized.sample(False, min(1.0, SAMPLE_ROWS * n / count), seed).toArrow().sort_by([("_key", "ascending"), ("_tie", "ascending")])
        weight = np.cumsum(np.asarray(sample["n"]).astype(np.int64) + 1)
        at = np.searchsorted(weight, weight[-1] * np.arange(1, n) / n) if len(weight) else []
        bounds = sorted({(sample["_key"][int(i)].as_py(), sample["_tie"][int(i)].as_py()) for i in at})
    order = Order(bounds)
    return keyed.withColumn("_part", order.part("_key", "_tie") if bounds else F.lit(0)), order


__all__ = ["AtomicFile", "FIRST", "Order", "PARTITION_BYTES", "discard", "materialize", "open_fs", "ordered_parts", "shared_path", "string_buffers", "table", "text_runs"]
