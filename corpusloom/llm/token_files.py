"""Token-id files of a corpus: ascending documents, encoded, range-coded and read back.

Rows are laid out by approximate quantiles of the id, one file a part; a file appears whole or not
at all and its content depends on its rows alone, so a task that is run again writes it anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import AtomicFile, FIRST, PARTITION_BYTES, materialize, open_fs, ordered_parts, string_buffers, text_runs
from .range_coder import MAGIC, decode_segments, encode_segment
from .units import default_tokenizer, encoder

_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    segment_ids: int = 6_000_000,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Write every document's ids and the end id; returns the manifest, one row a file.

    A null text counts as empty, so its ids are the end id alone. Null document ids come first and
    are read back as null; rows of equal id are ordered by a hash of their text, repeated rows are
    documents of their own; an empty table gives no file and an empty manifest; other columns are
    ignored. A segment closes at ``segment_ids`` ids, but holds whole documents, also very long ones.
    The manifest holds part, file, n_docs, n_tokens and n_bytes.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, 1_000_000).encode
        # Hash-free layout: a task holds one part, or several one after another.
        file, part, held, counted = None, None, [], [0, 0]

        def flush() -> None:
            if held:
                keys, sizes, ids = map(np.concatenate, zip(*held))
                file.write(encode_segment(keys, sizes, ids))
                counted[0] += len(keys)
                counted[1] += len(ids)
                held.clear()

        def close() -> pa.RecordBatch:
            flush()
            file.commit()
            row = [[part], [name], [counted[0]], [counted[1]], [file.size]]
            counted[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _MANIFEST)], schema=_MANIFEST)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.asarray(batch.column(2))
            keys = np.asarray(batch.column(0).fill_null(FIRST)).astype(np.int64)
            raw, offsets = string_buffers(batch.column(1))
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges, edges[1:]):
                if part != int(parts[lo]):
                    if file is not None:
                        yield close()
                    part = int(parts[lo])
                    name = f"{out_dir}/ids-{part:06d}.bin"
                    file = AtomicFile(name)
                    file.write(MAGIC)
                for a, b in text_runs(offsets[lo : hi + 1], 8 << 20):
                    a, b = a + lo, b + lo
                    ids, sizes = encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    held.append((keys[a:b], sizes + 1, ids))
                    if sum(len(x[2]) for x in held) >= segment_ids:
                        flush()  # a run of texts is small beside a segment
        if file is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parted, order = ordered_parts(rows, "doc_id", "text", partition_bytes)
    laid = parted.repartitionById(order.parts, F.col("_part")).sortWithinPartitions("_part", "_key", "_tie", "text")
    return laid.select("doc_id", "text", "_part").mapInArrow(run, "part long, file string, n_docs long, n_tokens long, n_bytes long")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids).

    ``manifest`` is a stored table. Files are opened by the tasks, a segment at a time; a checksum
    that differs raises. The starts of files come from a running sum over the manifest, one row a file.
    """
    fields = _READ.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _READ
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = open_fs(name)
                with system.open_input_stream(path, compression=None) as stream:
                    for keys, sizes, ids in decode_segments(stream):
                        stop = np.cumsum(sizes)
                        data = memoryview(ids.astype("<u4")).cast("B")
                        crc = [zlib.crc32(data[(s - n) * 4 : s * 4]) for s, n in zip(stop.tolist(), sizes.tolist())]
                        start = base + stop - sizes
                        base += len(ids)
                        for a in range(0, len(keys), 10_000):
                            s = slice(a, a + 10_000)
                            columns = [pa.array(keys[s], pa.int64(), mask=keys[s] == FIRST), *(pa.array(x[s], pa.int64()) for x in (start, sizes, crc))]
                            if with_ids:
                                lists = np.split(ids[stop[a] - sizes[a] : stop[s][-1]].astype(np.int32), (stop[s] - (stop[a] - sizes[a]))[:-1])
                                columns.append(pa.array(lists, fields.field("ids").type))
                            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    placed = manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens"))
    files = max(1, manifest.count())
    return placed.select("file", "base").repartition(files, "file").mapInArrow(run, schema)


def corpus_to_token_files(docs: DataFrame, out_dir: str, **options) -> DataFrame:
    """Write, then read back. The manifest is stored beside the files."""
    manifest = materialize(write_token_files(docs, out_dir, **options), "token-manifest")
    return read_token_files(docs.sparkSession, manifest)
