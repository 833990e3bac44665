"""Byte ranges of files: lines that start in one, and records at known places."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..storage import open_fs

_BLOCK = 1 << 20


def range_lines(uri: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that start within [begin, end), a block of the file at a time."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as file:
        size = file.size()
        at, held = max(0, begin - 1), b""
        file.seek(min(at, size))
        if begin:  # the line that the bound falls into belongs to the range before
            while (cut := held.find(b"\n")) < 0:
                block = file.read(_BLOCK)
                if not block:
                    return
                at += len(held)
                held = block
            at, held = at + cut + 1, held[cut + 1 :]
        while at < end:
            cut = held.find(b"\n")
            while cut < 0 and (block := file.read(_BLOCK)):
                seen = len(held)
                held += block
                cut = held.find(b"\n", seen)
            if cut < 0:
                if held:
                    yield at, held
                return
            yield at, held[:cut]
            at, held = at + cut + 1, held[cut + 1 :]


def split_lines(spark: SparkSession, files: list[str], chunk: int, chunks: int) -> DataFrame:
    """file, offset and value of the lines of the ``chunk``-th of ``chunks`` equal byte ranges of each plain file.

    Every line is in one range, whole, also where a bound falls within a line or a character. A range
    is one task's, and only that range and the end of its last line are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["file"]:
                system, path = open_fs(uri)
                size = system.get_file_info(path).size
                step = -(-size // chunks)
                rows = []
                for at, line in range_lines(uri, chunk * step, min(size, (chunk + 1) * step)):
                    rows.append((uri, at, line.decode("utf-8", "replace")))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "offset", "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "offset", "value"])

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)), "file").mapInPandas(run, "file string, offset long, value string")


def read_record(uri: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset`` on."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as file:
        file.seek(offset)
        return file.read(length)
