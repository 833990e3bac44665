"""Readers: JSON lines, WET and WARC archives, index tables, seed lists."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import number_rows
from ..storage import materialize, open_fs
from .ranges import read_record

WET = "url string, date_download string, digest string, length int, nlines int, source_domain string, title string, raw_content string, cc_segment string"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """One JSON object a line, plain or compressed; a bad line is kept in ``_corrupt_record``, or fails."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(s).option("mode", "FAILFAST").json(paths)
    return spark.read.schema(s.add("_corrupt_record", T.StringType())).option("mode", "PERMISSIVE").json(paths)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file; .gz and .bz2 are opened by extension."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def parse_wet(lines: Iterable[str], segment: str, least: int = 1) -> Iterator[tuple]:
    """Documents of a WET file: conversion records with a text of ``least`` characters or more.

    A record ends where its declared length does, or, without one, at the next line ``WARC/1.0`` behind
    two blank ones, so that such a line within a text doesn't cut it.
    """
    lines = iter(lines)
    line = next(lines, None)
    while line is not None:
        if line.rstrip("\r\n") != "WARC/1.0":
            line = next(lines, None)
            continue
        fields: dict[str, str] = {}
        while (line := next(lines, None)) is not None and line.strip():
            name, _, value = line.rstrip("\r\n").partition(": ")
            fields[name] = value
        declared = fields.get("Content-Length", "")
        left = int(declared) if declared.isdigit() else None
        body: list[str] = []
        blanks = 0
        while (line := next(lines, None)) is not None:
            if left is not None and left <= 0 and not line.strip():
                continue
            if line.rstrip("\r\n") == "WARC/1.0" and (left is None or left <= 0) and (left is not None or blanks >= 1 or not body):
                break
            blanks = 0 if line.strip() else blanks + 1
            body.append(line.rstrip("\r\n"))
            if left is not None:
                left -= len(line.encode())
        if fields.get("WARC-Type") != "conversion":
            continue
        while body and not body[-1]:
            body.pop()
        title, content = (body[0], "\n".join(body[1:])) if body else ("", "")
        if len(content) < least:
            continue
        url = fields.get("WARC-Target-URI", "")
        host = url.partition("://")[2].partition("/")[0]
        yield url, fields.get("WARC-Date"), fields.get("WARC-Block-Digest"), len(content), content.count("\n") + 1, host, title, content, segment


def read_wet(spark: SparkSession, paths: str | list[str], least: int = 300) -> DataFrame:
    """WET files, plain or gzip, a file a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in WET.split(", ")]
        for pdf in batches:
            for uri in pdf["path"]:
                system, path = open_fs(uri)
                with system.open_input_stream(path, compression=None) as raw:
                    stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    rows = []
                    for row in parse_wet(io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"), path.rsplit("/", 1)[1], least):
                        rows.append(row)
                        if len(rows) == 2000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path").mapInPandas(run, WET)


def shard_segments(segments: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """The contiguous range of segments that belongs to a shard."""
    n = segments.count()
    lo, hi = shard * n // shards, (shard + 1) * n // shards
    return number_rows(segments, key, name="_r").where((F.col("_r") >= lo) & (F.col("_r") < hi)).drop("_r")


def read_index(spark: SparkSession, root: str, subset: str = "warc", crawl: str | None = None) -> DataFrame:
    """Crawl index, partitioned by crawl and subset; other partitions aren't listed."""
    out = spark.read.parquet(root).where(F.col("subset") == subset)
    return out.where(F.col("crawl") == crawl) if crawl else out


def read_seeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Seed lists, CSV with a header or Parquet; rows are numbered by address."""
    first = paths if isinstance(paths, str) else paths[0]
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)) if first.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(paths)
    return number_rows(rows, "link", name="seed_id").withColumn("seed_id", F.col("seed_id").cast("int"))


def seed_of(seeds: DataFrame, number: int) -> str:
    """Address of a seed; a number that isn't there, or is there twice, is an error."""
    found = seeds.where(F.col("seed_id") == number).select("link").limit(2).collect()
    if len(found) != 1:
        raise KeyError(number)
    return found[0][0]


def fetch(url: str, first: int | None = None, last: int | None = None, tries: int = 3, wait: float = 10.0) -> bytes:
    """A body, or a range of it, with a few tries; an answer of 4xx isn't tried again, nor is a file that isn't there."""
    if "://" not in url or url.startswith("file:"):
        system, path = open_fs(url)
        return read_record(url, first or 0, (last + 1 if last is not None else system.get_file_info(path).size) - (first or 0))
    request = urllib.request.Request(url, headers={"Range": f"bytes={first}-{last}"} if first is not None else {})
    for k in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if 400 <= error.code < 500 or k + 1 == tries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k + 1 == tries:
                raise
        time.sleep(wait * 2**k)
    raise AssertionError("unreachable")


def download_ranges(rows: DataFrame, prefix: str) -> DataFrame:
    """Fill ``compressed_warc`` where it is null, from filename, offset and length; failures are told."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("compressed_warc", "download_exception")])
    schema = schema.add("compressed_warc", T.BinaryType()).add("download_exception", T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, failed = [], []
            for row in pdf.itertuples():
                have = getattr(row, "compressed_warc", None)
                try:
                    got.append(have if have is not None else fetch(prefix + row.warc_filename, row.warc_record_offset, row.warc_record_offset + row.warc_record_length - 1))
                    failed.append(None)
                except Exception as error:  # noqa: BLE001 - told in the row
                    got.append(None)
                    failed.append(repr(error))
            yield pdf.assign(compressed_warc=got, download_exception=failed)[schema.names]

    return rows.mapInPandas(run, schema)


def failures(rows: DataFrame) -> DataFrame:
    """Rows that couldn't be downloaded, with what happened."""
    return rows.where(F.col("download_exception").isNotNull())


def failure_report(rows: DataFrame) -> DataFrame:
    """Rows in all, with bytes, and failed, and the number of failures of each kind."""
    kind = F.regexp_extract("download_exception", r"^(\w+)", 1)
    return rows.groupBy(F.when(F.col("download_exception").isNull(), "fine").otherwise(kind).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def download_again(rows: DataFrame, prefix: str, rounds: int = 1) -> DataFrame:
    """Further rounds for what failed; rows that have their bytes aren't fetched again."""
    for _ in range(rounds):
        rows = materialize(download_ranges(rows, prefix), "downloads")
        if failures(rows).isEmpty():
            break
    return rows


def read_any_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their file and number, of plain, .gz, .bz2 and .xz files; ``-`` is standard input, of this process.

    Files are read whole by one task each, as .xz isn't a format of Spark's.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        openers = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
        for pdf in batches:
            for uri in pdf["file"]:
                system, path = open_fs(uri)
                with system.open_input_stream(path, compression=None) as raw:
                    opener = next((f for end, f in openers.items() if path.endswith(end)), None)
                    stream = opener(raw) if opener else raw
                    rows = []
                    for n, line in enumerate(io.TextIOWrapper(io.BufferedReader(stream) if opener is None else stream, "utf-8", "replace", newline="\n")):
                        rows.append((uri, n, line.removesuffix("\n")))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["file", "line", "value"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["file", "line", "value"])

    schema = "file string, line long, value string"
    files = [p for p in paths if p != "-"]
    out = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(1, len(files)), "file").mapInPandas(run, schema)
    if "-" in paths:
        out = out.unionByName(spark.createDataFrame([("-", n, x.rstrip("\n")) for n, x in enumerate(sys.stdin)], schema))
    return out


def open_paths(paths: str | list[str], download: Callable[[str], str] | None = None) -> list[str]:
    """Files in the order in which they are read: a pattern's sorted, a list's as they come, addresses by ``download``."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if path.startswith(("http://", "https://")):
            if download is None:
                raise ValueError(f"{path}: nothing downloads")
            out.append(download(path))
        else:
            out += sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]
    return out


def parse_tsv(lines: DataFrame, header: str, line: str = "value", sep: str = "\t") -> DataFrame:
    """Typed columns of separated text: ``name%i``, ``%f``, ``%b`` or text; a bad value is null."""
    kinds = {"i": "bigint", "f": "double", "b": "boolean", "s": "string"}
    fields = [h.rpartition("%") if "%" in h else (h, "", "s") for h in header.split(sep)]
    parts = F.split(F.col(line), sep, len(fields))
    return lines.select(*(F.try_element_at(parts, F.lit(i + 1)).try_cast(kinds[k]).alias(n) for i, (n, _, k) in enumerate(fields)))
